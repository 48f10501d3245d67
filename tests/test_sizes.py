"""What keeps large tables within limits: nothing whole on the driver, searches that end where they meet, no pairs that are dropped again."""

import re
from datetime import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weft.catalog import all_queries, all_sql, extra, scores, traces, vectors
from weft.functions import graphjson as gj
from weft.operators import centrality, distances, embedding, graph, iterative, kernels, mining, summarize

LINKS = [(a, (a + k) % 30) for a in range(30) for k in (1, 3, 7)[: 1 + a % 3]]


@pytest.fixture
def small_driver(monkeypatch):
    """No table goes to the driver as pandas."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self):
        raise AssertionError("a table went to the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)


def test_null_models_leave_graphs_off_the_driver(spark, monkeypatch, small_driver):
    links = spark.createDataFrame([(min(x), max(x)) for x in LINKS], "u long, v long")
    monkeypatch.setattr(traces, "links", lambda *_: links)
    monkeypatch.setattr(traces, "member", lambda *_: spark.createDataFrame([(k, k % 3) for k in range(30)], "id long, module long"))
    ends = [(a % 3, b % 3) for a, b in LINKS]
    share = np.bincount([m for e in ends for m in e]) / (2 * len(ends))
    r = traces.n02(spark, None).first()
    assert r.observed == pytest.approx(np.mean([a == b for a, b in ends]) - (share**2).sum()) and r.null_sd > 0
    monkeypatch.setattr(traces, "simple", lambda *_: spark.createDataFrame([(a, b, "xyz"[a % 3]) for a, b in LINKS], "src long, dst long, relation string"))
    assert traces.n04(spark, None).count() > 0
    rows = [(k, [float(k % 5), 1.0]) for k in range(30)]
    monkeypatch.setattr(extra, "vectors_of_nodes", lambda *_: spark.createDataFrame(rows, "id long, v array<double>"))
    monkeypatch.setattr(vectors, "edges", lambda *_: None)
    monkeypatch.setattr(vectors.graph, "links", lambda _: links)
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    assert vectors.n03(spark, None).first().observed == pytest.approx(np.mean([unit[a] @ unit[b] for a, b in LINKS]), abs=1e-5)


def test_draws_do_not_depend_on_the_order_of_rows(spark):
    one, two = (embedding.modularity_z(spark.createDataFrame(rows, "u long, v long").repartition(3), 5).first() for rows in (LINKS, LINKS[::-1]))
    assert one == two


def test_paths_are_searched_from_both_ends(spark, monkeypatch):
    """Of a grid's shortest paths the smallest predecessors from the target on; levels hold what lies within half the distance."""
    grid = [((x, y), (x + 1, y)) for x in range(11) for y in range(12)] + [((x, y), (x, y + 1)) for x in range(12) for y in range(11)]
    code = lambda p: (p[0] * 12 + p[1]) * 5 % 144
    assert len({code((x, y)) for x in range(12) for y in range(12)}) == 144
    links = [(code(p), code(q)) for p, q in grid]
    both = links + [(b, a) for a, b in links]
    pairs = [(code((5, 5)), code((9, 6))), (code((5, 5)), code((6, 5))), (code((5, 5)), code((5, 5))), (code((0, 0)), code((11, 11))), (code((2, 3)), 999), (code((1, 9)), code((3, 6)))]
    levels = []
    real = iterative.written
    monkeypatch.setattr(iterative, "written", lambda df, name: levels.append((name, real(df, name))) or levels[-1][1])
    got = {(r.source, r.target): (r.dist, tuple(r.path)) for r in iterative.shortest_paths(spark.createDataFrame(both, "a long, b long"), spark.createDataFrame(pairs, "source long, target long"), 9).collect()}
    near = kernels._adjacency([(*p, "") for p in links], False)
    want = {}
    for s, t in pairs:
        d = kernels.distances(near, s) if s in near else {s: 0}
        if d.get(t, 99) <= 9:
            path = [t]
            while path[0] != s:
                path.insert(0, min(x for x in near[path[0]] if d[x] == d[path[0]] - 1))
            want[s, t] = (d[t], tuple(path))
    assert got == want and len(want) == 4
    monkeypatch.undo()
    held = [df.where(f"end = {code((5, 5))}").count() for name, df in levels if name == "level"]
    assert 0 < sum(held) <= 2 + 4 + 8 + 12  # three steps from it meet two from the other end


def test_constraint_opens_no_pairs_that_are_no_contacts(spark):
    links = [(min(a, b), max(a, b)) for a, b in LINKS] + [(100, k) for k in range(101, 130)] + [(101, 102), (102, 103), (101, 103)]
    near = kernels._adjacency([(*p, "") for p in links], False)
    want = {i: sum((1 / len(near[i]) + sum(1 / len(near[i]) / len(near[q]) for q in near[i] if j in near[q])) ** 2 for j in near[i]) for i in near}
    df = graph.constraint(spark.createDataFrame(sorted(set(links)), "u long, v long"))
    assert {r.id: r.constraint for r in df.collect()} == pytest.approx(want)
    assert "(p * p2)" not in df._jdf.queryExecution().analyzed().toString()  # two-paths are not weighed


@pytest.mark.parametrize("block", [4, 1000])
def test_signatures_meet_block_by_block(spark, block):
    rng = np.random.default_rng(4)
    own = {i: {f"k{k}": float(rng.integers(1, 5)) for k in rng.choice(9, rng.integers(1, 6), replace=False)} for i in range(30)}
    df = spark.createDataFrame([(i, k, w) for i, s in own.items() for k, w in s.items()], "id long, key string, w double")
    out = graph.signature_cosine(df, 0.4, 2, block)
    size = lambda s: sum(w * w for w in s.values()) ** 0.5
    want = {}
    for a in own:
        for b in range(a + 1, 30):
            both = own[a].keys() & own[b].keys()
            cosine = sum(own[a][k] * own[b][k] for k in both) / (size(own[a]) * size(own[b]))
            if len(both) >= 2 and cosine >= 0.4:
                want[a, b] = (pytest.approx(cosine), len(both))
    assert want and {(r.a, r.b): (r.cosine, r.shared) for r in out.collect()} == want
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and "Join" not in out._jdf.queryExecution().analyzed().toString()


def test_resamples_of_a_large_group_are_dealt_to_tasks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    values = {"a": rng.normal(size=80), None: rng.normal(size=40), "c": np.ones(3)}
    df = spark.createDataFrame([(g, float(v)) for g, x in values.items() for v in x], "g string, v double")
    monkeypatch.setattr(summarize, "DRAWS", 4_000)
    out = summarize.bootstrap_mean(df, "v", ["g"], 999)
    got = {r.g: r for r in out.collect()}
    assert got.keys() == values.keys() and (got["c"].ci_low, got["c"].ci_high) == (1, 1)
    for g in ("a", None):
        x, r = values[g], got[g]
        half = 1.96 * x.std() / len(x) ** 0.5
        assert (r.mean, r.n) == (pytest.approx(x.mean()), len(x))
        assert (r.ci_low, r.ci_high) == pytest.approx((x.mean() - half, x.mean() + half), abs=0.25 * half)
    assert "__part" in out._jdf.queryExecution().analyzed().toString()


def test_pairs_are_searched_without_rows_of_what_lies_around_them(spark, monkeypatch):
    """A way of 40 nodes, a star and all their pairs: no table is larger than links, nodes and pairs; levels that are dropped are found again."""
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(40, 100)]
    near = kernels._adjacency([(*x, "") for x in links], False)
    ends = [*range(0, 41, 2), *range(100, 140, 3), 999]
    pairs = [(a, b) for a in ends for b in ends if a < b]
    sizes = []
    for module in (iterative, distances):
        monkeypatch.setattr(module, "written", lambda df, name, real=module.written: sizes.append(df.count()) or real(df, name))
    both = spark.createDataFrame(links + [(b, a) for a, b in links], "a long, b long").repartition(3)
    asked = spark.createDataFrame(pairs + pairs[:5] + [(0, 0)], "a long, b long")
    for far in (1, 4, 7):
        got = sorted((r.a, r.b, r.dist) for r in iterative.pair_distances(both, asked, far).collect())
        assert got == sorted((a, b, d) for a, b in pairs if 0 < (d := kernels.distances(near, a).get(b, 99) if a in near else 99) <= far)
    assert max(sizes) <= max(2 * len(links), len(pairs))
    by_joins = iterative.pair_distances(both, asked, 4, task_links=0)
    assert sorted(map(tuple, by_joins.collect())) == sorted(map(tuple, iterative.pair_distances(both, asked, 4).collect()))
    ids = np.array(sorted(near))
    first = np.concatenate(([0], np.cumsum([len(near[x]) for x in ids])))
    other = np.searchsorted(ids, [y for x in ids for y in near[x]]).astype(np.int32)
    small = distances.Search(first, other, kept=10)
    for far in (7, 60):
        for k in (0, 17, 40, 41, 60, 17):
            hops = kernels.distances(near, ids[k])
            want = [hops[x] if hops[x] <= far else -1 for x in ids]
            assert small.hops(k, np.arange(len(ids)), far).tolist() == want


def test_dissonance_counts_paths_beyond_the_last_hop_as_its_sql_does(spark, tmp_path):
    day = datetime(1996, 1, 1)
    # 12 customers in a row, and vectors of its ends, of two within it and of one elsewhere
    orders = pa.table({"o_orderkey": [*range(12), 50, 51], "o_custkey": [*range(12), 50, 51], "o_orderdate": [day] * 12 + [datetime(1997, 1, 1)] * 2, "o_orderpriority": ["1-URGENT"] * 14})
    v = {0: [1.0, 0.0], 11: [0.8, 0.6], 5: [0.6, 0.8], 6: [0.0, 1.0], 50: [1.0, 0.0]}
    embeddings = pa.table({"vec_id": list(v), "embedding": pa.array(list(v.values()), pa.list_(pa.float32())), "label": pa.array([0] * len(v), pa.int32())})
    con = duckdb.connect()
    for name, rows in (("orders", orders), ("embeddings", embeddings)):
        pq.write_table(rows, tmp_path / f"{name}.parquet", coerce_timestamps="us")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(con.execute(all_sql()["m06_dissonance"]).fetchall(), key=str)
    got = sorted(map(tuple, all_queries()["m06_dissonance"](spark, str(tmp_path)).collect()), key=str)
    assert got == want and {h for *_, h, _ in want} == {None, 5, 6}


@pytest.mark.parametrize("listed, summed", [(3, 20), (1000, 2_000_000)])
def test_first_pairs_are_those_of_all_pairs(spark, listed, summed):
    rng = np.random.default_rng(1)
    ends = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (90, 2)) if a != b} | {(7, b) for b in range(20) if b != 7})
    simple = spark.createDataFrame([(a, b, "r", k) for k, (a, b) in enumerate(ends)], "src long, dst long, relation string, seq long")
    u = graph.links(simple)
    near = graph.both(u).select(F.col("a").alias("mid"), F.col("b").alias("v"))
    w = near.groupBy("mid").agg(F.count("*").alias("d")).where("d > 1").select("mid", (1 / F.log("d")).alias("w"))
    of = lambda df: sorted(((round(r.score, 6), r.u, r.v, r.common) for r in df.collect()), key=lambda r: (-r[0], *r[1:]))
    every = of(graph.adamic_adar(u).withColumnRenamed("aa", "score"))
    one = near.join(w, "mid").select("mid", F.col("v").alias("u"), "w")
    paths = of(graph.open_triads(simple).select(F.col("a").alias("u"), F.col("c").alias("v"), F.col("paths").alias("common"), F.col("paths").cast("double").alias("score")))
    into, out = simple.select(F.col("dst").alias("mid"), F.col("src").alias("u"), F.lit(1.0).alias("w")), simple.select(F.col("src").alias("mid"), F.col("dst").alias("v"))
    for n in (1, 10, 10_000):
        assert of(graph.first_pairs(one, near, u, n, 2e-6, True, listed, summed))[:n] == every[:n]
        assert of(graph.first_pairs(into, out, simple.select(F.col("src").alias("u"), F.col("dst").alias("v")), n, listed=listed, summed=summed))[:n] == paths[:n]


def test_mined_insights_send_no_pairs(spark):
    text = all_queries()["k08_mined_insights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and not re.search(r"Exchange hashpartitioning\((u|a)#\d+L?, (v|c)#\d+L?", text)


def test_tasks_make_no_row_for_what_a_line_gives(spark, tmp_path):
    """Lines that share parts, suppliers and keys, whose payloads differ in order as text and as numbers."""
    rows = [(7, k, float(q), p, s, f) for k, (q, p, s, f) in enumerate([(9, 1, 1, "A"), (10, 1, 1, "A"), (2, 1, 2, "R"), (30, 2, 1, "X"), (4, 2, 1, "X"), (5, 1, 1, "A"), (100, 3, 3, "N")], 1)] + [(8, 4, 1.0, 5, 5, "X"), (9, 5, 1.0, 5, 5, "N")]
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_returnflag"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))), tmp_path / "lineitem.parquet")
    t = scores.tasks(spark, str(tmp_path))
    text = t._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and text.count("Exchange hashpartitioning") == 1
    one = {r.o: r for r in t.collect()}[7]
    assert one.gn == {"p1": "q9.0", "p2": "q4.0", "p3": "q100.0", "s1": "s", "s2": "s", "s3": "s"}
    assert one.pe == {"p1\tA\ts1": "q9.0", "p1\tR\ts2": "q2.0", "p1\tA\ts1": "q9.0", "p2\tX\ts1": "x", "p3\tN\ts3": "q100.0"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = sorted(map(tuple, all_queries()["r02_graph_metrics"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(all_sql()["r02_graph_metrics"]).fetchall())


def test_every_node_is_a_source_whatever_the_size(spark):
    # a ring with chords beyond the number of nodes at which pivots were taken: by its symmetry all nodes are equal
    n = 1504
    links = {tuple(sorted((i, (i + k) % n))) for i in range(n) for k in (1, 40)}
    near = {i: {(i + k) % n for k in (1, -1, 40, -40)} for i in range(n)}
    dist = kernels.distances(near, 0)
    u = spark.createDataFrame(sorted(links), "u long, v long")
    close = {r.id: r.closeness for r in centrality.closeness(u).collect()}
    assert close == pytest.approx(dict.fromkeys(range(n), (n - 1) / sum(dist.values())))
    # the inner nodes of all shortest paths, shared out evenly
    inner = (sum(dist.values()) - (n - 1)) / ((n - 1) * (n - 2))
    assert {r.id: r.betweenness for r in centrality.betweenness(u).collect()} == pytest.approx(dict.fromkeys(range(n), inner))
    assert centrality.small_world(u).first().distance == pytest.approx(sum(dist.values()) / (n - 1))


def test_walks_by_joins_go_in_groups(spark):
    links = [(1, 2), (2, 3), (20, 21)]
    near = graph.both(spark.createDataFrame(links, "u long, v long"))
    start = near.selectExpr("a AS id").distinct()
    one, many = ([{tuple(r) for r in x.collect()} for x in centrality._by_joins(near, start, rows)] for rows in (10**6, 15))
    assert one == many and len(one[1]) == 5


def test_every_neighbour_of_a_hub_opens_pairs(spark, monkeypatch):
    # 203 leaves of a hub, of which two more nodes share a pair
    leaves = range(1, 204)
    links = [(0, k) for k in leaves] + [(1, 300), (203, 300)]
    u = spark.createDataFrame(links, "u long, v long")
    vectors = spark.createDataFrame([(k, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in leaves], "id long, v array<double>")
    pairs = {(a, b) for a in leaves for b in leaves if a < b}
    edges = u.selectExpr("u AS src", "v AS dst", "5L AS iter")
    born = spark.createDataFrame([(k, k) for k in (0, *leaves, 300)], "id long, iter long")
    for meet in (200, 70):
        monkeypatch.setattr(mining, "MEET", meet)
        found = {(r.u, r.v): r.common for r in mining.latent_links(u, vectors).collect()}
        assert found == {p: 2 if p == (1, 203) else 1 for p in pairs} | {(0, 300): 2}
        met = {(r.u, r.v): r.iter for r in mining.recombinations(edges, born, vectors, below=-0.5).collect()}
        assert met == {p: max(5, p[1]) for p in pairs if p[0] % 2 != p[1] % 2}


def test_graph_json_is_read_once_an_object(spark):
    text = '{"nodes": [{"id": "b"}, {"id": " a ", "x": 1}, {"id": "a"}, {"id": ""}], "edges": [{"source": "a", "relation": "r", "target": "b"}, {"source": "a", "relation": "r", "target": "b", "w": 2}, {"source": "a", "target": "z"}]}'
    df = spark.createDataFrame([(text,), (None,), ('{"nodes": []}',)], "j string")
    g = gj.parsed(F.col("j"))
    one, two = df.select(gj.canonical(g).alias("c")), df.select(gj.audit(g).alias("a"))
    # a node has one field that is read, an edge three
    for found in (one, two):
        assert found._jdf.queryExecution().analyzed().toString().count("get_json_object") == 4
    first = one.first().c
    assert [x.k for x in first.nodes] == ["a", "b"] and [x.k for x in first.edges] == ["a\tr\tb"] and first.nodes[0].p == '{"id":" a ","x":1}'
    assert [tuple(r.a) for r in two.collect()] == [(False, 1, 1, 1, False), (False, 0, 0, 0, False), (False, 0, 0, 0, False)]
