"""Operators that SQL cannot express, against brute force and invariants."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import measures, text
from weft.operators import embedding, graph, iterative, joins, kernels, sampling, scoring, series, summarize
from weft.operators.components import connected_components
from weft.sources import readers


def random_edges(n, m, seed):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)} - {(i, i) for i in range(n)})


def test_macro_mean_by_source_and_task(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0)], "s int, v double")
    r = summarize.macro_mean(df, "v", "s").first()
    assert (r.mean, r.n, r.rows) == (0.5, 2, 3)
    assert summarize.macro_mean(df, "v", "s", unit="task").first().mean == pytest.approx(2 / 3)


def test_bootstrap_covers_the_mean_and_degenerates(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(300)] + [("b", 2.0)] * 5 + [("c", 1.0)] + [("a", float("nan"))], "g string, v double")
    r = {x.g: x for x in summarize.bootstrap_mean(df, "v", ["g"], 500).collect()}
    assert r["a"].ci_low < r["a"].mean < r["a"].ci_high and r["a"].n == 300
    assert r["b"].ci_low == r["b"].ci_high == 2.0 and r["c"].n == 1


CASES = [
    ("prior_empty", {}, {}, [], []),
    ("fixed_nodes_only", {"A": "1", "B": "1", "C": "1"}, {}, ["A", "B", "C"], []),
    ("missing_edges", {"A": "1", "B": "1", "C": "1"}, {"A\tr\tB": "1"}, ["A", "B", "C"], ["A\tr\tB"]),
    ("partial_subgraph", {"A": "1", "B": "1"}, {"A\tr\tB": "1"}, ["A", "B"], ["A\tr\tB"]),
    ("wrong_relations", {"A": "1", "B": "1", "C": "1"}, {"A\tx\tB": "1", "B\tr\tC": "1"}, ["A", "B", "C"], []),
    ("extra_edges", {"A": "1", "B": "1", "C": "1"}, {"A\tr\tB": "1", "B\tr\tC": "1", "A\tr\tC": "1", "C\tr\tA": "1"}, ["A", "B", "C"], []),
]


def test_perfect_over_unchanged_over_malformed(spark):
    gold = ({"A": "1", "B": "1", "C": "1"}, {"A\tr\tB": "1", "B\tr\tC": "1", "A\tr\tC": "1"})
    rows = []
    for mode, xn, xe, fn, fe in CASES:
        rows.append((mode, "perfect", *gold, *gold, xn, xe, fn, fe, True))
        rows.append((mode, "unchanged", xn, xe, *gold, xn, xe, fn, fe, True))
        rows.append((mode, "malformed", {}, {}, *gold, xn, xe, fn, fe, False))
    m = "map<string,string>"
    df = spark.createDataFrame(rows, f"mode string, kind string, pn {m}, pe {m}, gn {m}, ge {m}, xn {m}, xe {m}, fixed_nodes array<string>, fixed_edges array<string>, valid boolean")
    x = scoring.graph_metrics(df).withColumns({"primary": scoring.primary_score(F.col("mode")), "baseline": F.lit(0.0), "schema_valid": F.lit(1.0), "structural_validity": F.lit(1.0), "duplicates": F.lit(0.0), "dangling": F.lit(0.0), "target_size": F.lit(6.0), "answer_ok": F.col("valid")})
    x = x.withColumn("format", scoring.format_score(F.lit(1), F.lit(1), F.col("valid"), F.col("valid"), F.col("valid")))
    got = {(r.mode, r.kind): r.reward for r in scoring.reward(x, scoring.Reward()).collect()}
    for mode, *_ in CASES:
        assert got[mode, "perfect"] > got[mode, "unchanged"] > got[mode, "malformed"] - 1e-9 or got[mode, "perfect"] > got[mode, "malformed"]
        assert got[mode, "perfect"] == pytest.approx(1.0)
        assert got[mode, "malformed"] <= 0.1


def test_reward_weights_are_checked():
    with pytest.raises(ValueError):
        scoring.Reward(weights={"node": 0.5}).validate()


def test_components_against_union(spark):
    pairs = random_edges(120, 90, 2)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = kernels._adjacency([(a, b, "") for a, b in pairs], False)
    assert got == {x: min(kernels.distances(near, x)) for x in near}


def test_pagerank_against_numpy(spark):
    pairs = random_edges(40, 130, 3)
    got = {r.id: r["rank"] for r in iterative.pagerank(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for s, d in pairs:
        a[at[d], at[s]] = 1
    out = a.sum(0)
    r = np.full(len(ids), 1 / len(ids))
    for _ in range(200):
        r = 0.15 / len(ids) + 0.85 * (a @ np.where(out > 0, r / np.maximum(out, 1), 0) + r[out == 0].sum() / len(ids))
    assert sum(got.values()) == pytest.approx(1, abs=1e-9)
    assert max(abs(got[x] - r[at[x]]) for x in ids) < 1e-5


def test_core_numbers_against_peeling(spark):
    links = sorted({tuple(sorted(p)) for p in random_edges(40, 150, 4)})
    got = {r.id: r.core for r in iterative.core_numbers(spark.createDataFrame(links, "u long, v long")).collect()}
    near = {k: set(v) for k, v in kernels._adjacency([(*p, "") for p in links], False).items()}
    want, k = {}, 0
    while near:
        low = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[low]))
        want[low] = k
        for y in near.pop(low):
            near[y].discard(low)
    assert got == want


def test_eigenvector_is_an_eigenvector(spark):
    links = sorted({tuple(sorted(p)) for p in random_edges(25, 90, 6)})
    got = {r.id: r.value for r in iterative.eigenvector(spark.createDataFrame(links, "u long, v long")).collect()}
    ids = sorted(got)
    a = np.zeros((len(ids), len(ids)))
    for u, v in links:
        a[ids.index(u), ids.index(v)] = a[ids.index(v), ids.index(u)] = 1
    w = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert max(abs(got[x] - w[i]) for i, x in enumerate(ids)) < 5e-3


def test_shortest_paths_are_paths(spark):
    links = sorted({tuple(sorted(p)) for p in random_edges(40, 60, 8)})
    n = graph.both(spark.createDataFrame(links, "u long, v long"))
    near = kernels._adjacency([(*p, "") for p in links], False)
    pairs = [(x, y) for x in list(near)[:6] for y in list(near)[-6:]]
    for r in iterative.shortest_paths(n, spark.createDataFrame(pairs, "source long, target long"), 12).collect():
        assert r.dist == kernels.distances(near, r.source)[r.target] == len(r.path) - 1
        assert r.path[0] == r.source and r.path[-1] == r.target
        assert all(b in near[a] for a, b in itertools.pairwise(r.path))


def test_cut_points_against_removal():
    for seed in range(12):
        edges = [(a, b, "") for a, b in random_edges(14, 17, seed)]
        near = kernels._adjacency(edges, False)
        pieces = lambda g: len({min(kernels.distances(g, x)) for x in g})
        whole = pieces(near)
        want = {}
        for x in near:
            extra = pieces({k: [y for y in v if y != x] for k, v in near.items() if k != x}) - whole
            if extra > 0:
                want[x] = extra
        bridges = {(a, b) for a in near for b in near[a] if a < b and pieces({k: [y for y in v if {k, y} != {a, b}] for k, v in near.items()}) > whole}
        rows = kernels.cut_points(edges)
        assert {r[1]: r[3] for r in rows if r[0] == "articulation"} == want
        assert {r[1:3] for r in rows if r[0] == "bridge"} == bridges


def test_betweenness_against_path_counts():
    edges = [(a, b, "") for a, b in random_edges(9, 26, 5)]
    near = kernels._adjacency(edges, True)
    want = dict.fromkeys(near, 0.0)
    for s, t in itertools.permutations(near, 2):
        d = kernels.distances(near, s)
        if t in d:
            paths = [p for k in range(d[t] + 1) for p in itertools.permutations([x for x in near if x not in (s, t)], k) if k == d[t] - 1 and all(b in near[a] for a, b in itertools.pairwise((s, *p, t)))]
            for p in paths:
                for x in p:
                    want[x] += 1 / len(paths)
    n = len(near)
    for x, v in kernels.betweenness(edges):
        assert v == pytest.approx(want[x] / ((n - 1) * (n - 2)))


def test_jittered_paths_are_paths():
    edges = [(a, b, "") for a, b in random_edges(12, 30, 3)]
    near = kernels._adjacency(edges, False)
    rows = kernels.jittered_paths(edges, 20, "s")
    assert rows and rows == kernels.jittered_paths(edges, 20, "s")
    for a, b, path, hops in rows:
        p = [int(x) for x in path.split(">")]
        assert (p[0], p[-1], len(p) - 1) == (a, b, hops) and len(set(p)) == len(p) and all(y in near[x] for x, y in itertools.pairwise(p))


def test_communities_beat_one_module():
    edges = [(a, b, "") for a, b in itertools.combinations(range(5), 2)] + [(a, b, "") for a, b in itertools.combinations(range(5, 10), 2)] + [(0, 5, "")]
    got = dict(kernels.communities(edges))
    assert len({got[i] for i in range(5)}) == len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[5]


def test_isomorphism_and_automorphisms():
    square = [("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r"), ("d", "a", "r")]
    other = [("w", "y", "r"), ("y", "x", "r"), ("x", "z", "r"), ("z", "w", "r")]
    assert kernels.isomorphic(square, other) and kernels.isomorphic(square, other, ("a", "y"))
    assert not kernels.isomorphic(square, [*other[:3], ("z", "w", "s")])
    assert kernels.automorphisms(square) == [(4,)]


def test_extent():
    assert kernels.extent([("a", "b", ""), ("b", "c", ""), ("a", "c", "")])[0][:3] == (True, 2, 1)
    assert kernels.extent([("a", "b", ""), ("b", "a", "")])[0][:3] == (False, None, 1)
    assert 0 <= scoring.structure_score(3, [("a", "b"), ("b", "c")]) <= 1


def test_round_robin_returns_to_the_first_mode():
    order = ["a", "b", "c"]
    left = {"a": 5, "b": 1, "c": 4}
    want, modes, cursor, taken = dict(left), list(order), 0, dict.fromkeys(order, 0)
    while sum(taken.values()) < 7 and modes:
        m = modes[cursor % len(modes)]
        want[m] -= 1
        taken[m] += 1
        if want[m]:
            cursor += 1
        else:
            modes.remove(m)
            cursor = 0
    assert sampling.round_robin(left, order, 7) == taken


def test_unfinished_refuses_foreign_rows(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(3,)], "k int")
    assert [r.k for r in joins.unfinished(a, a.where("k = 1"), ["k"]).collect()] == [2]
    with pytest.raises(Exception, match="not requested"):
        joins.unfinished(a, b, ["k"]).collect()


def test_sequential_dedup_keeps_the_first(spark):
    rows = [(0, i, [float(x) for x in v]) for i, v in enumerate([(1, 0), (0.99, 0.1), (0, 1), (0.7, 0.7), (0.71, 0.7)])]
    got = {r.id: r.merged_into for r in embedding.sequential_dedup(spark.createDataFrame(rows, "g int, i long, v array<double>"), "g", "i", "v", 0.95).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


def test_pairs_above_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, 0.0, [float(x) for x in r]) for i, r in enumerate(v)], "id long, ord double, v array<double>")
    got = {(r.a, r.b) for r in embedding.pairs_above(df, 0.5).collect()}
    s = v @ v.T
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.5}


def test_smoothing_and_rolling_like_pandas(spark):
    import pandas as pd

    y = pd.Series([3.0, 1, 4, 1, 5, 9, 2, 6])
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(y)], "run string, step int, v double")
    assert series.smoothed(df, ["run"], "step", "v", 4).first().ema == pytest.approx(y.ewm(span=4, adjust=False).mean().tolist())
    got = [r.rolling for r in series.rolling_mean(df, ["run"], "step", "v", 4).orderBy("step").collect()]
    assert got == pytest.approx(y.rolling(4, center=True, min_periods=1).mean().tolist())


def test_text_functions(spark):
    df = spark.createDataFrame([("<t> a </t><answer>{}</answer> x", "CamelCase_labelThe"), ("```json\n{\"a\":1}\n``` <answer>", ""), (None, None)], "t string, l string")
    rows = df.select(text.first_tag(F.col("t"), "t").alias("tag"), text.last_answer(F.col("t")).alias("a"), text.fenced_json(F.col("t")).alias("f"), text.slug(F.col("l")).alias("s"), text.label_tokens(F.col("l"), ["the"]).alias("k")).collect()
    assert rows[0].tag == "a" and rows[0].a.answer == "{}" and rows[0].a.error == "trailing"
    assert rows[1].a.error == "unclosed" and rows[1].f == '{"a":1}'
    assert rows[0].s == "camelcase-labelthe" and rows[0].k == ["camel", "case", "label"]
    assert rows[2].tag is None and rows[2].f is None


def test_measures(spark):
    r = spark.range(1).select(measures.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), measures.recovery(F.lit(1.0), F.lit(0.0), F.lit(2.0), -0.5, 1.5).alias("r"), measures.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("j")).first()
    assert r.c == pytest.approx(0.5**0.5) and r.r == 1.5 and r.j == 0


def test_jsonl_graphml_manifest_and_cache(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n[1]\n')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert sorted(r.a for r in readers.read_jsonl_strict(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [1, 2]
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_jsonl_strict(spark, str(tmp_path / "b.jsonl"), schema).collect()
    folder = tmp_path / "g"
    folder.mkdir()
    (folder / "iter_0001.graphml").write_text(readers.graphml_text([("a", "A & b", 1, 0), ("b", "B", 2, 1)], [("a", "b", "causes", 2, 1)]))
    (folder / "iter_0002.graphml").write_text("<graphml><node")
    nodes, edges = readers.newest_readable(spark, str(folder), lambda p: readers.read_graphml(spark, p))
    assert sorted((r.id, r.label, r.iter) for r in nodes.collect()) == [("a", "A & b", 1), ("b", "B", 2)]
    assert [(r.src, r.dst, r.relation, r.depth) for r in edges.collect()] == [("a", "b", "causes", 1)]
    readers.write_snapshot(nodes, edges, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap/nodes")).count() == 2
    readers.write_manifest({"seed": 1}, str(tmp_path / "m.json"))
    assert (tmp_path / "m.json").read_text().startswith("{")
    assert readers.parse_dataset_spec("org/a:20|b") == [("org/a", 20), ("b", None)]
    labels = spark.createDataFrame([("x",), ("y",)], "label string")
    embed = lambda df: df.withColumn("vector", F.array(F.length("label").cast("double")))
    for _ in range(2):
        assert readers.cached_embeddings(labels, str(tmp_path / "cache"), "m", embed).count() == 2
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2
    assert readers.run_listing(spark, str(folder)).count() == 2


def test_completion_dataset_is_checked(spark, tmp_path):
    row = spark.range(1).select(*[F.lit("x").alias(c) for c in readers.REQUIRED_COLUMNS])
    row.write.parquet(str(tmp_path / "train"))
    row.drop("mode").write.parquet(str(tmp_path / "test"))
    with pytest.raises(ValueError, match="mode"):
        readers.load_completion_dataset(spark, str(tmp_path))


def test_greedy_pairs_past_the_first_block(spark, monkeypatch):
    from weft.catalog import flows
    from weft.operators import sampling

    rows = [(1000.0 - k / 10, 0, k) for k in range(1, 2500)] + [(float(a % 7), a, a + 5000) for a in range(3000, 3100)]
    want = sampling.greedy_pairs([(s, u, v, (u, v)) for s, u, v in rows], 40, 2)
    monkeypatch.setattr(flows, "links", lambda *_: None)
    monkeypatch.setattr(flows.graph, "adamic_adar", lambda _: spark.createDataFrame(rows, "aa double, u long, v long"))
    assert [(r.aa, r.u, r.v) for r in flows.l07(spark, None).collect()] == [w[:3] for w in want] and len(want) == 40


def test_capped_leads_past_a_large_module(spark, monkeypatch):
    from weft.catalog import extra

    rows = [(i, 0 if i < 450 else i % 20, 900.0 - i) for i in range(600)]
    monkeypatch.setattr(extra, "nodes", lambda *_: spark.createDataFrame([(i, r, 0) for i, _, r in rows], "id long, rank double, degree long"))
    monkeypatch.setattr(extra, "member", lambda *_: spark.createDataFrame([(i, m) for i, m, _ in rows], "id long, module long"))
    used, want = {}, []
    for i, m, _ in rows:
        if used.get(m, 0) < 2 and len(want) < 30:
            used[m] = used.get(m, 0) + 1
            want.append((i, m))
    assert [(r.id, r.module) for r in extra.l08(spark, None).collect()] == want and len(want) == 30


def test_hull_area_is_exact(spark, monkeypatch):
    import math

    from weft.catalog import extra

    ring = [(math.cos(2 * math.pi * k / 1000), math.sin(2 * math.pi * k / 1000)) for k in range(1000)]
    rows = [("ring", p) for p in ring] + [("ring", (x / 2, y / 2)) for x, y in ring]
    rows += [("square", p) for p in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0), (1.0, 0.0))] + [("line", (float(k), float(k))) for k in range(5)] + [("none", None), (None, (1.0, 2.0))]
    monkeypatch.setattr(extra, "table", lambda *_: spark.createDataFrame(rows, "label string, embedding array<double>").repartition(7))
    got = {r.label: r.area for r in extra.v10(spark, None).collect()}
    assert got.pop("ring") == pytest.approx(500 * math.sin(2 * math.pi / 1000), rel=1e-12)
    assert got == {"square": 4.0, "line": 0.0, "none": None, None: 0.0}


def test_motif_null_permutes_labels_over_edges(spark, monkeypatch):
    from weft.catalog import traces

    rng = random.Random(3)
    pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(60)})
    rows = [(a, b, rng.choice("xyz"), k) for k, (a, b) in enumerate(pairs) if a != b]
    monkeypatch.setattr(traces, "simple", lambda *_: spark.createDataFrame(rows, "src long, dst long, relation string, seq long"))

    def count(labels):
        out = {}
        for (a, b, *_), r1 in zip(rows, labels, strict=True):
            for (b2, c, *_), r2 in zip(rows, labels, strict=True):
                if b == b2 and a != c:
                    out[r1, r2] = out.get((r1, r2), 0) + 1
        return out

    real = [r[2] for r in rows]
    code = np.array(["xyz".index(r) for r in real])
    nulls = [count(["xyz"[k] for k in np.random.default_rng(s).permutation(code)]) for s in range(1, 201)]
    got = {(r.r1, r.r2): r for r in traces.n04(spark, None).collect()}
    assert {k: r.observed for k, r in got.items()} == count(real)
    for k, r in got.items():
        null = [n.get(k, 0) for n in nulls]
        assert (r.null_mean, r.null_sd) == pytest.approx((np.mean(null), np.std(null)))
        assert r.p == pytest.approx((1 + sum(n >= r.observed for n in null)) / 201)


def test_modularity_null_swaps_edges(spark, monkeypatch):
    from weft.catalog import traces

    left, right = np.array([(a, (a + k) % 30) for a in range(30) for k in (1, 3, 7)[: 1 + a % 3]]).T
    a, b = embedding.swapped_edges(left, right, np.random.default_rng(1))
    assert np.array_equal(np.bincount(np.concatenate((a, b)), minlength=30), np.bincount(np.concatenate((left, right)), minlength=30))
    assert len({frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}) == len(left) and (a != b).all()
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)} != {frozenset(x) for x in zip(left.tolist(), right.tolist(), strict=True)}
    # a complete graph has no swaps, though its stubs could be dealt anew
    full = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    monkeypatch.setattr(traces, "links", lambda *_: spark.createDataFrame(full, "u long, v long"))
    monkeypatch.setattr(traces, "member", lambda *_: spark.createDataFrame([(k, k % 2) for k in range(5)], "id long, module long"))
    assert traces.n02(spark, None).first().null_mean is None


def test_heterophily_permutes_vectors(spark, monkeypatch):
    from weft.catalog import extra, vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20) if (a + 2 * b) % 7 == 0]
    monkeypatch.setattr(extra, "vectors_of_nodes", lambda *_: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>"))
    monkeypatch.setattr(vectors, "edges", lambda *_: None)
    monkeypatch.setattr(vectors.graph, "links", lambda _: spark.createDataFrame(pairs, "u long, v long"))
    monkeypatch.setattr(vectors, "table", lambda *_: spark.createDataFrame([(k, k % 3) for k in range(20)], "c_custkey long, c_nationkey long"))
    cosine = lambda p: np.mean([x[p[a]] @ x[p[b]] for a, b in pairs])
    nulls = [cosine(np.random.default_rng(s).permutation(20)) for s in range(1, 501)]
    r, o = vectors.n03(spark, None).first(), cosine(np.arange(20))
    assert (r.observed, r.null_mean, r.null_sd) == pytest.approx((o, np.mean(nulls), np.std(nulls)), abs=1e-5)
    assert r.p == pytest.approx(2 * (1 + min(sum(n >= o for n in nulls), sum(n <= o for n in nulls))) / 501, abs=0.01)
