"""Deeper evidence, strategies, stops and canonical graphs against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import evidence, growth, iterative, kernels


def some_graph(seed=3, n=40, m=90):
    rng = random.Random(seed)
    pairs = rng.sample([(a, b) for a in range(n) for b in range(n) if a != b and (a < 32) == (b < 32)], m)  # two components at least
    pairs += [(0, i) for i in range(2, 20) if (0, i) not in pairs]  # a hub
    return [(a, b, rng.choice("xyz"), rng.randrange(10), i) for i, (a, b) in enumerate(pairs)]


def undirected(rows):
    near = {}
    for a, b, *_ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {k: sorted(v) for k, v in near.items()}


def frames(spark, seed=3):
    rows = some_graph(seed)
    near = undirected(rows)
    rng = np.random.default_rng(seed)
    v = {x: y / np.linalg.norm(y) for x, y in zip(sorted(near), rng.normal(size=(len(near), 4)), strict=True)}
    simple = spark.createDataFrame(rows, "src long, dst long, relation string, iter long, seq long")
    vectors = spark.createDataFrame([(x, y.tolist()) for x, y in v.items()], "id long, v array<double>")
    member = spark.createDataFrame([(x, x % 4) for x in near], "id long, module long")
    degree = {x: sum((a == x) + (b == x) for a, b, *_ in rows) for x in near}
    cents = {x: (float(degree[x]), (x * 7 % 11) / 100, (x * 5 % 13) / 100) for x in near}
    c = spark.createDataFrame([(x, *y) for x, y in cents.items()], "id long, degree double, pagerank double, betweenness double")
    born = {x: min(i for a, b, _, i, _ in rows if x in (a, b)) for x in near}
    return rows, near, v, simple, vectors, member, degree, cents, c, born


def test_pairs_from_both_ends(spark):
    rows, near, *_ = frames(spark)
    both = spark.createDataFrame([(a, b) for a in near for b in near[a]], "a long, b long")
    pairs = [(a, b) for a, b in itertools.combinations(sorted(near), 2) if (a * b) % 3 == 0]
    for far in (2, 5):
        got = {(r.a, r.b): r.dist for r in iterative.pair_distances(both, spark.createDataFrame(pairs, "a long, b long"), far).collect()}
        want = {(a, b): kernels.distances(near, a)[b] for a, b in pairs if 0 < kernels.distances(near, a).get(b, 99) <= far}
        assert got == want


def test_distant_paths(spark):
    rows, near, v, simple, vectors, member, degree, *_ = frames(spark)
    centre = np.mean(list(v.values()), axis=0)
    far = sorted(v, key=lambda x: (-(1 - v[x] @ centre / np.linalg.norm(centre)), x))[:20]
    ends = list(dict.fromkeys(far + sorted(v, key=lambda x: (-degree[x], x))[:200]))[:300]
    want = []
    for a, b in itertools.combinations(sorted(ends), 2):
        hops = kernels.distances(near, a).get(b, 99)
        if a % 4 != b % 4 and v[a] @ v[b] <= 0.35 and hops <= 6:
            want.append((a, b, hops, round(1 - v[a] @ v[b], 9)))
    want = sorted(want, key=lambda x: (-x[3], x[0], x[1]))[:20]
    got = evidence.distant_paths(simple, member, vectors).collect()
    assert sorted((r.source, r.target, r.hops, round(r.distance, 9)) for r in got) == sorted(want)
    for r in got:
        assert r.path[0] == r.source and r.path[-1] == r.target and len(r.path) == r.hops + 1 and r.modules == [x % 4 for x in r.path]
        assert all(y in near[x] for x, y in itertools.pairwise(r.path))


def test_hub_free_paths(spark):
    rows, near, v, simple, vectors, member, degree, cents, c, born = frames(spark)
    hubs = set(sorted(near, key=lambda x: (-degree[x], x))[:10])
    free = {x: [y for y in near[x] if y not in hubs] for x in near if x not in hubs}
    ends = sorted((x for x in near if x not in hubs), key=lambda x: (-cents[x][1], x))[:80]
    want = {}
    for a, b in itertools.combinations(sorted(ends), 2):
        hops, around = kernels.distances(near, a).get(b, 99), kernels.distances(free, a).get(b, 98)
        if a % 4 != b % 4 and hops == around and 2 <= hops <= 7:
            want[a, b] = hops
    got = evidence.hub_free_paths(simple, c, member, top=500).collect()
    assert want and {(r.source, r.target): r.hops for r in got} == want
    for r in got:
        assert not hubs & set(r.path) and all(y in near[x] for x, y in itertools.pairwise(r.path)) and len(r.path) == r.hops + 1
        assert abs(r.score - cents[r.source][1] - cents[r.target][1] - sum(cents[x][2] for x in r.path[1:-1])) < 1e-12
    best = evidence.hub_free_paths(simple, c, member, top=3).collect()
    assert sorted(r.score for r in best) == sorted(sorted((r.score for r in got), reverse=True)[:3])


def test_deep_evidence_and_epochs(spark):
    rows, near, v, simple, vectors, member, degree, cents, c, born = frames(spark)
    b = spark.createDataFrame(list(born.items()), "id long, iter long")
    q25, q75 = np.quantile(list(born.values()), [0.25, 0.75])
    hubs = sorted(near, key=lambda x: (-degree[x], x))[:10]
    plain = [x for x in near if x not in hubs]
    outside = {x: sum(y % 4 != x % 4 for y in near[x]) for x in near}
    want = {
        "hub": hubs,
        "non_hub_pagerank": sorted(plain, key=lambda x: (-cents[x][1], x))[:25],
        "non_hub_betweenness": sorted(plain, key=lambda x: (-cents[x][2], x))[:25],
        "late_degree": sorted((x for x in plain if born[x] >= q75), key=lambda x: (-degree[x], x))[:25],
        "late_pagerank": sorted((x for x in plain if born[x] >= q75), key=lambda x: (-cents[x][1], x))[:25],
        "early_degree": sorted((x for x in near if born[x] <= q25), key=lambda x: (-degree[x], x))[:20],
        "boundary": sorted((x for x in plain if outside[x]), key=lambda x: (-outside[x], -cents[x][2], -cents[x][1], x))[:30],
    }
    got = {}
    for r in sorted(evidence.deep_evidence(simple, c, member, b).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.view, []).append(r.id)
    assert got == want
    label = lambda t: "early" if t <= q25 else "middle" if t <= q75 else "late"
    counts = {}
    for s, d, r, i, _ in rows:
        key = (label(max(i, born[s], born[d])), r)
        counts[key] = counts.get(key, 0) + 1
    assert {(r.epoch, r.relation): r.n for r in evidence.epoch_relations(simple, b).collect()} == counts
    names = spark.createDataFrame([(x, f"Word{x % 3} common thing") for x in near], "id long, label string")
    terms = {(r.epoch, r.term): r.n for r in evidence.epoch_terms(names, b).collect()}
    assert sum(n for (_, t), n in terms.items() if t == "common") == len(near)


def test_analogies(spark):
    rows, near, v, simple, vectors, *_ = frames(spark, 5)
    edge = {(a, b): (r, s) for a, b, r, _, s in rows}
    paths = {}
    for (a, b), (r1, s1) in edge.items():
        for (b2, c), (r2, s2) in edge.items():
            if b2 == b and c != a:
                paths.setdefault((r1, r2), []).append((s1, s2, a, b, c))
    unit = lambda x: x / np.linalg.norm(x)
    want = {}
    for key, found in paths.items():
        found = [p[2:] for p in sorted(found)[:12]]
        for x, y in itertools.combinations(found, 2):
            if not set(x) & set(y):
                par = 0.5 * sum(unit(v[x[k + 1]] - v[x[k]]) @ unit(v[y[k + 1]] - v[y[k]]) for k in (0, 1))
                nov = 1 - max(v[x[0]] @ v[y[0]], v[x[2]] @ v[y[2]])
                want[(*key, *x, *y)] = (round(par, 9), round(nov, 9), round(par * max(0, nov), 9))
    got = {tuple(r)[:8]: tuple(round(x, 9) + 0.0 for x in tuple(r)[8:]) for r in evidence.analogies(simple, vectors, 12).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def state(spark, fanout=4, few=False):
    rows, near, v, simple, vectors, _, degree, cents, c, born = frames(spark)
    vectors = vectors.where("id < 2") if few else vectors
    d = spark.createDataFrame([(x, degree[x], x) for x in near], "id long, degree long, seq long")
    new = spark.createDataFrame([(9, 1), (4, 0), (6, 2)], "id long, seq long")
    queried = spark.createDataFrame([(x,) for x in near if x % 3 == 0], "id long")
    return rows, near, v, degree, cents, growth.State(d, simple, vectors, new, queried, c.select("id", "betweenness"), fanout)


def named(df):
    return [(r.anchor, r.other) for r in sorted(df.collect(), key=lambda r: r["rank"])]


@pytest.mark.parametrize("fanout", [1, 4, 60])
def test_strategies(spark, fanout):
    rows, near, v, degree, cents, s = state(spark, fanout)
    assert named(growth.choose("node", s)) == [(4, None), (9, None), (6, None)][:fanout]
    linked = {frozenset(r[:2]) for r in rows}
    pairs = sorted(((v[a] @ v[b], a, b) for a, b in itertools.combinations(sorted(v), 2) if v[a] @ v[b] >= 0.55 and frozenset((a, b)) not in linked), reverse=True)
    assert named(growth.choose("edge", s)) == [(a, b) for _, a, b in pairs[:fanout]]
    fresh = [x for x in near if x % 3]
    leaves = sorted(fresh, key=lambda x: (degree[x], x))[:fanout]
    hub = sorted(fresh, key=lambda x: (-cents[x][2], x))[0]
    assert named(growth.choose("frontier", s)) == [(x, None) for x in list(dict.fromkeys([*leaves, hub]))[:fanout]]
    centre = np.mean(list(v.values()), axis=0)
    far = sorted(fresh, key=lambda x: (v[x] @ centre, x))
    assert named(growth.choose("novelty", s)) == named(growth.choose("mixed", s, 3)) == [(x, None) for x in far[:fanout]]
    apart = [(a, min((b for b in v if b != a), key=lambda b: v[a] @ v[b])) for a in far[: max(1, fanout // 2)]]
    assert named(growth.choose("leap", s)) == (apart + [(x, None) for x in far[:fanout]])[:fanout]


def test_strategies_without_vectors_or_fresh_concepts(spark):
    *_, s = state(spark, few=True)
    assert named(growth.choose("novelty", s)) == named(growth.choose("leap", s)) == [(4, None), (9, None), (6, None)]
    rows, near, v, degree, _, s = state(spark)
    all_asked = growth.State(s.degree, s.simple, s.vectors, s.new, s.degree.select("id"), None, 2)
    assert named(growth.choose("frontier", all_asked)) == [(x, None) for x in sorted(near, key=lambda x: (degree[x], x))[:2]]
    with pytest.raises(ValueError, match="unknown strategy"):
        growth.choose("guess", s)


def replay(steps, limits):
    """The loop as it runs."""
    calls = tokens = nodes = 0
    frontier, recent = 1, []
    for used, new, pushed in steps:
        calls, tokens, nodes, frontier = calls + 1, tokens + used, nodes + new, frontier + pushed - 1
        recent = [*recent, new][-limits.window :]
        stale = len(recent) == limits.window and sum(recent) < limits.min_new * limits.window
        if calls >= limits.calls or tokens >= limits.tokens or calls >= limits.iters or frontier <= 0 or stale:
            reason = "budget_calls" if calls >= limits.calls else "budget_tokens" if tokens >= limits.tokens else "max_iters" if calls >= limits.iters else "frontier_empty" if frontier <= 0 else "novelty_stop"
            return calls, tokens, frontier, nodes, reason
    return calls, tokens, frontier, nodes, None


def test_every_reason_in_batch_and_stream(spark, tmp_path):
    from weft.streaming import incremental

    rng = random.Random(1)
    limits = growth.Limits(calls=12, tokens=400, iters=10, window=3, min_new=1.0)
    early = growth.Limits(calls=9, tokens=400, iters=10, window=3, min_new=1.0)
    runs = {0: [(10, 3, 2)] * 20, 1: [(90, 3, 2)] * 20, 2: [(5, 2, 1), (5, 2, 0)], 3: [(5, 3, 2)] * 4 + [(5, 0, 2)] * 6, 4: [(1, 1, 1)] * 3}
    runs |= {10 + k: [(rng.randrange(60), rng.randrange(4), rng.randrange(3)) for _ in range(15)] for k in range(40)}
    rows = [(run, i, *s) for run, steps in runs.items() for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "run long, seq long, tokens long, new_nodes long, pushed long")
    seen = set()
    for lim in (limits, early):
        got = {r.run: tuple(r)[1:] for r in growth.stops(df, "run", "seq", lim).collect()}
        assert got == {run: replay(steps, lim) for run, steps in runs.items()}
        seen |= {x[-1] for x in got.values()}
    assert seen == {*growth.REASONS, None}
    # the stream sees the steps in three files, one a trigger: it goes on from its state
    for k in range(3):
        df.where(f"seq >= {k * 5} AND seq < {k * 5 + 5}" if k < 2 else "seq >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
    stream = incremental.source(spark, str(tmp_path / "steps"), 1)
    got = {r.run: tuple(r)[1:] for r in incremental.drained(growth.stream_stops(stream, "run", "seq", early)).collect()}
    assert got == {run: replay(steps, early) for run, steps in runs.items() if replay(steps, early)[-1]}


def test_canonical_graph_is_that_of_one_store(spark):
    rng = np.random.default_rng(2)
    concepts, edges = [], []
    for g in range(3):
        base = rng.normal(size=(5, 3))
        for i in range(20):
            concepts.append((g, i, (base[i % 5] + rng.normal(scale=0.3, size=3)).tolist(), i // 4))
        edges += [(g, int(a), int(b), "xyz"[k % 3], k // 3, k) for k, (a, b) in enumerate(rng.integers(0, 20, (30, 2)))]
    nodes_want, edges_want = [], []
    for g in range(3):
        vecs, to = {}, {}
        for gg, i, v, it in concepts:
            if gg == g:
                v = np.array(v) / np.linalg.norm(v)
                best = max(vecs, key=lambda k: (vecs[k] @ v, -k), default=None)
                if best is not None and vecs[best] @ v >= 0.9:
                    to[i] = best
                else:
                    vecs[i], to[i] = v, i
        nodes_want += [(g, k, k // 4, tuple(sorted(i for i, t in to.items() if t == k and i != k))) for k in vecs]
        store = {}
        for gg, a, b, r, it, seq in edges:
            if gg == g and to[a] != to[b]:
                store.setdefault((to[a], to[b]), (r, it, seq))
        edges_want += [(g, *k, *x) for k, x in store.items()]
    assert any(n[3] for n in nodes_want)
    c = spark.createDataFrame(concepts, "g long, k long, v array<double>, iter long")
    n, e = growth.canonical_graph(c, spark.createDataFrame(edges, "g long, src long, dst long, relation string, iter long, seq long").repartition(4), "g", "k", "v", 0.9)
    assert sorted((r.g, r.id, r.iter, tuple(r.merged)) for r in n.collect()) == sorted(nodes_want)
    assert sorted(map(tuple, e.collect())) == sorted(edges_want)
