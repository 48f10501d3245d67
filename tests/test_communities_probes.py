"""Communities against plain greedy merging, probes against a plain fit, places and running sums against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import communities, embedding, kernels, ordering, probes


def modularity(edges, member):
    m, inside, volume = len(edges), {}, {}
    for u, v in edges:
        for x in (u, v):
            volume[member[x]] = volume.get(member[x], 0) + 1
        inside[member[u]] = inside.get(member[u], 0) + (member[u] == member[v])
    return sum(inside.get(c, 0) / m - (volume[c] / (2 * m)) ** 2 for c in volume)


def graphs():
    rng = random.Random(1)
    planted = {(i, j) for i in range(120) for j in range(i + 1, 120) if rng.random() < (0.3 if i // 20 == j // 20 else 0.015)}
    hub = {(0, i) for i in range(1, 60)} | {(100 + i, 101 + i) for i in range(30)}  # a hub and, apart from it, a path
    rand = {tuple(sorted(rng.sample(range(150), 2))) for _ in range(400)}
    return {"planted": planted, "hub": hub, "random": rand}


@pytest.mark.parametrize("name", ["planted", "hub", "random"])
def test_modularity_near_plain_greedy(spark, name):
    edges = sorted(graphs()[name])
    found = {r.id: r.module for r in communities.communities(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(found) == {x for e in edges for x in e}
    plain = dict(kernels.communities([(a, b, "") for a, b in edges]))
    assert modularity(edges, found) >= 0.95 * modularity(edges, plain)
    sizes = [sum(m == k for m in found.values()) for k in range(max(found.values()) + 1)]
    assert sizes == sorted(sizes, reverse=True) and min(sizes) > 0
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for module in set(found.values()):  # no module joins two components
        nodes = {x for x, m in found.items() if m == module}
        assert nodes <= set(kernels.distances({k: sorted(v) for k, v in near.items()}, min(nodes)))


def test_no_links(spark):
    assert communities.communities(spark.createDataFrame([], "u long, v long")).collect() == []


def plain_probe(x, y, c=1.0):
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(c * (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), c * x.T @ (p - y) + ridge * w)
    s = x @ w
    told = s > 0
    pairs = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    return (told == y).mean(), pairs, 2 * (told & (y == 1)).sum() / (told.sum() + y.sum())


def test_probes_equal_a_plain_fit(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for layer in range(3):
        x = rng.normal(size=(90 + 30 * layer, 5))
        x[:, 4] = 2.5  # a feature that does not vary
        y = (x[:, 0] * layer + rng.normal(size=len(x)) > 0).astype(int)
        x[:6] = x[0]  # ties
        rows += [(layer, int(b), a.tolist()) for a, b in zip(x, y, strict=True)]
        want[layer] = plain_probe(x, y)
    rows += [(7, 1, [1.0, 2.0]), (7, 1, [2.0, 2.0]), (0, None, [0.0] * 5), (0, 1, None)]  # one label only; nulls
    got = {r.layer: (r.accuracy, r.auroc, r.f1) for r in probes.probes(spark.createDataFrame(rows, "layer int, label int, v array<double>").repartition(5), "layer", "label", "v").collect()}
    assert set(got) == {0, 1, 2}
    for layer, values in want.items():
        assert np.allclose(got[layer], values, atol=1e-9)


def test_probes_with_parts_that_no_group_falls_into(spark):
    rows = [(0, i % 3 % 2, [float(i % 7), float(i % 5)]) for i in range(60)]
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}  # as on large tables: joined by shuffle, one group for four parts
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        got = probes.probes(spark.createDataFrame(rows, "layer int, label int, v array<double>"), "layer", "label", "v", max_rounds=1).collect()
    finally:
        for k in off:
            spark.conf.unset(k)
    assert [(r.layer, r.n) for r in got] == [(0, 60)]


def test_places_and_running_sums(spark):
    rng = random.Random(3)
    values = [rng.randrange(40) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(7)
    places = {r.id: r.place for r in ordering.numbered(df, [F.desc("v"), "id"], "place").collect()}
    assert places == {i: k for k, i in enumerate(sorted(range(300), key=lambda i: (-values[i], i)))}
    sums = {r.id: r.v_before for r in ordering.running_sums(df, ["id"], ["v"]).collect()}
    assert sums == {i: sum(values[:i]) for i in range(300)}
    assert ordering.numbered(df.limit(0), ["id"], "place").collect() == []


def test_rank_sum_by_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.random() < 0.4, rng.randrange(12)) for _ in range(200)]
    got = embedding.rank_sum(spark.createDataFrame(rows, "g boolean, v long"), "g", "v").first()
    ones, others = [v for g, v in rows if g], [v for g, v in rows if not g]
    assert got.u == sum((a > b) + 0.5 * (a == b) for a in ones for b in others)


@pytest.mark.parametrize("name", ["planted", "hub", "random"])
def test_local_communities_near_plain_greedy(name):
    edges = sorted(graphs()[name])
    names = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(names)}
    q, of = kernels.moved_communities(np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert abs(q - modularity(edges, {x: int(of[at[x]]) for x in names})) < 1e-9
    assert q >= 0.95 * modularity(edges, dict(kernels.communities([(a, b, "") for a, b in edges])))


def test_modularity_against_rewired_graphs(spark):
    found = {}
    for name in ("planted", "random"):
        row = embedding.modularity_z(spark.createDataFrame(sorted(graphs()[name]), "u long, v long"), 19).first()
        found[name] = row
        assert 0 < row.null_mean < 1 and row.p >= 0.05
    assert found["planted"].z > 8 and found["planted"].p == 0.05 and abs(found["random"].z) < 4
    with pytest.raises(ValueError, match="more than a task"):
        embedding.modularity_z(spark.createDataFrame([(1, 2), (2, 3)], "u long, v long"), 3, 1)
