"""Vector links against brute force."""

import pickle

import numpy as np
import pandas as pd
import pytest

from weft.llm import vector_links


def brute(rows, least):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(x, float) / np.abs(x).max() for x in (rows[i][1], rows[j][1]))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i].add(j)
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in links[i])], key=lambda k: rows[k][0]) for i in range(n)]
    return [(r[0], len(links[i]), rows[label[i]][0], rows[label[i]][0] == r[0]) for i, r in enumerate(rows)]


def rows():
    rng = np.random.default_rng(2)
    out = []
    for k in range(60):
        base = rng.normal(size=16)
        for _ in range(1 + 3 * (k % 4 == 0)):
            out.append([float(np.float32(x)) for x in base + rng.normal(scale=0.12, size=16)])
    base = rng.normal(size=16)
    out += [[float(np.float32(x)) for x in base + rng.normal(scale=0.05, size=16)] for _ in range(90)]
    out += [out[3], out[3], None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [3.0]]
    out += [[1e-200, 1e-200, 0.0, 0.0, 0.0], [1e200, 1e200, 0.0, 0.0, 0.0], [1.0, 0.1, 0.0, 0.0, 0.0], [0.1, 1.0, 0.0, 0.0, 0.0], [5e-324, 0.0, 0.0, 0.0, 0.0]]
    return [(1000 - i if i % 2 else i, v) for i, v in enumerate(out)]


@pytest.mark.parametrize("hot", [128, 8])
def test_against_brute_force(spark, hot):
    given = rows()
    df = spark.createDataFrame([(i, v, "x") for i, v in given], "vec_id long, embedding array<double>, n_links string")
    got = sorted(tuple(r) for r in vector_links.link_vectors(df, hot=hot, shard=64, least_shards=3).collect())
    assert got == sorted(brute(given, 0.9))


def test_recall_of_the_graph():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 64))
    x = np.concatenate([base, base[:300] + rng.normal(scale=0.2, size=(300, 64)), base[5] + rng.normal(scale=0.1, size=(400, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(len(x))]
    index = vector_links.ShardIndex(x)
    hits, _ = vector_links.range_search(index, x, 0.9)
    truth = x @ x.T >= 0.9
    found = sum(int(truth[i, h].sum()) for i, h in enumerate(hits))
    assert found >= 0.98 * truth.sum()


def test_empty_and_null_id(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_links.link_vectors(df).collect() == []
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vector_links.link_vectors(df).collect()), key=str) == [(5, 1, 5, True), (None, 1, 5, False)]


class Poor:
    """An index whose search finds only what ``sees`` names, for each beam the share of the best places it fills."""

    def __init__(self, x, sees):
        self.x, self.sees = x, sees

    def search(self, queries, beam):
        s = queries @ self.x.T
        ids = np.argsort(-s, axis=1)[:, :beam].astype(np.int32)
        ids[:, self.sees.get(beam, beam) :] = -1
        return ids, np.where(ids >= 0, np.take_along_axis(s, ids, 1), -2)


def queried(x, sees, ask):
    """Number of links by query, from the pairs and counts that the query task returns."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    blob = pickle.dumps((Poor(unit.astype(np.float32), sees), np.arange(len(x)), np.ones(len(x), int), unit))
    out = vector_links._querier(0.9, 128)(pd.DataFrame({"shard": 0, "cid": ask[0], "v": list(ask[1])}), pd.DataFrame({"shard": [0], "blob": [blob]}))
    number = dict.fromkeys(ask[0].tolist(), 0)
    for r in out.itertuples():
        number[r.a] += {0: 1, 1: r.n, 2: 0}[r.kind]
    return {k: n for k, n in number.items() if n}


def test_audit_sees_few_links_and_not_itself():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 48))
    x[1001:1010] = x[1:10] + rng.normal(scale=0.1, size=(9, 48))
    # a search that finds each vector alone, and one of other vectors that finds nothing
    alone, nothing = (dict.fromkeys((32, 64, 128, 256), n) for n in (1, 0))
    assert queried(x, alone, (np.arange(2000), x)) == dict.fromkeys([*range(1, 10), *range(1001, 1010)], 1)
    others = np.concatenate((rng.normal(size=(1, 48)), x[1012:1021] * 2, rng.normal(size=(990, 48))))
    assert queried(x, nothing, (np.arange(5000, 6000), others)) == dict.fromkeys(range(5001, 5010), 1)


@pytest.mark.parametrize("beam", [64, 128, 256])
def test_audit_at_every_beam(beam):
    rng = np.random.default_rng(8)
    base = rng.normal(size=48)
    x = np.concatenate((rng.normal(size=(1500, 48)), base + rng.normal(scale=0.1, size=(beam - 10, 48))))
    assert queried(x, {beam: beam // 2}, (np.arange(len(x)), x)) == dict.fromkeys(range(1500, len(x)), beam - 11)


def test_graphs_in_chunks_and_queries_in_blocks(monkeypatch):
    monkeypatch.setattr(vector_links, "CHUNK", 500)
    rng = np.random.default_rng(9)
    base = rng.normal(size=12)
    x = np.concatenate((rng.normal(size=(60, 12)), base + rng.normal(scale=0.1, size=(40, 12))))
    chunks = vector_links._build(pd.DataFrame({"shard": 3, "cid": np.arange(100), "n": 1, "v": list(x)}))
    assert len(chunks) > 20 and chunks.blob.map(len).max() <= 500
    rows = pd.concat([chunks, pd.DataFrame({"shard": 3, "part": -1, "cid": np.arange(100), "v": list(x)})]).assign(lane=0)
    sizes, run = [], vector_links._querier(0.9, 8)
    monkeypatch.setattr(vector_links, "_querier", lambda *_: lambda asked, graph: sizes.append(len(asked)) or run(asked, graph))
    out = pd.concat(vector_links._streamed(0.9, 8, 30)([rows.iloc[a : a + 17] for a in range(0, len(rows), 17)]))
    assert sum(sizes) == 100 and max(sizes) < 30 + 17
    number = dict.fromkeys(range(100), 0)
    for r in out.itertuples():
        number[r.a] += {0: 1, 1: r.n, 2: 0}[r.kind]
    assert number == {k: 39 if k >= 60 else 0 for k in range(100)}


def test_hits_of_hot_groups_are_not_held():
    rng = np.random.default_rng(10)
    x = rng.normal(size=16) + rng.normal(scale=0.05, size=(900, 16))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    seen = {}
    hits, exact = vector_links.range_search(Poor(unit, {}), unit, 0.9, take=lambda k, found, counted: seen.update({k: (len(found), counted)}))
    assert seen == dict.fromkeys(range(900), (900, True)) and exact.all() and not any(h is not None for h in hits)
