"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import hard_negatives
from weft.llm.hard_negatives import NONE, BallTree


def brute(rows, every=5, positives=5, negatives=3):
    """Plain loops over rows (vec_id, vector, label)."""
    ok = [(i, [int(np.floor(256.0 * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) and abs(x) < 1e5 for x in v)]
    out = []
    for a, (i, v, y) in enumerate(ok):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, b, z) for b, (j, w, z) in enumerate(ok) if b != a and len(w) == len(v))
        for s, j, _, _ in [x for x in scored if x[3] == y][:positives]:
            fit = [x for x in scored if x[3] != y and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit[:negatives])]
    return sorted(out)


def given():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(420):
        v = centres[i % 6] + rng.normal(scale=0.4, size=8)
        rows.append((i - 20, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))))
    same = rows[7][1]
    rows += [(1000 + i, same, 1) for i in range(60)]  # a hot vector: more copies than any list is long
    rows += [(2000 + i, same, 2) for i in range(3)]
    rows += [rows[20], rows[20], (25, rows[30][1], 3)]  # repeated rows, a repeated id
    rows += [(3000, None, 1), (3005, [], 1), (3010, [], 1), (3011, [], 2), (3015, [1.0, None] + [0.0] * 6, 1), (3020, [float("nan")] * 8, 1), (3025, [float("inf")] * 8, 2), (None, rows[3][1], 1), (3030, rows[3][1], None)]
    rows += [(3035, [1.0, 2.0], 1), (3036, [1.0, 2.5], 1), (3037, [0.8, 1.6], 2), (3040, [0.0] * 8, 1), (3041, [0.0] * 8, 2), (3045, [1e200] * 8, 1)]
    return rows


@pytest.mark.parametrize(("part", "block"), [(65_536, 8192), (64, 16)])
def test_against_brute_force(spark, part, block):
    df = spark.createDataFrame([(*r, "x", 1) for r in given()], "vec_id long, embedding array<double>, label int, rank string, key int")
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0, part=part, least_parts=5, block=block)
    assert sorted(map(tuple, got.collect())) == brute(given())


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(df, F.col("vec_id") % 5 == 0).collect() == []


def test_shares_are_exact(spark):
    values = [0, 1, 2, 99, 100, 101, 199, 12345678901234567, 2**58]
    df = spark.createDataFrame([(v,) for v in values], "p long")
    got = df.select("p", hard_negatives._share(F.col("p"), 95).alias("high"), (-hard_negatives._share(-F.col("p"), 50)).alias("low")).collect()
    assert [(r.high, r.low) for r in got] == [(r.p * 95 // 100, -(-r.p * 50 // 100)) for r in got]


def test_longs_where_doubles_do_not_hold_the_products():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**26), 2**26, size=(300, 16)).astype(float)
    labels = rng.integers(0, 3, 300)
    tree = BallTree(x, labels, 8)
    ends = np.iinfo(np.int64)
    score, place = tree.search(x[:20], labels[:20], np.full(20, ends.min + 1), np.full(20, ends.max), 4, True)
    exact = x.astype(np.int64) @ x[:20].astype(np.int64).T
    for i in range(20):
        want = sorted((-int(exact[j, i]), j) for j in range(300) if labels[j] == labels[i])[:4]
        assert [(-int(s), int(p)) for s, p in zip(score[i], place[i], strict=True)] == want


def test_bounds_leave_nodes_out():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(scale=0.05, size=(400, 8)) + 3 * c for c in rng.normal(size=(12, 8))]))
    labels = np.repeat(np.arange(12) % 3, 400)
    tree = BallTree(x, labels, 16)
    read = []
    rows = tree.x

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                read.append(at)
            return np.asarray(self)[at]

    tree.x = rows.view(Counted)
    score, _ = tree.search(x[:50], labels[:50], np.full(50, NONE + 1), np.full(50, -(NONE + 1)), 5, True)
    assert (score > NONE).all() and len(read) < 0.2 * len(tree.leaves())
