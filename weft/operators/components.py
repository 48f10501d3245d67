"""Connected components of an edge table by alternating large-star and small-star rounds.

All state is an edge table: each task first contracts its own edges to stars,
then rounds of two grouped minima and two joins shrink the table until every
node points at its component's smallest node.  A hub costs one row per neighbour
and its joins are sort-merge joins that adaptive execution may split.  Each round
is written to the shared folder, so lineage stays short and a lost executor costs
one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.shared import remove, written

#: Nodes a task holds before it hands on its stars.
HELD = 500_000
MAX_ROUNDS = 60


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > HELD:
            yield stars()
    if parent:
        yield stars()


def _print(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return int(row.n), int(row.s)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node in an edge of ``edges`` (a long, b long), the smallest node it reaches.

    Null ends and loops link nothing; an empty table gives an empty one.
    """
    given = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    now = written(given.mapInArrow(_contract, "a long, b long").distinct(), "edges")
    before = _print(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, "edges")
        remove(now)
        now, state = after, _print(after)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
