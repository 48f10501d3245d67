"""Deterministic order, splits, caps and round-robins by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(value: Column, seed: int = 42) -> Column:
    """sha256 of ``seed:value`` in hex: a shuffle that any engine repeats."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)


def first_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` distinct keys in hash order."""
    return df.select(key).distinct().orderBy(hash_order(F.col(key), seed), key).limit(n)


def split_by_source(df: DataFrame, source: str, n: int, seed: int = 42) -> DataFrame:
    """Add ``split``: whole sources go to validation, the first ``n`` in hash order."""
    picked = first_by_hash(df, source, n, seed).withColumn("__val", F.lit(True))
    return df.join(picked, source, "left").withColumn("split", F.when(F.col("__val"), "validation").otherwise("train")).drop("__val")


def round_robin(counts: dict[str, int], order: list[str], limit: int) -> dict[str, int]:
    """How many rows of each mode a round-robin takes: a mode that runs out leaves, and the turn goes back to the first."""
    left = {m: counts[m] for m in order if counts.get(m)}
    taken = dict.fromkeys(left, 0)
    modes, turn, total = list(left), 0, 0
    while total < limit and modes:
        mode = modes[turn % len(modes)]
        left[mode] -= 1
        taken[mode] += 1
        total += 1
        if left[mode]:
            turn += 1
        else:
            modes.remove(mode)
            turn = 0
    return taken


def balanced_cap(df: DataFrame, mode: str, key: Column, order: list[str], limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` rows, dealt over the modes in turn, each mode in hash order of ``key``.

    Only a count per mode reaches the driver.  Below the limit all rows stay.
    """
    counts = {r[0]: r[1] for r in df.groupBy(mode).count().collect()}
    if sum(counts.values()) <= limit:
        return df
    taken = round_robin(counts, order, limit)
    share = F.coalesce(*[F.when(F.col(mode) == m, n) for m, n in taken.items()], F.lit(0))
    rank = F.row_number().over(Window.partitionBy(mode).orderBy(hash_order(key, seed), key))
    # the literal bound lets each task pass on its own first rows alone
    return df.withColumn("__rank", rank).where((F.col("__rank") <= max(taken.values(), default=0)) & (F.col("__rank") <= share)).drop("__rank")


def take_ordered(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key; one pass of ``max_by``, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__s")).select(*keys, *[F.col(f"__s.{c}").alias(c) for c in rest])


def greedy_pairs(rows: list[tuple], limit: int, max_use: int) -> list[tuple]:
    """From (score, a, b, label) in descending score: pairs with unused labels and ends used at most ``max_use`` times."""
    used: dict = {}
    seen, out = set(), []
    for row in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        _, a, b, label = row
        if label in seen or used.get(a, 0) >= max_use or used.get(b, 0) >= max_use:
            continue
        out.append(row)
        seen.add(label)
        used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
        if len(out) == limit:
            break
    return out


def greedy_blocks(pairs: DataFrame, score: str, a: str, b: str, limit: int, max_use: int, block: int = 2000) -> list[tuple]:
    """``greedy_pairs`` over all of ``pairs``, each pair once; the driver reads blocks of the best that are left.

    What a block leaves out are pairs with a spent end; each block but the last yields a pick, so there are ``limit`` at most.
    """
    out: list[tuple] = []
    used: dict = {}
    rest = pairs.select(score, a, b)
    while True:
        spent = [x for x, n in used.items() if n >= max_use]
        left = rest.where(~F.col(a).isin(spent) & ~F.col(b).isin(spent)) if spent else rest
        rows = [tuple(r) for r in left.orderBy(F.desc(score), a, b).limit(block).collect()]
        for s, x, y in rows:
            if used.get(x, 0) < max_use and used.get(y, 0) < max_use:
                out.append((s, x, y, (x, y)))
                used[x], used[y] = used.get(x, 0) + 1, used.get(y, 0) + 1
                if len(out) == limit:
                    return out
        if len(rows) < block:
            return out
        s, x, y = rows[-1]
        later = (F.col(a) > x) | ((F.col(a) == x) & (F.col(b) > y))
        rest = rest.where((F.col(score) < s) | ((F.col(score) == s) & later))
