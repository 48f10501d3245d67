"""Embedding operators: spread, novelty, similarity joins, deduplication, null models.

Means over all pairs come from sums over one pass: for unit vectors the sum of all
dot products is (|sum v|^2 - n) / 2.  Joins that need a dot product per pair run in
numpy blocks: both sides are dealt into blocks, and each pair of blocks is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in a block of a similarity join.
BLOCK = 4096


def moments(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Per group and dimension: n, sum and sum of squares."""
    e = df.select(*by, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return e.groupBy(*by, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))


def spread(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Per group: n, mean pairwise distance of unit vectors, and the sum of variances (ddof 1 and 0)."""
    m = moments(df, by, vector)
    g = m.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"))
    dev = F.col("q") - F.col("ss") / F.col("n")
    more = F.col("n") > 1
    return g.select(*by, "n", F.when(more, 1 - (F.col("ss") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("mean_distance"), F.when(more, dev / (F.col("n") - 1)).otherwise(0.0).alias("spread_sample"), (dev / F.col("n")).alias("spread_population"))


def best_matches(left: DataFrame, right: DataFrame, condition, schema_keys: tuple[str, str] = ("id", "ord")) -> DataFrame:
    """(id, best, similarity): for every left row the most similar right row that ``condition(left ord, right ord)`` allows.

    Both sides have id long, ord double, v array<float> of unit length.  Blocks by
    hash; a task holds two blocks; partial maxima are merged by a grouped maximum,
    ties to the smaller id.  Left rows without any allowed partner are absent.
    """
    n_left, n_right = (max(1, -(-x.count() // BLOCK)) for x in (left, right))
    a = left.select("id", "ord", "v", F.pmod(F.xxhash64("id"), F.lit(n_left)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_right - 1).cast("long"))).alias("j"))
    b = right.select("id", "ord", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("id"), F.lit(n_right)).alias("j"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = {"id": [], "best": [], "similarity": []}
        if len(x) and len(y):
            y = y.sort_values("id")
            right_v, right_o, right_id = np.stack(y.v).astype(float), y.ord.to_numpy(), y.id.to_numpy()
            for a in range(0, len(x), 512):
                part = x.iloc[a : a + 512]
                s = np.stack(part.v).astype(float) @ right_v.T
                ok = condition(part.ord.to_numpy()[:, None], right_o[None, :]) & (part.id.to_numpy()[:, None] != right_id[None, :])
                s = np.where(ok, s, -np.inf)
                k = s.argmax(1)
                have = np.isfinite(s[np.arange(len(part)), k])
                out["id"].extend(part.id.to_numpy()[have])
                out["best"].extend(right_id[k[have]])
                out["similarity"].extend(s[np.arange(len(part)), k][have])
        return pd.DataFrame(out).astype({"id": "int64", "best": "int64", "similarity": "float64"})

    parts = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(best, "id long, best long, similarity double")
    top = F.max(F.struct("similarity", (-F.col("best")).alias("m"))).alias("t")
    return parts.groupBy("id").agg(top).select("id", (-F.col("t.m")).alias("best"), F.col("t.similarity").alias("similarity"))


def pairs_above(df: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) for pairs a < b of unit vectors with a dot product of ``least`` or more, block by block."""
    n = max(1, -(-df.count() // BLOCK))
    own = df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).alias("own"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    dealt = dealt.select("id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf.i.iloc[0], pdf.j.iloc[0]
        x, y = pdf[pdf.own == i], pdf[pdf.own == j]
        out = []
        if len(x) and len(y):
            v = np.stack(y.v).astype(float)
            ids, other = x.id.to_numpy(), y.id.to_numpy()
            for a in range(0, len(x), 512):
                s = np.stack(x.v.iloc[a : a + 512]).astype(float) @ v.T
                p, q = np.nonzero(s >= least)
                keep = ids[a + p] < other[q] if i == j else ids[a + p] != other[q]
                p, q = p[keep], q[keep]
                out.append(pd.DataFrame({"a": np.minimum(ids[a + p], other[q]), "b": np.maximum(ids[a + p], other[q]), "similarity": s[p, q]}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    return dealt.groupBy("i", "j").applyInPandas(find, "a long, b long, similarity double")


def sequential_dedup(df: DataFrame, by: str, order: str, vector: str, threshold: float) -> DataFrame:
    """(group, id, merged_into, similarity): in arrival order a vector joins the best earlier kept one at the threshold or more, else it is kept.

    Order decides the result, so a group is one task; its kept vectors are a matrix.
    """
    kind = dict(df.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        kept, ids, out = np.zeros((16, len(pdf[vector].iloc[0]))), [], []
        for i, v in zip(pdf[order].tolist(), pdf[vector], strict=True):
            v = np.asarray(v, float)
            v = v / max(np.linalg.norm(v), 1e-9)
            s = kept[: len(ids)] @ v
            k = int(s.argmax()) if len(ids) else -1
            if k >= 0 and s[k] >= threshold:
                out.append((i, ids[k], float(s[k])))
            else:
                if len(ids) == len(kept):
                    kept = np.concatenate([kept, np.zeros_like(kept)])  # twice the room, so that a row is moved once or twice in all
                kept[len(ids)] = v
                ids.append(i)
                out.append((i, i, 1.0))
        done = pd.DataFrame(out, columns=["id", "merged_into", "similarity"])
        done.insert(0, by, pdf[by].iloc[0])
        return done

    return df.select(by, order, vector).groupBy(by).applyInPandas(run, f"{by} {kind}, id long, merged_into long, similarity double")


def arrival_novelty(df: DataFrame, by: str, order: str, vector: str) -> DataFrame:
    """1 - cosine with the mean of all earlier arrivals of the group; running sums per dimension, first arrival null."""
    from pyspark.sql import Window

    e = df.select(by, order, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    w = Window.partitionBy(by, "dim").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    r = e.withColumn("c", F.sum("x").over(w)).groupBy(by, order).agg(F.sum(F.col("x") * F.col("c")).alias("xc"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    return r.select(by, order, F.when(F.col("cc") > 0, 1 - F.col("xc") / F.sqrt(F.col("xx") * F.col("cc"))).alias("novelty"))


def per_seed(graph: DataFrame, run, first: int, last: int, schema: str) -> DataFrame:
    """``run(table, seeds)`` -> batches of ``schema``: every task gets all of one graph, as an Arrow table, and its share of the seeds.

    The rows are dealt to the tasks by a shuffle, so the driver sees none; a graph must fit a task.
    """
    spark = graph.sparkSession
    tasks = max(1, min(spark.sparkContext.defaultParallelism, last + 1 - first))
    names = graph.columns
    copies = graph.withColumn("__task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    asked = spark.range(first, last + 1).select(F.col("id").alias("__seed"), F.pmod("id", F.lit(tasks)).cast("int").alias("__task"))
    dealt = copies.unionByName(asked, allowMissingColumns=True).repartitionById(tasks, "__task")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seeds = [], []
        for batch in batches:
            seed = batch.column("__seed")
            parts.append(batch.select(names).filter(seed.is_null()))
            seeds += seed.drop_null().to_pylist()
        if seeds:
            table = pa.Table.from_batches(parts)
            parts.clear()
            yield from run(table, sorted(seeds))

    return dealt.select(*names, "__seed").mapInArrow(each, schema)


def permutation_z(graph: DataFrame, prepare, statistic, seeds: int, two_sided: bool = False) -> DataFrame:
    """Observed statistic, null mean and deviation, z and the empirical p, with one task per block of seeds.

    ``graph`` goes to the tasks as ``per_seed`` says; ``statistic(prepare(table), rng)`` gives a draw, without rng the
    observed value.  A seed whose statistic is None does not count.  A two-sided p is twice the smaller one.
    """

    def run(table: pa.Table, mine: list[int]) -> Iterator[pa.RecordBatch]:
        given = prepare(table)
        del table
        for s in mine:
            found = statistic(given, None if s == 0 else np.random.default_rng(s))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([None if found is None else float(found)], pa.float64())], ["seed", "value"])

    out = per_seed(graph, run, 0, seeds, "seed long, value double")
    null = F.col("seed") > 0
    g = out.agg(F.max(F.when(~null, F.col("value"))).alias("observed"), F.avg(F.when(null, F.col("value"))).alias("null_mean"), F.stddev_pop(F.when(null, F.col("value"))).alias("null_sd"), F.array_agg(F.when(null, F.col("value"))).alias("nulls"))
    above = F.size(F.filter("nulls", lambda v: v >= F.col("observed")))
    if two_sided:
        above = F.least(above, F.size(F.filter("nulls", lambda v: v <= F.col("observed"))))
    return g.select("observed", "null_mean", "null_sd", ((F.col("observed") - F.col("null_mean")) / F.coalesce(F.nullif("null_sd", F.lit(0.0)), F.lit(1.0))).alias("z"), ((2 if two_sided else 1) * (1 + above) / (1 + F.size("nulls"))).alias("p"))


def numbered_ends(table: pa.Table, left: str, right: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, both ends of every link as numbers of ids, and the rows' order by them: the same whatever order the rows came in."""
    u, v = (table.column(c).to_numpy() for c in (left, right))
    ids = np.unique(np.concatenate((np.unique(u), np.unique(v))))
    a, b = (np.searchsorted(ids, x).astype(np.int32) for x in (u, v))
    order = np.argsort(a * np.int64(len(ids)) + b)
    return ids, a[order], b[order], order


def swapped_edges(left: np.ndarray, right: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """2m double-edge swaps of a simple undirected graph with nodes 0.., every node keeping its degree; None if 30m tries don't give them.

    A round tries disjoint pairs of edges in a random order.  New edges must be no loops, differ from each other and from
    all edges at the round's start.
    """
    a, b, m, done = left.astype(np.int32), right.astype(np.int32), len(left), 0
    n = np.int64(max(a.max(initial=0), b.max(initial=0))) + 1
    key = lambda x, y: np.minimum(x, y) * n + np.maximum(x, y)
    for _ in range(60 if m > 1 else 0):
        there = np.sort(key(a, b))
        order = rng.permutation(m).astype(np.int32)
        i, j = order[: m // 2], order[m // 2 : m // 2 * 2]
        one, two = rng.random((2, len(i)), dtype=np.float32) < 0.5
        u, v = np.where(one, a[i], b[i]), np.where(one, b[i], a[i])
        x, y = np.where(two, a[j], b[j]), np.where(two, b[j], a[j])
        new = np.concatenate((key(u, x), key(v, y)))
        by = np.argsort(new)
        ordered = new[by]
        at = np.minimum(np.searchsorted(there, ordered), m - 1)
        bad = there[at] == ordered
        bad[1:] |= ordered[1:] == ordered[:-1]
        refused = np.empty(len(new), bool)
        refused[by] = bad
        ok = np.flatnonzero((u != x) & (v != y) & ~refused[: len(i)] & ~refused[len(i) :])[: 2 * m - done]
        a[i[ok]], b[i[ok]], a[j[ok]], b[j[ok]] = u[ok], x[ok], v[ok], y[ok]
        done += len(ok)
        if done == 2 * m:
            return a, b
    return None


def modularity_z(undirected: DataFrame, seeds: int, task_links: int = 2_000_000) -> DataFrame:
    """Modularity of a graph's communities against graphs with the same degrees: observed, null mean and deviation, z and p.

    Communities are found anew in every draw, by the same rule as in the graph itself.  A draw is one task's work, so the
    graph must fit one; above ``task_links`` links, which are counted first, this is an error.
    """
    from weft.operators.kernels import moved_communities

    n = undirected.count()
    if n > task_links:
        raise ValueError(f"{n} links are more than a task may hold ({task_links})")

    def prepare(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return numbered_ends(table, "u", "v")[1:3]

    def q(pair: tuple, rng: np.random.Generator | None) -> float | None:
        pair = pair if rng is None else swapped_edges(*pair, rng)
        return None if pair is None else moved_communities(*pair)[0]

    return permutation_z(undirected.select("u", "v"), prepare, q, seeds)


def motif_z(edges: DataFrame, seeds: int) -> DataFrame:
    """Number of paths a -> b -> c by their two relations, null mean and deviation, z and p when relations are permuted over the edges.

    ``edges`` (src, dst, relation), each pair once: one graph, which goes to the tasks as ``per_seed`` says.  The relations
    are a bounded kind; only they reach the driver.
    """
    relation = F.coalesce("relation", F.lit("related_to"))
    names = sorted(r[0] for r in edges.select(relation).distinct().collect())
    label = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    graph = edges.select("src", "dst", (F.array_position(label, relation) - 1).cast("int").alias("code"))
    k = len(names)

    def counts(a: np.ndarray, b: np.ndarray, by_b: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        # paths that return to their start don't count
        found, into = -np.bincount(r[i] * np.int64(k) + r[j], minlength=k * k).astype(float), r[by_b]
        step = max(1, min(n, 4_000_000 // max(k, 1)))
        for low in range(0, n, step):
            sides = []
            for x, kinds in ((b, into), (a, r)):
                s, e = np.searchsorted(x, (low, low + step))
                sides.append(np.bincount((x[s:e] - low) * np.int64(k) + kinds[s:e], minlength=step * k).reshape(step, k))
            found += (sides[0].astype(float).T @ sides[1]).ravel()
        return found

    def run(table: pa.Table, mine: list[int]) -> Iterator[pa.RecordBatch]:
        ids, a, b, order = numbered_ends(table, "src", "dst")
        r, n = table.column("code").to_numpy()[order], len(ids)
        del table, order
        there, back = a * np.int64(n) + b, b * np.int64(n) + a  # the first is in order
        j = np.minimum(np.searchsorted(there, back), len(there) - 1)
        i = np.flatnonzero(there[j] == back)
        j = j[i]
        del there, back
        by_b = np.argsort(b, kind="stable")
        b = b[by_b]
        real = counts(a, b, by_b, r, i, j, n)
        at = np.flatnonzero(real)
        for s in mine:
            null = counts(a, b, by_b, np.random.default_rng(s).permutation(r), i, j, n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((at // k).astype(np.int32), (at % k).astype(np.int32), real[at].astype(np.int64), null[at])], ["x", "y", "observed", "v"])

    v = per_seed(graph, run, 1, seeds, "x int, y int, observed long, v double")
    g = v.groupBy("x", "y", "observed").agg(F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_sd"), F.count_if(F.col("v") >= F.col("observed")).alias("above"), F.count("*").alias("n"))
    z = (F.col("observed") - F.col("null_mean")) / F.coalesce(F.nullif("null_sd", F.lit(0.0)), F.lit(1.0))
    return g.select(F.get(label, F.col("x")).alias("r1"), F.get(label, F.col("y")).alias("r2"), "observed", "null_mean", "null_sd", z.alias("z"), ((1 + F.col("above")) / (1 + F.col("n"))).alias("p"))


def rank_sum(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mann-Whitney U of the rows with ``group`` true against the others, with average ranks and the tie-corrected normal z.

    Equal values are counted first; the running count over distinct values goes by ranges of values.
    """
    from weft.operators.ordering import running_sums

    c = df.groupBy(value).agg(F.count_if(group).alias("a"), F.count_if(~F.col(group)).alias("b")).withColumn("t", F.col("a") + F.col("b"))
    t = F.col("t")
    r = running_sums(c, [value], ["t"])
    g = r.agg(F.sum(F.col("a") * (F.col("t_before") + (t + 1) / 2)).alias("ranks"), F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("ranks") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    return g.select("n1", "n2", u.alias("u"), ((u - n1 * n2 / 2) / F.sqrt(var)).alias("z"))


def unit_column(v: Column) -> Column:
    """Unit vector as array<double>."""
    from weft.functions.measures import unit

    return unit(v)
