"""Linear probes: a logistic model for every group (a layer, a position) at once.

Features are standardised per group, the weights have a ridge, the intercept none, and
Newton's method fits all groups together: in a round each task sums gradient and Hessian
of its rows per group, one task per group adds these blocks and takes the step.  Only
the largest change reaches the driver.  A group's Hessian of (d + 1)^2 numbers has to fit
into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.ordering import running_sums
from weft.shared import remove, written


def _scaled(rows: DataFrame, group: str) -> DataFrame:
    """(group, y, x): features less their mean over their standard deviation (ddof 0; 1 where they don't vary)."""
    e = rows.select(group, F.posexplode("x").alias("i", "v"))
    m = e.groupBy(group, "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    listed = m.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("__s"))
    return rows.join(listed, group).select(group, "y", F.zip_with("x", "__s", lambda x, s: (x - s["m"]) / s["s"]).alias("x"))


def probes(rows: DataFrame, group: str, label: str, vector: str, c: float = 1.0, max_rounds: int = 40, tolerance: float = 1e-8) -> DataFrame:
    """(group, n, accuracy, auroc, f1) of every group with both labels, scored on the rows it was fitted to.

    Rows whose label is not 0 or 1 or whose vector is null take no part; the loss is that of ``c`` times the
    log loss plus half the squared weights.
    """
    given = rows.select(group, F.col(label).cast("int").alias("y"), F.col(vector).cast("array<double>").alias("x")).where(F.col("y").isin(0, 1) & F.col("x").isNotNull())
    both = given.groupBy(group).agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.max(F.size("x")).alias("d")).where("ones > 0 AND ones < n")
    data = written(_scaled(given.join(both.select(group), group), group), "scaled")
    weights = written(both.select(group, F.array_repeat(F.lit(0.0), F.col("d") + 1).alias("w"), F.lit(0.0).alias("change")), "weights")
    kind = dict(rows.dtypes)[group]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(group, sort=False):
                x = np.column_stack([np.stack(part.x.to_numpy()), np.ones(len(part))])
                p = 1 / (1 + np.exp(-(x @ part.w.iloc[0])))
                g, h = c * x.T @ (p - part.y.to_numpy()), c * (x * (p * (1 - p))[:, None]).T @ x
                old = held.get(key)
                held[key] = (g, h) if old is None else (old[0] + g, old[1] + h)
        if held:  # an empty frame has no lists to make columns of
            yield pd.DataFrame({group: list(held), "g": [g.tolist() for g, _ in held.values()], "h": [h.ravel().tolist() for _, h in held.values()]})

    def step(blocks: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        w = np.array(old.w.iloc[0])
        d = len(w)
        ridge = np.append(np.ones(d - 1), 0.0)
        g = np.sum(np.stack(blocks.g.to_numpy()), 0) + ridge * w
        h = np.sum(np.stack(blocks.h.to_numpy()), 0).reshape(d, d) + np.diag(ridge + 1e-12)
        move = np.linalg.solve(h, g)
        return pd.DataFrame({group: [old[group].iloc[0]], "w": [(w - move).tolist()], "change": [float(np.abs(move).max())]})

    for _ in range(max_rounds):
        blocks = data.join(weights.select(group, "w"), group).mapInPandas(sums, f"{group} {kind}, g array<double>, h array<double>")
        after = written(blocks.groupBy(group).cogroup(weights.groupBy(group)).applyInPandas(step, f"{group} {kind}, w array<double>, change double"), "weights")
        remove(weights)
        weights = after
        if (weights.agg(F.max("change")).first()[0] or 0.0) < tolerance:
            break
    score = F.aggregate(F.zip_with("x", F.slice("w", 1, F.size("x")), lambda x, w: x * w), F.element_at("w", -1), lambda s, x: s + x)
    scored = written(data.join(weights.select(group, "w"), group).select(group, "y", score.alias("s")), "scored")
    hit = (F.col("s") > 0).cast("int")
    told = scored.groupBy(group).agg(F.count("*").alias("n"), F.avg((hit == F.col("y")).cast("double")).alias("accuracy"), F.sum(hit * F.col("y")).alias("tp"), F.sum(hit).alias("told"), F.sum("y").alias("ones"))
    told = told.withColumn("f1", F.when(F.col("told") + F.col("ones") > 0, 2 * F.col("tp") / (F.col("told") + F.col("ones"))).otherwise(0.0))
    return told.join(auroc(scored, group, "s", "y"), group).select(group, "n", "accuracy", "auroc", "f1")


def auroc(rows: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """(group, auroc): share of (one, zero) pairs in order, ties half; from running counts over the distinct scores of all groups."""
    counts = rows.groupBy(group, score).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    ranked = running_sums(counts, [group, score], ["neg"])
    g = ranked.groupBy(group).agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.min("neg_before").alias("first"))
    return g.select(group, ((F.col("u") - F.col("p") * F.col("first")) / (F.col("p") * F.col("q"))).alias("auroc"))
