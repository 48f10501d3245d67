"""Tables of experiments on answers: stages an answer is closest to, corruptions and what they cost, layers of divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import measures
from weft.operators.embedding import best_matches, sequential_dedup


def closest_stage(df: DataFrame, answer: str, stages: list[str]) -> DataFrame:
    """Cosine of an answer's vector with that of each stage, to six places, and the first stage of the highest."""
    out = df.select("*", *[F.round(measures.cosine(F.col(answer), F.col(s)), 6).alias(f"sim_{s}") for s in stages])
    best = F.greatest(*[F.col(f"sim_{s}") for s in stages])
    closest = F.coalesce(*[F.when(F.col(f"sim_{s}") == best, s) for s in stages])
    return out.drop(answer, *stages).withColumn("closest", closest)


def layer_summary(df: DataFrame, key: str, layer: str, value: str, early: tuple[int, int], last: int) -> DataFrame:
    """Per key: the first layer of the highest value, whether it is an early one, the value at a given layer and the mean."""
    order = F.struct(F.col(value), -F.col(layer))
    g = df.groupBy(key).agg(F.max_by(layer, order).alias("peak_layer"), F.max(F.when(F.col(layer) == last, F.col(value))).alias("last_value"), F.avg(value).alias("mean_value"))
    return g.withColumn("early_peak", F.col("peak_layer").between(*early))


def with_layer_summary(similarities: DataFrame, summary: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every row of ``similarities`` with the summary of its key, where there is one, and the gap (one less) of each similarity."""
    return similarities.join(summary, key, "left").select("*", *[(1 - F.col(c)).alias(f"{c}_gap") for c in columns])


def mean_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation of a value by group side by side, as ``value_mean`` and ``value_std``."""
    return df.groupBy(*by).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std"))


def corruption_costs(df: DataFrame, clean: str, reference: str, corrupt: dict[str, Column], patched: dict[str, Column]) -> DataFrame:
    """By corruption: means of token and mechanism F1 against the reference, of the support of its words, and of the part that patching recovers."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("corruption"), c.alias("bad"), patched[k].alias("mended")) for k, c in corrupt.items()]))
    each = df.select(F.col(clean).alias("clean"), F.col(reference).alias("reference"), kinds.alias("x")).select("clean", "reference", "x.*")
    each = each.withColumns({f"w_{c}": measures.word_set(F.col(c)) for c in ("clean", "reference", "bad", "mended")})
    each = each.withColumns({f"f_{c}": measures.token_f1(F.col(f"w_{c}"), F.col("w_reference")) for c in ("clean", "bad", "mended")})
    scores = {
        "token": F.col("f_bad"),
        "mechanism": measures.mechanism_f1(F.col("bad"), F.col("reference")),
        "support": measures.graph_support(F.col("bad"), F.col("reference")),
        "recovery": measures.recovery(F.col("f_clean"), F.col("f_bad"), F.col("f_mended")),
    }
    return each.groupBy("corruption").agg(F.count("*").alias("n"), *[F.avg(c).alias(name) for name, c in scores.items()])


def distinct_count(df: DataFrame, by: str, order: str, vector: str, threshold: float = 0.85) -> DataFrame:
    """Per group, how many vectors stay when each in order joins an earlier kept one at the threshold or more."""
    kept = sequential_dedup(df, by, order, vector, threshold)
    return kept.groupBy(by).agg(F.count_if(F.col("id") == F.col("merged_into")).alias("distinct"), F.count("*").alias("n"))


def incorporation(ideas: DataFrame, concepts: DataFrame, by: str) -> DataFrame:
    """Per group of ideas (id, group, v), the mean of the highest cosine to the concepts (id, v) that were given."""
    given = concepts.select((-F.col("id") - 1).alias("id"), F.lit(0.0).alias("ord"), "v")  # concepts have ids of their own
    best = best_matches(ideas.select("id", F.lit(0.0).alias("ord"), "v"), given, lambda a, b: (a == a) & (b == b))
    return ideas.select("id", by).join(best, "id").groupBy(by).agg(F.avg("similarity").alias("incorporation"))
