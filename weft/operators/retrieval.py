"""Graph search and retrieval: keyword and semantic search, concept resolution, ranking of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_score(label: Column, query: str) -> Column:
    """Number of query words in the label, two more for the whole phrase."""
    low = F.lower(label)
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in query.lower().split()), F.lit(0))
    return hits + 2 * F.contains(low, F.lit(query.lower())).cast("int")


def search(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Nodes (id, label, degree, rank) that hit: hits + ln(1 + degree) + 10 rank, best first, ties by id."""
    hits = keyword_score(F.col("label"), query)
    score = hits + F.log1p("degree") + 10 * F.col("rank")
    return nodes.withColumn("hits", hits).where("hits > 0").withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)


def semantic_top(nodes: DataFrame, query: list[float], limit: int) -> DataFrame:
    """Nodes (id, v, degree) by 100 + 25 similarity + ln(1 + degree), ties by id."""
    from weft.functions.measures import dot

    sim = dot(F.col("v"), F.array(*map(F.lit, query)))
    return nodes.withColumn("similarity", sim).withColumn("score", 100 + 25 * F.col("similarity") + F.log1p("degree")).orderBy(F.desc("score"), "id").limit(limit)


def merge_hits(keyword: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """Both searches by the better score."""
    return keyword.select("id", "score").union(semantic.select("id", "score")).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def resolve_concepts(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(text, id): the node with that id, else with that label whatever the case (the smallest id)."""
    ids = nodes.select(F.col("id").cast("string").alias("text"), F.col("id").alias("by_id"))
    labels = nodes.groupBy(F.lower("label").alias("low")).agg(F.min("id").alias("by_label"))
    out = asked.join(ids, "text", "left").join(labels, F.lower("text") == F.col("low"), "left")
    return out.select("text", F.coalesce("by_id", "by_label").alias("id"))


def rank_context(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Sum of (id, score) contributions with the set of their sources."""
    rows = None
    for name, df in parts:
        one = df.select("id", F.col("score").cast("double").alias("score"), F.lit(name).alias("source"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("id").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def truncated(members: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` of (id, degree, seed): seeds first, then by degree."""
    return members.orderBy(F.desc("seed"), F.desc("degree"), "id").limit(limit)


def lead_score(similarity: Column, ood: Column, relation: Column, hops: Column, degree: Column, max_degree: Column) -> Column:
    """Score of a retrieval lead; hubs pay for their degree."""
    return 0.35 * similarity + 0.30 * ood + 0.25 * relation + 0.10 / (1 + hops) - 0.20 * F.log1p(degree) / F.greatest(F.lit(1e-9), F.log1p(max_degree))
