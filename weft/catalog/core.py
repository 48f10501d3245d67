"""Registry of queries and the derived tables that stand in for trace and graph inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The completion modes in the order that reports and round-robins use.
MODES = ["prior_empty", "fixed_nodes_only", "missing_edges", "partial_subgraph", "wrong_relations", "extra_edges"]


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with its DuckDB SQL if there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MODE_SQL = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODES)) + " END"

#: Predictions: one per order; the customer is the source, the order the variant.
PRED_SQL = f"""pred AS (SELECT o_custkey::VARCHAR AS source_index, o_orderkey::VARCHAR AS variant_index, {MODE_SQL} AS mode, o_totalprice / 500000.0 AS value,
  CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice / 100)::BIGINT END AS tokens, CASE o_orderstatus WHEN 'F' THEN 'stop' WHEN 'O' THEN 'length' END AS finish,
  o_orderstatus <> 'P' AS valid, o_orderkey AS pos FROM orders)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions, as PRED_SQL."""
    o = table(spark, sf_dir, "orders")
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select(
        F.col("o_custkey").cast("string").alias("source_index"),
        F.col("o_orderkey").cast("string").alias("variant_index"),
        mode.alias("mode"),
        (F.col("o_totalprice") / 500000.0).alias("value"),
        F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_totalprice") / 100)).alias("tokens"),
        F.when(F.col("o_orderstatus") == "F", "stop").when(F.col("o_orderstatus") == "O", "length").alias("finish"),
        (F.col("o_orderstatus") != "P").alias("valid"),
        F.col("o_orderkey").alias("pos"),
    )


#: Concept graph: customers whose orders follow each other on a day; iter is the month, depth the place in the day.
EDGE_SQL = """edge AS (SELECT src, dst, relation, iter, depth, seq FROM (SELECT o_custkey AS src, lead(o_custkey) OVER w AS dst, o_orderpriority AS relation,
  ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::BIGINT AS iter, (row_number() OVER w)::BIGINT AS depth, o_orderkey AS seq
  FROM orders WINDOW w AS (PARTITION BY o_orderdate ORDER BY o_orderkey)) WHERE dst IS NOT NULL),
node AS (SELECT id, min(iter) AS iter, min(depth) AS depth FROM (SELECT src AS id, iter, depth FROM edge UNION ALL SELECT dst, iter, depth FROM edge) GROUP BY id),
simple AS (SELECT src, dst, count(*) AS multiplicity, arg_min(relation, seq) AS relation, min(iter) AS iter, min(seq) AS seq FROM edge WHERE src <> dst GROUP BY src, dst),
link AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM simple),
both_ AS (SELECT u AS a, v AS b FROM link UNION ALL SELECT v, u FROM link),
deg AS (SELECT a AS id, count(*) AS d FROM both_ GROUP BY a)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept edges with repeats, as EDGE_SQL's edge."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("src"),
        F.lead("o_custkey").over(w).alias("dst"),
        F.col("o_orderpriority").alias("relation"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("long").alias("iter"),
        F.row_number().over(w).cast("long").alias("depth"),
        F.col("o_orderkey").alias("seq"),
    )
    return o.where("dst IS NOT NULL")


#: Small graphs, one a user: event types that follow each other.
SESSION_SQL = """step AS (SELECT user_id AS graph_id, event_type AS src, lead(event_type) OVER w AS dst, lead(event_id) OVER w AS seq, CASE WHEN value < 5 THEN 'low' WHEN value < 15 THEN 'mid' ELSE 'high' END AS relation
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
hop AS (SELECT graph_id, src, dst, count(*) AS n, min(seq) AS seq, arg_min(relation, seq) AS relation FROM step WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2, 3)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple edges of every user's small graph, as SESSION_SQL's hop."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    band = F.when(F.col("value") < 5, "low").when(F.col("value") < 15, "mid").otherwise("high")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("graph_id"), F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), F.lead("event_id").over(w).alias("seq"), band.alias("relation"))
    return e.where("dst IS NOT NULL AND src <> dst").groupBy("graph_id", "src", "dst").agg(F.count("*").alias("n"), F.min("seq").alias("seq"), F.min_by("relation", "seq").alias("relation"))
