"""A corpus pipeline of five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents it
keeps with the columns of ``docs``, the last one with tokens added.  Stages work
on whole texts and all rows; a null doc_id or text never fails a stage:

* toxicity drops what its classifier scores 0.5 or more (null text: as empty);
* line dedup rewrites ``text`` (null stays null) and ``n_chars`` where there is one;
* near-dedup keeps the smallest doc_id of each group, one row of it where that id
  is repeated in the group; rows without a doc_id stay;
* decontamination drops documents with a passage of the benchmark;
* tokens adds n_tokens, ids, ids_sha256, decoded_sha256 and exact, in place of input columns of these names.

Columns besides doc_id and text travel under numbers within a stage, so that none
of their names can clash with one that a stage makes.  Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import bpe, decontam, line_dedup, simhash, toxicity
from weft.shared import mark, remove, sweep, written

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but doc_id and text named by their place."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), modulus=5, held=0)
    own = numbered(docs)
    return toxicity.score(own, model, into="__score").where("__score < 0.5").select(*own.columns).toDF(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten documents or more share."""
    own = numbered(docs)
    found = line_dedup.dedup_lines(own, min_docs=10)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new[own.columns[docs.columns.index("n_chars")]] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new[c].alias(c) if c in new else found[c] for c in own.columns]).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    given = numbered(docs)
    groups = simhash.near_duplicates(given, shingle=4, distance=4)
    ids = groups.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows"), F.count_if(F.col("doc_id") == F.col("component_id")).alias("__first"))
    kept = written(ids.where("__first > 0").select("__kept", "__rows"), "kept")
    own = given.where("doc_id IS NOT NULL").join(kept.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__kept"))
    if kept.where("__rows > 1").limit(1).count():  # an id in several rows: each is judged by its own group, of one group one stays
        again = simhash.with_fingerprints(own.where("__rows > 1"), "__fp", shingle=4)
        first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__kept"), F.col("fp").alias("__fp"), "component").distinct()
        order = Window.partitionBy("__kept", "component").orderBy(F.xxhash64("text"), "text")
        again = again.join(first, ["__kept", "__fp"]).withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
        own = own.where("__rows = 1").select(*given.columns).union(again.select(*given.columns))
    return own.select(*given.columns).union(given.where("doc_id IS NULL")).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of ten words of the benchmark."""
    own = numbered(docs)
    found = decontam.scan(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10).where("n_hit = 0")
    return found.select(*own.columns).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the round trip of every document."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again; what a stage needed on the way is removed once it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        since = mark()
        after = written(stage(spark, docs, sf_dir), name)
        sweep(spark, since)
        if before is not None:
            remove(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
