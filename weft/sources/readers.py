"""Sources and sinks: strict and lenient JSON lines, GraphML, series, manifests, corpora, caches."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED_COLUMNS = ["source_index", "variant_index", "mode", "condition", "x0", "fixed_node_ids", "fixed_edge_keys", "x0_graph_json", "x1_graph_json"]


#: Splits in the order of their seeds.
SPLITS = ["train", "validation", "test"]


def load_completion_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Train and test splits of a folder of Parquet; a missing split or column is an error."""
    out = {}
    for split in ("train", "test"):
        df = spark.read.parquet(f"{path}/{split}")
        if missing := [c for c in REQUIRED_COLUMNS if c not in df.columns]:
            raise ValueError(f"{split}: missing columns {missing}")
        out[split] = df
    return out


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON objects, one a line; blank lines are skipped; any other line fails the job, naming file and text, and so does an empty input."""
    lines = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("file")).where(F.trim("value") != "")
    good = F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")
    message = F.concat(F.lit("not a JSON object in "), "file", F.lit(": "), F.substring("value", 1, 80))
    checked = lines.select(F.when(F.coalesce(good, F.lit(False)), F.col("value")).otherwise(F.raise_error(message).cast("string")).alias("value"))
    if not lines.limit(1).count():
        raise ValueError(f"no rows in {path}")
    return checked.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As many rows as can be read; the text of the others is in ``_bad``."""
    return spark.read.schema(schema.add("_bad", T.StringType())).option("columnNameOfCorruptRecord", "_bad").json(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files: attributes by their declared names in a map, iter and depth as numbers."""
    pairs = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_VALUE", T.StringType())]))

    def rows(tag: str, fields: list[str]) -> DataFrame:
        schema = T.StructType([*[T.StructField(f"_{f}", T.StringType()) for f in fields], T.StructField("data", pairs)])
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path).distinct()
    names = {r["_id"]: r["_attr.name"] for r in keys.collect()}  # a handful of declared attributes
    named = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]) if names else F.create_map().cast("map<string,string>")
    attrs = F.map_from_arrays(F.transform("data", lambda d: named[d._key]), F.transform("data", lambda d: d._VALUE))
    number = lambda c: F.floor(F.col("attrs")[c].try_cast("double")).cast("long").alias(c)
    nodes = rows("node", ["id"]).select(F.col("_id").alias("id"), attrs.alias("attrs")).select("id", F.coalesce(F.col("attrs")["label"], "id").alias("label"), number("iter"), number("depth"), "attrs")
    edges = rows("edge", ["source", "target"]).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attrs.alias("attrs")).select("src", "dst", F.col("attrs")["relation"].alias("relation"), number("iter"), number("depth"), "attrs")
    return nodes, edges


def newest_readable(spark: SparkSession, folder: str, reader):
    """The newest snapshot in a folder that ``reader(path)`` can read; older ones are tried in turn."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.graphml").load(folder).select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path"))
    for r in files.collect():  # file names alone
        try:
            nodes, edges = reader(r.path)
            if nodes.limit(1).count():
                return nodes, edges
        except Exception:  # noqa: BLE001  a snapshot may be half written
            continue
    raise FileNotFoundError(f"no readable snapshot in {folder}")


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet by iteration; rewriting an iteration replaces it alone."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iter").parquet(f"{path}/{name}")


def graphml_text(nodes: list, edges: list) -> str:
    """GraphML of a small graph; nodes (id, label, iter, depth), edges (src, dst, relation, iter, depth)."""
    from xml.sax.saxutils import escape, quoteattr

    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    keys = [("d0", "node", "label", "string"), ("d1", "node", "iter", "long"), ("d2", "node", "depth", "long"), ("d3", "edge", "relation", "string"), ("d4", "edge", "iter", "long"), ("d5", "edge", "depth", "long")]
    head += [f'<key id="{k}" for="{f}" attr.name="{n}" attr.type="{t}"/>' for k, f, n, t in keys]
    data = lambda k, v: f'<data key="{k}">{escape(str(v))}</data>'
    body = ['<graph edgedefault="directed">'] + [f"<node id={quoteattr(str(i))}>{data('d0', lab)}{data('d1', it)}{data('d2', dp)}</node>" for i, lab, it, dp in nodes]
    body += [f"<edge source={quoteattr(str(s))} target={quoteattr(str(t))}>{data('d3', r)}{data('d4', it)}{data('d5', dp)}</edge>" for s, t, r, it, dp in edges]
    return "\n".join([*head, *body, "</graph>", "</graphml>"])


def read_growth(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """The growth series; ``last``: only the newest steps."""
    df = spark.read.schema("iter long, depth long, n_nodes long, n_edges long, new_nodes long, tokens long, cum_tokens long, diversity double").option("header", True).csv(path)
    return df.orderBy(F.desc("iter")).limit(last).orderBy("iter") if last else df


def transcript_facts(df: DataFrame, order: str) -> DataFrame:
    """Turns, last question and last step of a transcript."""
    return df.agg(F.count("*").alias("turns"), F.max_by("question", order).alias("last_question"), F.max_by("iter", order).alias("last_iter"))


def parse_dataset_spec(spec: str) -> list[tuple[str, int | None]]:
    """``name[:rows]|name2``: names with their row limits."""
    out = []
    for part in filter(None, map(str.strip, spec.split("|"))):
        name, _, n = part.rpartition(":")
        if name and n.isdecimal():
            if int(n) <= 0:
                raise ValueError(f"no rows asked of {name}")
            out.append((name, int(n)))
        else:
            out.append((part, None))
    if not out:
        raise ValueError("empty dataset specification")
    return out


def prefix_sample(df: DataFrame, field: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by key whose field is there."""
    return df.where(F.col(field).isNotNull()).orderBy(key).limit(n)


def build_corpus(parts: list[DataFrame], key: str, seed: int = 42) -> DataFrame:
    """Union of sources by name with a hash order to shuffle by."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("shuffle_key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))


def resume(requested: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Requested rows that a partial output at ``path`` does not have yet."""
    try:
        done = requested.sparkSession.read.parquet(path).select(*keys).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return requested
        raise
    return requested.join(done, keys, "left_anti")


def write_manifest(value: dict, path: str) -> None:
    """A small JSON file, replaced at once."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.replace(temporary, path)


def checkpoint_problems(manifest: DataFrame) -> DataFrame:
    """(problem, value): missing fields, repeated steps and ids, and a series of fewer than two."""
    none = manifest.where("step IS NULL OR label IS NULL OR model IS NULL").select(F.lit("missing field").alias("problem"), F.coalesce(F.col("step").cast("string"), F.lit("?")).alias("value"))
    twice = lambda c: manifest.groupBy(c).count().where("count > 1").select(F.lit(f"repeated {c}").alias("problem"), F.col(c).cast("string").alias("value"))
    few = manifest.agg(F.count("*").alias("n")).where("n < 2").select(F.lit("fewer than two").alias("problem"), F.col("n").cast("string").alias("value"))
    return none.union(twice("step")).union(twice("id")).union(few)


def run_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a run folder with size and time, newest first; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime").orderBy(F.desc("modificationTime"), "path")


def paper_corpus(df: DataFrame, key: str, section: str, body: str, order: str, least: int = 200) -> DataFrame:
    """One text a paper: its sections under headings, in order; short papers are left out."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit("## "), F.upper(section), F.lit("\n"), body).alias("t"))))
    g = df.groupBy(key).agg(F.array_join(F.transform(parts, lambda s: s.t), "\n\n").alias("text"))
    return g.where(F.length("text") >= least)


def training_history(df: DataFrame, step: str, metrics: list[str], max_step: int | None = None) -> DataFrame:
    """Numbers by step: text that is no number is null, rows without a step go, repeated steps are averaged."""
    x = df.select(F.col(step).try_cast("double").alias("step"), *[F.col(m).try_cast("double").alias(m) for m in metrics]).where("step IS NOT NULL")
    x = x.where(F.col("step") <= max_step) if max_step is not None else x
    return x.groupBy("step").agg(*[F.avg(m).alias(m) for m in metrics])


def deduplicated_references(df: DataFrame, doi: str, title: str, rank: str) -> DataFrame:
    """One row per DOI, or per normalised title where there is none: the best ranked, ties by title."""
    key = F.coalesce(F.nullif(F.lower(F.trim(F.col(doi))), F.lit("")), F.concat(F.lit("t:"), F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")))
    return df.withColumn("__key", key).groupBy("__key").agg(F.max_by(F.struct(*df.columns), F.struct(rank, title)).alias("__r"), F.count("*").alias("copies")).select("__r.*", "copies")


def cached_embeddings(labels: DataFrame, path: str, model: str, embed) -> DataFrame:
    """Vectors of labels from a Parquet cache keyed by content hash and model; only new labels are embedded and appended."""
    keyed = labels.withColumn("key", F.sha2(F.concat(F.lit(model + "|"), "label"), 256))
    fresh = resume(keyed, path, ["key"])
    embed(fresh.dropDuplicates(["key"])).select("key", "label", "vector").write.mode("append").parquet(path)
    return keyed.join(labels.sparkSession.read.parquet(path).select("key", "vector"), "key").drop("key")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines behind those that ``path`` has; a task's file counts once its whole commit does, so a failed run adds nothing."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def overwrite(df: DataFrame, path: str, kind: str = "json") -> None:
    """``df`` in place of what ``path`` has, as json, csv (with a header) or parquet."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"no sink of kind {kind}")
    df.write.mode("overwrite").options(**({"header": True} if kind == "csv" else {"ignoreNullFields": False} if kind == "json" else {})).format(kind).save(path)


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of a growing series, oldest first."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def read_while_written(spark: SparkSession, path: str, reader, tries: int = 3, wait: float = 0.2):
    """What ``reader(path)`` makes of a file that another process may be rewriting: tried again after a pause, the last error stands."""
    import time

    for left in range(tries - 1, -1, -1):
        try:
            nodes, edges = reader(path)
            nodes.limit(1).count()
            edges.limit(1).count()
            return nodes, edges
        except Exception:
            if not left:
                raise
            time.sleep(wait)
    raise ValueError("no tries asked for")


def prepare_split(df: DataFrame, split: str, key: str, seed: int = 42, limit: int | None = None) -> DataFrame:
    """One reference split: its groups in the order of a hash of seed, seed + 1 or seed + 2 for train, validation or test, the first ``limit`` of them whole."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}")
    order = F.sha2(F.concat_ws(":", F.lit(str(seed + SPLITS.index(split))), F.col(key).cast("string")), 256)
    if limit is None:
        return df.withColumn("place", order)
    groups = df.select(key).distinct().withColumn("place", order).orderBy("place").limit(limit)
    return df.join(F.broadcast(groups), key)
