"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.shared import shared_dir


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into Parquet with a checkpoint in the shared folder, and read the result."""
    at = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex[:12]}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def source(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A table's files as a stream (one file or a folder of files), tailing new ones."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if fs.getFileStatus(files).isDirectory() else reader.option("pathGlobFilter", name).parquet(folder)


def once_per_key(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of every key, across restarts: the state holds the keys."""
    return stream.dropDuplicates(keys)


def concept_upsert(stream: DataFrame, graph_id: str, order: str, vector: str, threshold: float) -> DataFrame:
    """(graph_id, id, merged_into) as vectors arrive: each joins the best kept one of its graph at the threshold or more, else it is kept.

    The state of a graph is its kept ids and vectors; rows of a batch go by ``order``.
    """

    def step(key, batches, state: GroupState):
        ids, flat = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values("id")
        out = []
        for i, v in zip(rows.id.tolist(), rows.v, strict=True):
            v = np.asarray(v, float)
            v = v / max(np.linalg.norm(v), 1e-9)
            s = np.array(flat).reshape(len(ids), -1) @ v if ids else np.zeros(0)
            k = int(s.argmax()) if len(s) else -1
            if k >= 0 and s[k] >= threshold:
                out.append((key[0], i, ids[k]))
            else:
                ids.append(i)
                flat.extend(v.tolist())
                out.append((key[0], i, i))
        state.update((ids, flat))
        yield pd.DataFrame(out, columns=["graph_id", "id", "merged_into"])

    given = stream.select(F.col(graph_id).cast("long").alias("graph_id"), F.col(order).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return given.groupBy("graph_id").applyInPandasWithState(step, "graph_id long, id long, merged_into long", "ids array<long>, flat array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """Counts by tumbling event-time window and key behind a watermark (an extension: the traces have no event time)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def emit_steps(stream: DataFrame, path: str, state: str):
    """A row a step, appended to JSON lines at ``path`` as steps arrive; ``state`` holds what is done, so a restart emits no step twice.  Returns the running query."""
    return stream.writeStream.format("json").option("checkpointLocation", state).option("path", path).outputMode("append").trigger(availableNow=True).start()


def tailed(spark: SparkSession, folder: str, schema, kind: str = "json", files_per_trigger: int = 1) -> DataFrame:
    """Rows of a folder of CSV or JSON lines as a stream that goes on with what is added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).options(**({"header": True} if kind == "csv" else {})).format(kind).load(folder)
