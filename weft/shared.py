"""Folder shared by the driver and the executors, and tables written there."""

from __future__ import annotations

import itertools
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_names = itertools.count()
_own: dict[str, str] = {}
_here = threading.local()  # tables that this thread made, so that no sweep touches another's


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests, one machine), a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="weft-"))


def _made() -> list[str]:
    return _here.__dict__.setdefault("made", [])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a cut in lineage that lost executors don't undo."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing needs any longer."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    jvm = spark.sparkContext._jvm
    _delete(spark, jvm.org.apache.hadoop.fs.Path(files[0]).getParent())


def _delete(spark: SparkSession, folder) -> None:
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has; ``sweep`` removes it like those of ``written``."""
    path = f"{shared_dir(spark)}/{name}-{next(_names)}-{uuid.uuid4().hex[:12]}"
    _made().append(path)
    return path


def mark() -> int:
    """How many tables this thread has made so far, for ``sweep``."""
    return len(_made())


def sweep(spark: SparkSession, since: int, last: int = 1) -> None:
    """Delete all tables that this thread made since a mark but the last ones, which hold what they were made for."""
    for path in _made()[since:-last]:
        _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    del _made()[since:-last]
