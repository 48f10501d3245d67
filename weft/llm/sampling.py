"""Folds and bounded, reproducible training samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a text that may be a training row, and of all training texts of a class.
MAX_TEXT, MAX_BYTES = 256 << 10, 24 << 20


def in_fold(doc_id: Column, modulus: int, fold: int) -> Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == fold, F.lit(False))


def frame(df: DataFrame) -> pd.DataFrame:
    """A bounded result on the driver, by Arrow: rows as objects would take several times the memory."""
    return df.toArrow().to_pandas()


def held_here(df: DataFrame) -> tuple[DataFrame, int]:
    """A bounded result as a local table, and its rows: joined by broadcast without running its plan again, no Python worker needed."""
    rows = df.toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema), rows.num_rows


def hash_order(key: str = "doc_id") -> list[Column]:
    """An order that any table with these keys gives alike."""
    return [F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.col(key)]


def hashed_first(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """``n`` rows, the first in hash order of the key: the same ones for the same table."""
    return df.orderBy(*hash_order(key)).limit(n)


def texts_of(docs: DataFrame, chosen: DataFrame, by: list[str], max_text: int = MAX_TEXT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``chosen`` (doc_id and the columns ``by``; few rows) with ``text`` and ``lang``: one text an id, bounded in bytes.

    Of an id that repeats, one text is taken, whatever the number of its rows.
    Texts above ``max_text`` bytes are left out whole; of the others those enter,
    in hash order of their ids, that fit into ``max_bytes`` for each value of ``by``.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("own_lang")).where(F.octet_length("text") <= max_text)
    one = F.min(F.struct(F.xxhash64("text"), F.octet_length("text").alias("size"), F.col("text"), F.col("own_lang").alias("lang"))).alias("m")
    found = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *by).agg(one)
    # a window over as many rows as were chosen
    fits = F.sum("m.size").over(Window.partitionBy(*by).orderBy(*hash_order()))
    return found.withColumn("sum", fits).where(F.col("sum") <= max_bytes).select("doc_id", *by, "m.text", "m.lang")


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int) -> pd.DataFrame:
    """(doc_id, text, lang, y) of at most ``per_class`` training rows of each label 0 and 1, of ``MAX_BYTES`` each.

    Rows of the held-out fold never enter.  The ids are chosen among the labels,
    whose bounded pick is then joined with the documents by broadcast.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~in_fold(F.col("doc_id"), modulus, held)).distinct()
    picked = hashed_first(usable.where("y = 1"), per_class).union(hashed_first(usable.where("y = 0"), per_class))
    chosen, n = held_here(picked)
    if not n:
        return pd.DataFrame({"doc_id": [], "text": [], "lang": [], "y": []})
    return frame(texts_of(docs, chosen, ["y"])).sort_values(["doc_id", "y"], kind="stable").drop_duplicates("text").reset_index(drop=True)


class Adam:
    """Adam over a dict of arrays."""

    def __init__(self, weights: dict, rate: float) -> None:
        import numpy as np

        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict) -> None:
        """One update; a gradient may be (rows, values) for some rows of a table."""
        import numpy as np

        self.t += 1
        scale = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.w[k][at] -= scale * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-8)
