"""Vectorised text primitives for Arrow batches.

A *block* is a run of rows whose texts lie end to end in one UTF-8 byte array
with row offsets.  Every word class used by the operators is defined on bytes
(all bytes from 0x80 up belong to words, or are never separators), so words are
found with one table look-up and a comparison of neighbours; distinct words are
found with Arrow's dictionary encoding.  Nothing here loops over words.
"""

from __future__ import annotations

import faulthandler
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` (after lower-casing): digits, a-z and all non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of ``[^\x20\x09-\x0D]``.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Rows and bytes that Spark puts in one Arrow batch at most: texts may be long, so few.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: A block that computes for longer than this, and a second more for every so many bytes, is stuck: its worker ends and the task starts again elsewhere.
STUCK_S, SLOW_BYTES = 240, 20_000


def arrow_batches(spark) -> None:
    """Small Arrow batches for the plans of this session; Spark reads the bounds when a plan runs, and batches only get smaller."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b")
        now = int(now) if now.lstrip("-").isdecimal() else 0  # 0 or less: no bound; sizes may carry a unit
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


@contextmanager
def watched(size: int, seconds: float = STUCK_S) -> Iterator[None]:
    """End this worker, with its stack in the executor's log, if the block of ``size`` bytes within takes far too long.

    Only the computation of one block is watched, in the worker that does it: waiting for
    input counts for nothing, and no other query of the session is touched.
    """
    faulthandler.dump_traceback_later(seconds + size / SLOW_BYTES, exit=True, file=sys.__stderr__ or 2)
    try:
        yield
    finally:
        faulthandler.cancel_dump_traceback_later()


def iter_blocks(batches: Iterable[pa.RecordBatch], max_bytes: int, text: str = "text") -> Iterator[pa.Table]:
    """Regroup batches into tables of about ``max_bytes`` of text (a longer single row makes its own block)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).fill_null("")
        ends = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + max_bytes - size, side="right")))
            if held and size + int(ends[to - 1]) - done > max_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - done
            at = to
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``table``; a run never crosses a row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def row_bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each row's first word, with the total at the end."""
    return np.searchsorted(starts, offsets)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte strings that lie end to end in ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Index of every word into the distinct words, and those, in order of first occurrence."""
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    np.add.at(mark, ends, -1)
    joined = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    coded = binary_array(joined, offsets).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def per_row_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i+1]]`` for each row; zero for empty rows."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0, dtype=out.dtype)
    return out


def gather_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges ``starts[i] .. starts[i] + counts[i]``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift


def map_texts(df: DataFrame, text: str, new: list[T.StructField], start: Callable[[], Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]]], max_bytes: int) -> DataFrame:
    """Add columns computed from the whole texts of a column, block by block.

    ``start`` runs once a task and returns what gives the new columns of a block
    from its bytes and row offsets (null: empty).  All other columns pass through
    untouched, the text once; one that is named as a new column is replaced.
    Columns travel under numbers, so no name of theirs can clash with another.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_batches(df.sparkSession)
    names = {f.name for f in new}
    at = df.columns.index(text)
    given = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    kept = [i for i, name in enumerate(df.columns) if name not in names]
    as_it_is = isinstance(df.schema[at].dataType, T.StringType) and at in kept
    column = f"c{at}" if as_it_is else "t"
    given = given.select(*[f"c{i}" for i in kept], *([] if as_it_is else [F.col(f"c{at}").cast("string").alias("t")]))
    schema = T.StructType([*[T.StructField(f"c{i}", df.schema[i].dataType) for i in kept], *[T.StructField(f"n{j}", f.dataType) for j, f in enumerate(new)]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for block in iter_blocks(batches, max_bytes, column):
            data, offsets = text_bytes(block.column(column))
            with watched(len(data)):
                found = compute(data, offsets)
            out = [*[block.column(f"c{i}") for i in kept], *[found[f.name] for f in new]]
            yield from pa.table(out, schema=arrow).combine_chunks().to_batches()

    return given.mapInArrow(run, schema).toDF(*[df.columns[i] for i in kept], *[f.name for f in new])
