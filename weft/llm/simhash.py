"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes.  Two that differ in at most k
bits share at least 8 - k positional bytes; with k = 4 the guaranteed minimum is
four.  The index posts each distinct fingerprint under every choice of three
positions (one less than the minimum) together with the bytes there, so every pair
that reaches the minimum meets in some posting.  (Postings of single bytes would
tally a 32nd of all pairs, those of two bytes a 2,300th, and both counts grow with
the square of the corpus before any pair is known to be near.)  In a posting, the
shared positional bytes of each pair are tallied; pairs that share the three of the
posting alone are below the minimum and leave; the rest are verified by Hamming distance.

Only components are asked for, so a posting yields a spanning star for each group
of linked members, never its pairs.  A posting larger than ``POSTING`` is cut into
blocks, and every pair of blocks is compared as a task of its own; no task holds
more than two blocks.  Exact copies are one fingerprint from the start.  Postings
are dealt to as many partitions as their measured number asks for (``PART_ROWS``).

Defined cases: no words (null, empty, white space): fingerprint zero, linked as
any other; fewer words than a shingle: the whole sequence is one; a null doc_id
has a fingerprint and takes the component of its fingerprint, null if no row there has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from weft.llm import textblock as tb
from weft.operators.components import connected_components
from weft.shared import written

SEED = 42
#: Fingerprints of one posting that are compared at once.
POSTING = 4096
#: Rows of the index in one partition.
PART_ROWS = 2_000_000
#: Text handled at once in fingerprinting, and shingles whose bits are unpacked at once.
BLOCK_BYTES, CHUNK = 2 << 20, 1 << 18


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """uint64 fingerprint of every text of a block."""
    data = tb.LOWER[data]
    starts, ends = tb.word_spans(data, offsets, tb.NON_SPACE)
    bounds = tb.row_bounds(starts, offsets)
    words = np.diff(bounds)
    out = np.zeros(len(words), np.uint64)
    if not len(starts):
        return out
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size + 1)))[:-1]  # of each word in the text with single blanks
    joined = np.full(int(at[-1] + size[-1] + 1), 32, np.uint8)
    joined[tb.gather_ranges(at, size)] = data[tb.gather_ranges(starts, size)]
    text = joined.tobytes()
    count = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    first = tb.gather_ranges(bounds[:-1], count)
    last = np.minimum(first + shingle - 1, np.repeat(bounds[1:] - 1, count))
    begin, end = at[first], at[last] + size[last]
    row = np.repeat(np.arange(len(words)), count)
    ones = np.zeros((len(words), 64), np.int64)
    for a in range(0, len(first), CHUNK):
        b = min(a + CHUNK, len(first))
        hashes = np.array([xxh64_intdigest(text[i:j], SEED) for i, j in zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True)], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.flatnonzero(np.diff(row[a:b], prepend=-1))
        ones[row[a:b][cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    out[:] = np.packbits(2 * ones > count[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprint_docs(docs: DataFrame, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.iter_blocks(batches, BLOCK_BYTES):
            found = fingerprints(*tb.text_bytes(block.column("text")), shingle)
            yield from pa.table({"doc_id": block.column("doc_id"), "fp": pa.array(found.view(np.int64))}).combine_chunks().to_batches()

    tb.arrow_batches(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def with_fingerprints(docs: DataFrame, into: str, shingle: int = 4) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as ``into``."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.iter_blocks(batches, BLOCK_BYTES):
            found = fingerprints(*tb.text_bytes(block.column("text")), shingle)
            columns = {c: block.column(c) for c in names} | {into: pa.array(found.view(np.int64))}
            yield from pa.table(columns).combine_chunks().to_batches()

    tb.arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.LongType())]))


def tally(differing: np.ndarray) -> np.ndarray:
    """Shared positional bytes of pairs, from the bits in which they differ."""
    return (differing.view(np.uint8).reshape(*differing.shape, 8) == 0).sum(-1)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs reach the minimum of shared positional bytes and lie within ``distance``."""
    differing = a ^ b
    near = tally(differing) >= 8 - distance
    near[near] = np.bitwise_count(differing[near]) <= distance
    return near


def spanning(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that connect what links within ``distance`` connect among ``fps``."""
    fps = np.unique(fps)
    n = len(fps)
    linked = np.empty((n, n), bool)
    step = max(1, (1 << 18) // max(n, 1))
    for a in range(0, n, step):
        linked[a : a + step] = _near(np.repeat(fps[a : a + step, None], n, 1), np.repeat(fps[None, :], len(fps[a : a + step]), 0), distance)
    label = np.arange(n)
    while True:
        least = np.array([label[row].min() for row in linked]) if n > 64 else np.where(linked, label, n).min(1)
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    away = np.flatnonzero(label != np.arange(n))
    return fps[away], fps[label[away]]


def _postings(masks: list[int], distance: int, limit: int):
    """Over rows sorted by (posting, key): star edges of postings up to ``limit``, members of larger ones as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int16), np.zeros(0, np.int64)]
        passing = None  # the posting whose members are being passed on

        def rows(big: bool, posting, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), big)), pa.array(posting, pa.int16()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["big", "posting", "a", "b"])

        def out(posting: np.ndarray, fp: np.ndarray, final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, passing
            key = fp & np.array(masks, np.uint64).view(np.int64)[posting]
            cut = np.flatnonzero(np.diff(posting, prepend=-1).astype(bool) | (np.diff(key, prepend=0) != 0) | (np.arange(len(key)) == 0))
            size = np.diff(np.append(cut, len(key)))
            if not final and len(cut):  # the last posting may go on
                tail = cut[-1]
                held = [posting[tail:], fp[tail:]]
                cut, size = cut[:-1], size[:-1]
            else:
                held = [posting[:0], fp[:0]]
            if passing is not None and len(cut):
                if (posting[0], key[0]) == passing:
                    a = slice(0, size[0])
                    yield rows(True, posting[a], key[a].view(np.uint64), fp[a].view(np.uint64))
                    cut, size = cut[1:], size[1:]
                passing = None
            two = cut[size == 2]
            x, y = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            near = _near(x, y, distance)
            edges = [(np.maximum(x[near], y[near]), np.minimum(x[near], y[near]))]
            for c, s in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if s > limit:
                    yield rows(True, posting[c : c + s], key[c : c + s].view(np.uint64), fp[c : c + s].view(np.uint64))
                else:
                    edges.append(spanning(fp[c : c + s].view(np.uint64), distance))
            a, b = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
            if len(a):
                yield rows(False, np.zeros(len(a), np.int16), a, b)
            if len(held[0]) > limit:  # hand on what is held; the rest of the posting follows
                key = held[1] & np.array(masks, np.uint64).view(np.int64)[held[0]]
                yield rows(True, held[0], key.view(np.uint64), held[1].view(np.uint64))
                passing = (held[0][0], key[0])
                held = [held[0][:0], held[1][:0]]

        for batch in batches:
            posting = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False)
            yield from out(np.concatenate((held[0], posting)), np.concatenate((held[1], fp)), False)
        yield from out(*held, True)

    return run


def indexed(distance: int) -> int:
    """Positional bytes of a posting: one less than a pair within ``distance`` shares at least."""
    return max(1, 7 - distance)


def links(fps: DataFrame, distance: int = 4, posting: int = POSTING) -> DataFrame:
    """(a, b) edges whose components are those of all links within ``distance`` among the distinct ``fps.fp``."""
    if not 0 <= distance <= 7:
        raise ValueError("the byte index needs a distance of 0 to 7 bits")
    masks = [sum(0xFF << (8 * p) for p in at) for at in combinations(range(8), indexed(distance))]
    signed = F.array(*[F.lit(int(np.array([m], np.uint64).view(np.int64)[0])) for m in masks])
    posted = fps.select("fp", F.explode(F.array(*[F.lit(k).cast("short") for k in range(len(masks))])).alias("posting"))
    spark = fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * len(masks) // PART_ROWS))
    # the key is dealt and sorted by but never carried: it follows from the fingerprint
    key = F.col("fp").bitwiseAND(F.get(signed, F.col("posting").cast("int")))
    dealt = posted.repartition(parts, "posting", key).withColumn("key", key).sortWithinPartitions("posting", "key").select("posting", "fp")
    found = written(dealt.mapInArrow(_postings(masks, distance, posting), "big boolean, posting short, a long, b long"), "postings")
    edges = found.where("NOT big").select("a", "b")
    big = found.where("big").select("posting", F.col("a").alias("key"), F.col("b").alias("fp"))
    blocks = big.groupBy("posting", "key").agg(F.ceil(F.count("*") / F.lit(posting)).cast("int").alias("blocks"))
    own = big.join(blocks, ["posting", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("posting", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = spanning(pdf.fp.to_numpy().view(np.uint64), distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return edges.union(paired.groupBy("posting", "key", "i", "j").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, text: str = "text", doc_id: str = "doc_id", posting: int = POSTING) -> DataFrame:
    """(doc_id, fp, component_id, component): the smallest doc_id that links reach and a fingerprint that names the group, for every row of ``docs``."""
    own = written(fingerprint_docs(docs, shingle, text, doc_id), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = written(connected_components(links(distinct.select("fp"), distance, posting)).withColumnRenamed("node", "fp"), "components")
    linked = found.join(distinct, "fp")
    by = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(by, "component").select("fp", "component_id", "component")
    # written, so that the join with all rows stands alone and a hot fingerprint's rows can be split
    resolved = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "fp").alias("component")), "resolved")
    return own.join(resolved, "fp").select("doc_id", "fp", "component_id", "component")
