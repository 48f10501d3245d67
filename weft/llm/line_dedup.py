"""Line dedup with sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; its
128-bit hash identifies it.  The state has two parts.  *Reference counts* hold,
exactly, in how many documents each key occurs.  *Cuckoo filters*, one per shard
of the key space, hold the keys whose count has reached the limit.  Inserting or
deleting documents adds signed counts; a key that crosses the limit enters or
leaves its shard's filter, so any batch of documents can be taken out again and
the state is what it was.  Shards are doubled as hot keys grow, so that each holds
about ``SHARD_KEYS`` at most.  One corpus is deduplicated as one insertion into an
empty index.

A document's lines are tested against the filters first; only lines that hit
look up the exact counts.  Filters and the hot keys behind them, as sorted arrays
of longs (``KEY_BYTES`` a key at most, together), go to the executors as a
broadcast variable while they are within ``BROADCAST_BYTES``; above it, lines that
hit the filters (or all, where even those are too large) are joined with the hot keys.

Texts are taken in blocks of ``BLOCK_BYTES``: lines are found, stripped, compared
and put together again as byte ranges, one call a line for its hash alone.
Shuffles carry 24 bytes per distinct key of a task, summed before the shuffle,
so a line that a third of all documents share costs one row a task.

Defined cases: a null or empty text is one empty line; empty keys are never
dropped; each row counts as a document even where doc_id repeats or is null; an
empty table gives an empty result; an input column named as a new one is replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import textblock as tb

#: Hot keys and filters are broadcast up to this size.
BROADCAST_BYTES = 64 << 20
#: Two longs a hot key, and its share of the filters: 2.5 to 5 bytes while a filter is 0.4 to 0.8 full.
KEY_BYTES, FILTER_BYTES = 24, 6
BLOCK_BYTES = 4 << 20
#: Keys a task counts before it hands them on.
FLUSH = 200_000
#: Hot keys that a shard's filter is planned for.
SHARD_KEYS = 1 << 16
SLOTS, KICKS = 4, 500


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines of a block, and the number of each row's first line, with the total at the end."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    return starts, ends, np.searchsorted(breaks, offsets) + np.arange(len(offsets))


def line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lines whose key is not empty, and the 128 bits of each key as two longs."""
    solid = np.flatnonzero(tb.NON_SPACE[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = np.flatnonzero(high > low)
    text, digest = tb.LOWER[data].tobytes(), xxhash.xxh3_128_digest
    raw = b"".join([digest(text[a:b]) for a, b in zip(solid[low[full]].tolist(), (solid[high[full] - 1] + 1).tolist(), strict=True)]) if len(full) else b""
    return full, np.frombuffer(raw, "<i8").reshape(-1, 2)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (rows of two longs) in order, and the sum of ``n`` of each."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, n = keys[order], n[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]).any(1)
    cut = np.flatnonzero(fresh)
    return keys[cut], np.add.reduceat(n, cut) if len(cut) else n


def by_document(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys without repeats within a row."""
    order = np.lexsort((keys[:, 1], keys[:, 0], row))
    keys, row = keys[order], row[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]).any(1) | (row[1:] != row[:-1])
    return keys[fresh]


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; what finds no place goes to an exact stash."""

    def __init__(self, n_keys: int, table: np.ndarray | None = None, stash: list[tuple[int, int]] | None = None) -> None:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n_keys) / SLOTS / 0.8))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1
        self.stash = Counter(map(tuple, stash or ()))  # keys may share mark and buckets, so each is counted

    def _place(self, a: int, b: int) -> tuple[int, int]:
        return (b & 0xFFFF) or 1, (a >> 20) & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def insert(self, a: int, b: int) -> None:
        """Add a key (two longs); the caller adds no key twice."""
        mark, bucket = self._place(a, b)
        for k in range(KICKS):
            for at in (bucket, self._other(bucket, mark)) if not k else (bucket,):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    return
            slot = k % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
        self.stash[mark, min(bucket, self._other(bucket, mark))] += 1

    def delete(self, a: int, b: int) -> None:
        """Take out a key that was inserted."""
        mark, bucket = self._place(a, b)
        for at in (bucket, self._other(bucket, mark)):
            found = np.flatnonzero(self.table[at] == mark)
            if len(found):
                self.table[at, found[0]] = 0
                return
        at = (mark, min(bucket, self._other(bucket, mark)))
        if self.stash[at] > 1:
            self.stash[at] -= 1
        else:
            del self.stash[at]

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of key halves: may the key be in the filter?"""
        mark = (b & 0xFFFF).astype(np.int64)
        mark[mark == 0] = 1
        bucket = (a >> 20) & self.mask
        other = bucket ^ ((mark * 0x5BD1E995) & self.mask)
        hit = (self.table[bucket] == mark[:, None]).any(1) | (self.table[other] == mark[:, None]).any(1)
        if self.stash:
            hit |= np.array([(int(m), int(min(x, y))) in self.stash for m, x, y in zip(mark, bucket, other, strict=True)], bool)
        return hit

    def to_row(self) -> tuple[int, bytes, list[int]]:
        """Buckets, table and stash as plain values."""
        return len(self.table), self.table.tobytes(), [x for pair in sorted(self.stash.elements()) for x in pair]

    @classmethod
    def of_row(cls, buckets: int, table: bytes, stash) -> CuckooFilter:
        """What ``to_row`` gave."""
        flat = [int(x) for x in stash]
        return cls(0, np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy(), list(zip(flat[::2], flat[1::2], strict=True)))


COUNTS = "h1 long, h2 long, n long"
FILTERS = "shard long, buckets long, table binary, stash array<long>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

    def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n)], ["h1", "h2", "n"])

    for block in tb.iter_blocks(batches, BLOCK_BYTES):
        data, offsets = tb.text_bytes(block.column("text"))
        starts, ends, bounds = lines_of(data, offsets)
        full, keys = line_hashes(data, starts, ends)
        if not len(full):
            continue
        keys = by_document(keys, np.searchsorted(bounds, full, "right"))
        held.append(summed(keys, np.ones(len(keys), np.int64)))
        if sum(len(n) for _, n in held) >= FLUSH:
            keys, n = merged()
            held = [(keys, n)]
            if len(n) >= FLUSH // 2:
                yield rows(keys, n)
                held = []
    if held:
        yield rows(*merged())


def _none(spark, schema: str) -> DataFrame:
    """An empty table."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])


def reference_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, n): in how many rows of ``docs`` each key occurs."""
    tb.arrow_batches(docs.sparkSession)
    parts = docs.select(docs[text].cast("string").alias("text")).mapInArrow(_count, COUNTS)
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def shard_of(shards: int) -> Column:
    """A key's shard; ``shards`` is a power of two."""
    return F.col("h1").bitwiseAND(F.lit(shards - 1))


def shards_for(n_keys: int) -> int:
    """Shards, a power of two, for so many hot keys."""
    return 1 << max(0, int(np.ceil(np.log2(max(1, n_keys) / SHARD_KEYS))))


class _Prober:
    """Filters by shard and the exact hot keys behind them, on an executor."""

    def __init__(self, shards: int, filters: dict[int, tuple], hot: np.ndarray | None) -> None:
        self.shards, self.hot = shards, hot
        self.filters = {k: CuckooFilter.of_row(*row) for k, row in filters.items()}
        same = np.flatnonzero(np.diff(hot[:, 0]) == 0) if hot is not None and len(hot) else []
        self.run = 1 + len(same)  # keys that share a first half stand together

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Which keys the filters let through."""
        out = np.zeros(len(keys), bool)
        shard = keys[:, 0] & (self.shards - 1)
        for s in np.unique(shard).tolist():
            if s in self.filters:
                own = np.flatnonzero(shard == s)
                out[own] = self.filters[s].contains(keys[own, 0], keys[own, 1])
        return out

    def dropped(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are hot: the filters first, then the exact keys."""
        out = self.maybe(keys)
        own = np.flatnonzero(out)
        at = np.searchsorted(self.hot[:, 0], keys[own, 0])
        hit = np.zeros(len(own), bool)
        for k in range(self.run):
            place = np.minimum(at + k, len(self.hot) - 1)
            hit |= (self.hot[place] == keys[own]).all(1)
        out[own] = hit
        return out


def _without(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, gone: np.ndarray, digest: bool) -> dict[str, pa.Array]:
    """New columns of a block whose lines ``gone`` go."""
    n_lines, dropped = np.diff(bounds), np.zeros(len(gone) + 1, np.int64)
    np.cumsum(gone, out=dropped[1:])
    n_dropped = np.diff(dropped[bounds])
    text = data.tobytes()
    kept: list = []
    # lines that stay and stand together are one range of bytes
    stay = np.flatnonzero(~gone)
    row = np.searchsorted(bounds, stay, "right") - 1
    first = np.ones(len(stay), bool)
    first[1:] = (np.diff(stay) > 1) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(stay)) - 1 if len(stay) else begin
    a, b = starts[stay[begin]].tolist(), ends[stay[last]].tolist()
    run = np.searchsorted(row[begin], np.arange(len(n_lines) + 1)).tolist()
    for r in range(len(n_lines)):
        kept.append(b"\n".join([text[a[k] : b[k]] for k in range(run[r], run[r + 1])]))
    new = {"n_lines": pa.array(n_lines), "n_dropped": pa.array(n_dropped)}
    if digest:
        return new | {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
    return new | {"kept_text": pa.array(kept, pa.binary()).cast(pa.string())}


def _fields(digest: bool) -> list[T.StructField]:
    return [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256" if digest else "kept_text", T.StringType())]


def drop_lines(docs: DataFrame, hot: DataFrame, filters: DataFrame, shards: int, text: str = "text", digest: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop every line whose key is in ``hot`` (h1, h2); ``filters`` has the cuckoo filter of each shard of these keys.

    Adds n_lines, n_dropped, and kept_text (or kept_sha256 if ``digest``); all
    other columns stay, one of the same name as a new one is replaced.
    """
    spark = docs.sparkSession
    n_hot = hot.count()
    small = n_hot * KEY_BYTES <= broadcast_bytes
    rows = {r.shard: (r.buckets, bytes(r.table), list(r.stash)) for r in filters.toPandas().itertuples()} if small or n_hot * FILTER_BYTES <= broadcast_bytes else None
    if small:
        keys = hot.select("h1", "h2").toPandas().to_numpy(np.int64).reshape(-1, 2)
        shared = spark.sparkContext.broadcast((shards, rows, keys[np.lexsort((keys[:, 1], keys[:, 0]))]))

        def start():
            prober = _Prober(*shared.value)

            def compute(data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
                starts, ends, bounds = lines_of(data, offsets)
                full, found = line_hashes(data, starts, ends)
                gone = np.zeros(len(starts), bool)
                gone[full] = prober.dropped(found)
                return _without(data, offsets, starts, ends, bounds, gone, digest)

            return compute

        return tb.map_texts(docs, text, _fields(digest), start, BLOCK_BYTES)
    return _by_join(docs, hot, spark.sparkContext.broadcast((shards, rows, None)) if rows is not None else None, text, digest)


def _by_join(docs: DataFrame, hot: DataFrame, shared, text: str, digest: bool) -> DataFrame:
    """``drop_lines`` with hot keys that no executor holds: equal texts have equal hot lines, so rows meet them by the hash of their text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    tb.arrow_batches(docs.sparkSession)
    new = _fields(digest)
    kept = [i for i, name in enumerate(docs.columns) if name not in {f.name for f in new}]
    given = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    given = given.select(*[f"c{i}" for i in kept], F.coalesce(F.col(f"c{docs.columns.index(text)}").cast("string"), F.lit("")).alias("t")).withColumn("r", F.sha2("t", 256))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = None if shared is None else _Prober(*shared.value)
        for block in tb.iter_blocks(batches, BLOCK_BYTES, "t"):
            data, offsets = tb.text_bytes(block.column("t"))
            starts, ends, bounds = lines_of(data, offsets)
            full, found = line_hashes(data, starts, ends)
            row = np.searchsorted(bounds, full, "right") - 1
            if prober is not None:
                hit = prober.maybe(found)
                row, found = row[hit], found[hit]
            yield pa.RecordBatch.from_arrays([block.column("r").combine_chunks().take(pa.array(row)), pa.array(found[:, 0]), pa.array(found[:, 1])], ["r", "h1", "h2"])

    lines = given.select("r", "t").mapInArrow(keys, "r string, h1 long, h2 long")
    found = lines.join(hot.select("h1", "h2"), ["h1", "h2"]).groupBy("r").agg(F.collect_set(F.struct("h1", "h2")).alias("h"))
    joined = given.join(found, "r", "left")
    schema = T.StructType([*[T.StructField(f"c{i}", docs.schema[i].dataType) for i in kept], *[T.StructField(f"n{j}", f.dataType) for j, f in enumerate(new)]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.iter_blocks(batches, BLOCK_BYTES, "t"):
            data, offsets = tb.text_bytes(block.column("t"))
            starts, ends, bounds = lines_of(data, offsets)
            full, own = line_hashes(data, starts, ends)
            row = np.searchsorted(bounds, full, "right") - 1
            gone = np.zeros(len(starts), bool)
            for r, pairs in enumerate(block.column("h").to_pylist()):
                if pairs:
                    a, b = np.searchsorted(row, [r, r + 1])
                    some = {(x["h1"], x["h2"]) for x in pairs}
                    gone[full[a:b]] = [tuple(k) in some for k in own[a:b].tolist()]
            added = _without(data, offsets, starts, ends, bounds, gone, digest)
            yield from pa.table([*[block.column(f"c{i}") for i in kept], *[added[f.name] for f in new]], schema=arrow).combine_chunks().to_batches()

    return joined.mapInArrow(run, schema).toDF(*[docs.columns[i] for i in kept], *[f.name for f in new])


def dedup_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", digest: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop all lines whose key occurs in at least ``min_docs`` rows of ``docs``; columns as ``drop_lines``.

    The corpus is inserted into a fresh ``LineIndex`` in the shared folder.
    """
    from weft.shared import fresh_path

    index = LineIndex(docs.sparkSession, fresh_path(docs.sparkSession, "lines"), min_docs)
    index.insert(docs, text)
    return index.apply(docs, text, digest, broadcast_bytes)


class LineIndex:
    """Reference counts and filters kept as Parquet under ``path``; every change writes a new version.

    ``insert`` and ``delete`` take document batches; deleting a batch that was
    inserted restores counts and filter membership.  Deleting documents that were
    never inserted is an error, found by a count below zero, and changes nothing.
    A version counts once its ``meta`` is there; ``open`` goes on from the last one.
    The version before the last stays for readers under way, older ones are removed.
    """

    def __init__(self, spark, path: str, min_docs: int = 10) -> None:
        self.spark, self.path, self.min_docs, self.shards, self.version = spark, path, min_docs, 1, 0

    @classmethod
    def open(cls, spark, path: str) -> LineIndex:
        """The index at ``path`` as its last complete change left it."""
        own = cls(spark, path)
        marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/meta/_SUCCESS")
        found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
        done = [int(s.getPath().getParent().getParent().getName()[1:]) for s in found or ()]
        if not done:
            raise ValueError(f"no index at {path}")
        own.version = max(done)
        own.min_docs, own.shards = spark.read.parquet(f"{path}/v{own.version}/meta").first()
        return own

    def counts(self) -> DataFrame:
        """(h1, h2, n) of every key in use."""
        return self.spark.read.schema(COUNTS).parquet(f"{self.path}/v{self.version}/counts") if self.version else _none(self.spark, COUNTS)

    def filters(self) -> DataFrame:
        """One filter per shard that has, or had, hot keys."""
        return self.spark.read.schema(FILTERS).parquet(f"{self.path}/v{self.version}/filters") if self.version else _none(self.spark, FILTERS)

    def hot(self) -> DataFrame:
        """(h1, h2) of the keys that have reached the limit."""
        return self.counts().where(F.col("n") >= self.min_docs).select("h1", "h2")

    def insert(self, docs: DataFrame, text: str = "text") -> None:
        """Add documents."""
        self._change(reference_counts(docs, text))

    def delete(self, docs: DataFrame, text: str = "text") -> None:
        """Take documents out again."""
        self._change(reference_counts(docs, text).withColumn("n", -F.col("n")))

    def _change(self, delta: DataFrame) -> None:
        at = f"{self.path}/v{self.version + 1}"
        if self.version:
            old = self.counts().withColumnRenamed("n", "was")
            both = old.join(delta.withColumnRenamed("n", "by"), ["h1", "h2"], "full_outer").select("h1", "h2", F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("n"))
            both.write.mode("overwrite").parquet(f"{at}.changed")
            both = self.spark.read.parquet(f"{at}.changed")
            if both.where("n < 0").limit(1).count():
                self._remove(f"{at}.changed")
                raise ValueError("documents are deleted that were never inserted")
            both.where("n > 0").select("h1", "h2", "n").write.mode("overwrite").parquet(f"{at}/counts")
            crossing = both.where((F.col("was") >= self.min_docs) != (F.col("n") >= self.min_docs)).select("h1", "h2", (F.col("n") >= self.min_docs).alias("up"))
        else:
            delta.write.mode("overwrite").parquet(f"{at}/counts")
            delta = self.spark.read.schema(COUNTS).parquet(f"{at}/counts")
            if delta.where("n < 0").limit(1).count():
                self._remove(at)
                raise ValueError("documents are deleted that were never inserted")
            crossing = delta.where(F.col("n") >= self.min_docs).select("h1", "h2", F.lit(True).alias("up"))
        now = self.spark.read.schema(COUNTS).parquet(f"{at}/counts").where(F.col("n") >= self.min_docs)
        shards, filters = max(self.shards, shards_for(now.count())), self.filters()
        if shards > self.shards:  # every key moves: the filters are built anew from the exact counts
            crossing, filters = now.select("h1", "h2", F.lit(True).alias("up")), filters.limit(0)

        def change(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            shard = int((filters if len(filters) else keys).shard.iloc[0])
            made = CuckooFilter.of_row(*filters.iloc[0][["buckets", "table", "stash"]]) if len(filters) else CuckooFilter(SHARD_KEYS)
            for a, b, up in zip(keys.h1.tolist(), keys.h2.tolist(), keys.up.tolist(), strict=True):
                (made.insert if up else made.delete)(a, b)
            return pd.DataFrame([(shard, *made.to_row())], columns=["shard", "buckets", "table", "stash"])

        changed = filters.groupBy("shard").cogroup(crossing.withColumn("shard", shard_of(shards)).groupBy("shard")).applyInPandas(change, FILTERS)
        changed.write.mode("overwrite").parquet(f"{at}/filters")
        self.spark.range(1).select(F.lit(self.min_docs).cast("long").alias("min_docs"), F.lit(shards).cast("long").alias("shards")).write.mode("overwrite").parquet(f"{at}/meta")
        self._remove(f"{at}.changed", f"{self.path}/v{self.version - 1}")
        self.shards, self.version = shards, self.version + 1

    def _remove(self, *paths: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for path in paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def apply(self, docs: DataFrame, text: str = "text", digest: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Documents without the lines that are hot now; columns as ``drop_lines``."""
        return drop_lines(docs, self.hot(), self.filters(), self.shards, text, digest, broadcast_bytes)
