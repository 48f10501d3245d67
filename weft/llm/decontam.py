"""Benchmark decontamination by binary search in suffix arrays of the training text.

Each block of training documents is a shard with a word-level suffix array.  A
word that no benchmark item has cannot be part of a match, so suffixes with such
a word (or the document's end) before the shortest window ends are left out of
the array; this is exact.  Suffixes are sorted by their first ``window`` words.
Every test suffix that starts a window is looked up by two binary searches, whose
range holds all its verbatim occurrences and their places.  Occurrences at
consecutive places of one item join to the longest matches.

The benchmark goes to the executors as a broadcast variable in parts whose
measured text is at most ``PART_BYTES``; a larger benchmark is searched part by
part, each part in a pass of its own over the same partition.  There is no
shuffle, so a passage that a third of the documents share costs what any other
text costs.

Defined cases: null or empty texts have no words; items without words have no
windows; an item shorter than the window is one window; an item with a null id
hits as any other and is only left out of the lists of ids; repeated items count
once by id; an item longer than a part is cut into pieces that overlap by a window
less a word; empty tables give empty or clean results; an input column named as a
new one is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import textblock as tb

PART_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class TestSuffixes:
    """A benchmark part: vocabulary, window keys in sorted order and the items and places of each."""

    __test__ = False  # not a pytest class

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window = window
        data, offsets = tb.text_bytes(pa.array([t or "" for _, t in items], pa.string()))
        data = tb.LOWER[data]
        starts, ends = tb.word_spans(data, offsets, tb.ALNUM)
        which, self.vocabulary = tb.encode_words(data, starts, ends)
        bounds = tb.row_bounds(starts, offsets)
        self.items = [i for i, _ in items]
        ids = (which + 1).astype(">i4")
        found: dict[bytes, list[tuple[int, int]]] = {}
        for k in range(len(items)):
            own = ids[bounds[k] : bounds[k + 1]]
            size = min(window, len(own))
            for j in range(len(own) - size + 1 if size else 0):
                found.setdefault(own[j : j + size].tobytes(), []).append((k, j))
        keys = sorted(found)
        self.lengths = np.array([len(k) // 4 for k in keys], np.int64)
        self.keys = np.array(keys, f"S{4 * window}") if keys else np.zeros(0, f"S{4 * window}")
        self.tops = np.array([k + b"\xff" * (4 * window - len(k)) for k in keys], f"S{4 * window}") if keys else self.keys
        self.counts = np.array([len(found[k]) for k in keys], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.counts)))[:-1].astype(np.int64) if keys else np.zeros(0, np.int64)
        self.places = np.array([p for k in keys for p in found[k]], np.int64).reshape(-1, 2)
        self.shortest = int(self.lengths.min()) if keys else 0


def suffix_array(ids: np.ndarray, row_end: np.ndarray, window: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes (word positions) of a shard and their keys of ``window`` ids; ids of 0 end a suffix."""
    n = len(ids)
    stop = np.where(ids == 0, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    length = np.minimum(np.minimum(stop, row_end) - np.arange(n), window)
    at = np.flatnonzero(length >= shortest)
    step = np.arange(window)
    padded = np.concatenate((ids, np.zeros(window, ids.dtype)))
    rows = np.where(step < length[at][:, None], padded[at[:, None] + step], 0).astype(">i4")
    keys = np.ascontiguousarray(rows).view(f"S{4 * window}").ravel()
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def search(data: np.ndarray, offsets: np.ndarray, tests: TestSuffixes):
    """Words by row, and for all occurrences of windows: row, start and length in words, and window number."""
    data = tb.LOWER[data]
    starts, ends = tb.word_spans(data, offsets, tb.ALNUM)
    bounds = tb.row_bounds(starts, offsets)
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(tests.keys):
        return bounds, none, none, none
    which, distinct = tb.encode_words(data, starts, ends)
    ids = (pc.index_in(distinct, tests.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False) + 1)[which]
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    order, keys = suffix_array(ids, row_end, tests.window, tests.shortest)
    low = np.searchsorted(keys, tests.keys, "left")
    high = np.searchsorted(keys, tests.tops, "right")
    hit = np.flatnonzero(high > low)
    counts = high[hit] - low[hit]
    at = order[tb.gather_ranges(low[hit], counts)]
    window = np.repeat(hit, counts)
    return bounds, at, tests.lengths[window], window


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _longest(at: np.ndarray, length: np.ndarray, window: np.ndarray, tests: TestSuffixes, row: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """By row: words of its longest verbatim match, its first word and the item; the first of equals."""
    each = tests.counts[window]
    place = tests.places[tb.gather_ranges(tests.begins[window], each)]
    p, n, r = np.repeat(at, each), np.repeat(length, each), np.repeat(row, each)
    shift = p - place[:, 1]
    order = np.lexsort((p, shift, place[:, 0], r))
    p, n, r, item, shift = p[order], n[order], r[order], place[order, 0], shift[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (p[1:] != p[:-1] + 1)
    cut = np.flatnonzero(fresh)
    size = np.diff(np.append(cut, len(p))) - 1 + n[cut]
    best: dict[int, tuple[int, int, int]] = {}
    for a, b, c, d in zip(r[cut].tolist(), size.tolist(), p[cut].tolist(), item[cut].tolist(), strict=True):
        if a not in best or (-b, c) < (-best[a][0], best[a][1]):
            best[a] = (b, c, d)
    return best


NEW = [
    T.StructField("n_words", T.LongType()),
    T.StructField("__spans", T.ArrayType(T.LongType(), False)),
    T.StructField("items", T.ArrayType(T.StringType(), False)),
    T.StructField("longest_match", T.LongType()),
    T.StructField("longest_word", T.LongType()),
    T.StructField("longest_item", T.StringType()),
]


def _scanner(shared, first: bool, out_schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestSuffixes = shared.value
        for block in tb.iter_blocks(batches, BLOCK_BYTES, "__text"):
            data, offsets = tb.text_bytes(block.column("__text"))
            bounds, at, length, window = search(data, offsets, tests)
            n = len(offsets) - 1
            if first:
                spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
                long = [(0, None, None)] * n
            else:
                spans, items = block.column("__spans").to_pylist(), block.column("items").to_pylist()
                long = list(zip(*(block.column(c).to_pylist() for c in ("longest_match", "longest_word", "longest_item")), strict=True))
            if len(at):
                row = np.searchsorted(bounds, at, "right") - 1
                mark = np.zeros(bounds[-1] + 1, np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + length, -1)
                mark = np.cumsum(mark)
                pair = np.unique(row * np.int64(len(tests.keys)) + window)
                pr, pw = pair // len(tests.keys), pair % len(tests.keys)
                each = tests.counts[pw]
                item = tests.places[tb.gather_ranges(tests.begins[pw], each), 0]
                ri = np.unique(np.repeat(pr, each) * np.int64(len(tests.items)) + item)
                for r, i in zip((ri // len(tests.items)).tolist(), (ri % len(tests.items)).tolist(), strict=True):
                    if tests.items[i] is not None:
                        items[r].append(tests.items[i])
                for r, (size, p, i) in _longest(at, length, window, tests, row).items():
                    if size > long[r][0]:
                        long[r] = (size, p - int(bounds[r]), tests.items[i])
                for r in np.unique(row).tolist():
                    inside = mark[bounds[r] : bounds[r + 1]] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
                    own = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                    old = spans[r]
                    merged = _merge(own + list(zip(old[::2], old[1::2], strict=True)))
                    spans[r] = [x for s in merged for x in s]
            new = {"n_words": pa.array(np.diff(bounds)), "__spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))}
            new |= {c: pa.array([x[k] for x in long], t) for k, (c, t) in enumerate((("longest_match", pa.int64()), ("longest_word", pa.int64()), ("longest_item", pa.string())))}
            yield from pa.table([new[f.name] if f.name in new else block.column(f.name) for f in out_schema], schema=out_schema).combine_chunks().to_batches()

    return run


def _pieces(items: DataFrame, window: int, part_bytes: int) -> DataFrame:
    """Items (i, t), those above ``part_bytes`` as pieces of their words that hold every window of the item."""
    step = max(1, part_bytes // 16)
    words = F.array_remove(F.split(F.translate("t", UPPER, UPPER.lower()), GAP), "")
    long = F.octet_length("t") > part_bytes
    cut = items.where(long).withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - F.lit(window), F.lit(0)), F.lit(step))))
    return items.where(~long).union(cut.select("i", F.array_join(F.slice("w", F.col("k") + 1, F.lit(step + window - 1)), " ").alias("t")))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Add to every document what of the benchmark it holds.

    Adds n_words, n_hit (words inside an occurrence of a window), ``spans``
    array<bigint> (start and end of each maximal run of hit words), ``items``
    (ids, sorted as strings), and the longest verbatim match: its words, first
    word and item.  All other columns stay; one of the same name is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    tb.arrow_batches(spark)
    items = _pieces(benchmark.select(benchmark[item_id].cast("string").alias("i"), F.coalesce(benchmark[item_text].cast("string"), F.lit("")).alias("t")), window, part_bytes)
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // part_bytes))
    new = ["n_words", "n_hit", "spans", "items", "longest_match", "longest_word", "longest_item"]
    kept = [i for i, name in enumerate(docs.columns) if name not in new]
    now = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    now = now.select(*[f"c{i}" for i in kept], F.col(f"c{docs.columns.index(text)}").cast("string").alias("__text"))
    own = [T.StructField(f"c{i}", docs.schema[i].dataType) for i in kept]
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        tests = TestSuffixes(sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1])), window)
        schema = T.StructType([*own, *([T.StructField("__text", T.StringType())] if k < parts - 1 else []), *NEW])
        now = now.mapInArrow(_scanner(spark.sparkContext.broadcast(tests), k == 0, to_arrow_schema(schema)), schema)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda s, x: x - s)  # ends minus starts: signs alternate
    found = now.select(*[f.name for f in own], "n_words", F.when(F.size("__spans") > 0, hit).otherwise(F.lit(0)).cast("long").alias("n_hit"), "__spans", "items", "longest_match", "longest_word", "longest_item")
    return found.toDF(*[docs.columns[i] for i in kept], *new)


def items_digest(items) -> str:
    """Digest of ids as the contract writes them."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
