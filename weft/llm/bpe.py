"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The texts of a partition are taken in corpus blocks of bounded size.  A block's
texts are cut into pieces by the tokenizer's pattern, the *distinct* pieces are
laid out as one linked list of byte tokens, and an inverted index holds, for
every rank, the positions whose token pair merges to that rank.  Ranks are
replayed in ascending order from a heap; a merge touches only its own position
and its two neighbours, whose new pairs enter the index.  Each distinct piece is
thus encoded once for all its occurrences in the block.  A piece that is itself a
token is its id at once, as in the library; the replay has the others.

A word table of the whole corpus would need every (document, piece) pair in a
shuffle: rare pieces dominate web text, so that table is nearly as large as the
text.  Blocks need no shuffle at all, the result is the same, and a lost
executor costs only the blocks it held.

Defined cases: a null or empty text has no tokens; ids, counts and digests do
not depend on how rows fall into blocks; repeated rows repeat their result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weft.llm import textblock as tb

#: Bytes of text in a corpus block; bounds a worker's memory at some 15 times this.
BLOCK_BYTES = 4 << 20
NONE = np.iinfo(np.int32).max

#: The pattern that ``split_pieces`` implements on arrays; any other goes through the ``regex`` module.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Ranks:
    """A rank file's tables: vocabulary, byte ids and every pair of tokens that joins to a token."""

    def __init__(self, vocabulary: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        size = max(vocabulary.values()) + 1
        self.tokens = [b""] * size
        for token, rank in vocabulary.items():
            self.tokens[rank] = token
        self.size = size
        self.byte_ids = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        left, right, joined = [], [], []
        for token, rank in vocabulary.items():
            for cut in range(1, len(token)):
                a, b = vocabulary.get(token[:cut]), vocabulary.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(rank)
        keys = np.array(left, np.int64) * size + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.joined = keys[order], np.array(joined, np.int32)[order]
        pairs = self.byte_ids[:, None].astype(np.int64) * size + self.byte_ids[None, :]
        self.byte_pairs = self.lookup(pairs.ravel()).reshape(256, 256)

    @classmethod
    def load(cls, path: str, pattern: str = BYTE_PATTERN) -> Ranks:
        """Read a file of base64 tokens and ranks."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}, pattern)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the token each pair joins to, NONE where there is none."""
        if not len(self.keys):
            return np.full(len(keys), NONE, np.int32)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.joined[at], NONE)

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        """Tokens as bytes, and ids as decimal text with a space behind; by id."""
        return pa.array(self.tokens, pa.binary()), pa.array([b"%d " % i for i in range(self.size)], pa.binary())


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """By code point: 0 other, 1 letter, 2 number, 3 white space."""
    if not _CLASSES:
        import unicodedata

        table = np.zeros(0x110000, np.uint8)
        for point in range(0x110000):
            major = unicodedata.category(chr(point))[0]
            if major == "L":
                table[point] = 1
            elif major == "N":
                table[point] = 2
        table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = 3
        _CLASSES.append(table)
    return _CLASSES[0]


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets of the pieces that BYTE_PATTERN cuts; they cover every row, and end with the total."""
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(1, np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    kind = _classes()[points]
    row = np.zeros(n_bytes + 1, bool)
    row[offsets] = True
    row = np.append(row[:-1][at], True)  # a row starts at this code point
    start = np.ones(n + 1, bool)
    start[1:-1] = kind[1:] != kind[:-1]
    start |= row
    # white space before other text: its last blank goes with that text, or stands alone
    space = kind == 3
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~row[1:-1])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # contractions: an apostrophe that starts a piece, then the letters of a suffix
    q = np.flatnonzero((points == 39) & start[:-1])
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == 1) & ~row[q + 1]]
    one = np.isin(points[q + 1], [ord(c) for c in "stmd"])
    rest = q[~one]
    rest = rest[rest + 2 < n]
    rest = rest[~row[rest + 2]]
    a, b = points[rest + 1], points[rest + 2]
    two = rest[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
    q = q[one]
    start[q + 1] = False
    start[q + 2] = True
    start[two + 1] = False
    start[two + 3] = True
    return np.append(at[np.flatnonzero(start[:-1])], n_bytes)


def _pieces(data: np.ndarray, offsets: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Piece starts and ends; with another pattern, text between its matches is left out."""
    if pattern == BYTE_PATTERN:
        cuts = split_pieces(data, offsets)
        return cuts[:-1], cuts[1:]
    import regex

    found, starts, ends = regex.compile(pattern), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        at = a
        text = data[a:b].tobytes().decode("utf-8")
        done = 0
        for m in found.finditer(text):
            at += len(text[done : m.start()].encode())
            size = len(m.group().encode())
            if size:
                starts.append(at)
                ends.append(at + size)
            at, done = at + size, m.end()
    return np.array(starts, np.int64), np.array(ends, np.int64)


def replay(data: np.ndarray, offsets: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of byte strings laid end to end, and the offset of each string's first id."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    size = ranks.size
    token = np.append(ranks.byte_ids[data], 0)
    following = np.arange(1, n + 2)
    previous = np.arange(-1, n)
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    following[ends] = n  # n stands for none
    previous[ends + 1] = -1
    previous = np.append(previous, -1)[: n + 1]
    pair = np.full(n + 1, NONE, np.int32)
    pair[: n - 1] = ranks.byte_pairs[data[:-1], data[1:]]
    pair[ends] = NONE
    alive = np.ones(n, bool)
    chosen = np.zeros(n + 1, bool)

    order = np.argsort(pair[:n], kind="stable")
    order = order[: int(np.count_nonzero(pair[:n] != NONE))]
    present, first = np.unique(pair[order], return_index=True)
    last = np.append(first[1:], len(order))
    index: dict[int, list[np.ndarray]] = {r: [order[a:b]] for r, a, b in zip(present.tolist(), first.tolist(), last.tolist(), strict=True)}
    heap = present.tolist()
    while heap:
        rank = heapq.heappop(heap)
        postings = index.pop(rank, None)
        if postings is None:
            continue
        at = postings[0] if len(postings) == 1 else np.concatenate(postings)
        at = at[pair[at] == rank]
        if not len(at):
            continue
        if len(at) > 1:
            at = np.unique(at)
        mate = following[at]
        if len(at) > 1:
            chosen[at] = True
            clash = chosen[mate]
            if clash.any():  # a run such as "aaaa": from the left, every other pair
                for p, m in zip(at[clash].tolist(), mate[clash].tolist(), strict=True):
                    if chosen[p]:
                        chosen[m] = False
                keep = chosen[at]
                chosen[at] = False
                at, mate = at[keep], mate[keep]
            else:
                chosen[at] = False
        after = following[mate]
        token[at] = rank
        alive[mate] = False
        pair[mate] = NONE
        following[at] = after
        inner = after < n
        previous[after[inner]] = at[inner]
        left = previous[at]
        left = left[left >= 0]
        touched = np.concatenate((at, left))
        right = following[touched]
        fresh = np.where(right < n, ranks.lookup(token[touched].astype(np.int64) * size + token[right]), NONE)
        pair[touched] = fresh
        real = fresh != NONE
        if real.any():
            touched, fresh = touched[real], fresh[real]
            if len(fresh) == 1:
                groups = [(int(fresh[0]), touched)]
            else:
                by = np.argsort(fresh, kind="stable")
                touched, fresh = touched[by], fresh[by]
                cut = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1
                groups = list(zip(fresh[np.append(0, cut)].tolist(), np.split(touched, cut), strict=True))
            for r, positions in groups:
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heapq.heappush(heap, r)
    count = np.concatenate(([0], np.cumsum(alive)))
    return token[:n][alive], count[offsets]


def encode_block(data: np.ndarray, offsets: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a block of texts, and the offset of each text's first id."""
    starts, ends = _pieces(data, offsets, ranks.pattern)
    bounds = tb.row_bounds(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    whole = ranks.pattern == BYTE_PATTERN
    coded = tb.binary_array(data, np.append(starts, ends[-1])).dictionary_encode() if whole else None
    if coded is not None:
        which, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    else:
        which, distinct = tb.encode_words(data, starts, ends)
    vocabulary = pa.array(ranks.tokens, pa.binary())
    direct = pc.index_in(distinct, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    known = direct >= 0
    rest = distinct.filter(pa.array(~known))
    piece_offsets = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1].astype(np.int64) if len(rest) else np.zeros(1, np.int64)
    piece_data = np.frombuffer(rest.buffers()[2], np.uint8)[piece_offsets[0] : piece_offsets[-1]] if len(rest) else np.zeros(0, np.uint8)
    ids, id_offsets = replay(piece_data, piece_offsets - piece_offsets[0], ranks)
    count = np.ones(len(distinct), np.int64)
    count[~known] = np.diff(id_offsets)
    begin = np.concatenate(([0], np.cumsum(count)))
    table = np.empty(int(begin[-1]), np.int32)
    table[begin[:-1][known]] = direct[known]
    table[tb.gather_ranges(begin[:-1][~known], count[~known])] = ids
    counts = count[which]
    out = table[tb.gather_ranges(begin[:-1][which], counts)]
    return out, np.concatenate(([0], np.cumsum(counts)))[bounds]


def decode_ids(ids: np.ndarray, tokens: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Bytes of a run of ids, and the offset of each id's bytes."""
    taken = tokens.take(pa.array(ids))
    if not len(taken):
        return memoryview(b""), np.zeros(1, np.int64)
    at = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1].astype(np.int64)
    return memoryview(taken.buffers()[2]), at


def encode(df: DataFrame, ranks_path: str, pattern: str = BYTE_PATTERN, text: str = "text", with_ids: bool = True, digests: bool = False) -> DataFrame:
    """Add ``n_tokens`` long and, as asked, ``ids`` array<int> and the digests of ids and decoded bytes.

    All columns of ``df`` stay; a column of the same name as a new one is replaced.
    ``ranks_path`` is read on the driver; its tables (a few MB, fixed by the file)
    go to the executors as a broadcast variable.
    """
    new = [T.StructField("n_tokens", T.LongType())]
    if with_ids:
        new.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    if digests:
        new += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType())]
    shared = df.sparkSession.sparkContext.broadcast(Ranks.load(ranks_path, pattern))

    def start():
        ranks: Ranks = shared.value
        tokens, decimals = ranks.arrays()

        def compute(data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
            ids, bounds = encode_block(data, offsets, ranks)
            columns: dict[str, pa.Array] = {"n_tokens": pa.array(np.diff(bounds))}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            if digests:
                text, text_at = decode_ids(ids, decimals)
                back, back_at = decode_ids(ids, tokens)
                hashes, backs, exact = [], [], []
                for a, b, c, d in zip(bounds[:-1].tolist(), bounds[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    hashes.append(hashlib.sha256(text[text_at[a] : max(text_at[a], text_at[b] - 1)]).hexdigest())
                    piece = back[back_at[a] : back_at[b]]
                    backs.append(hashlib.sha256(piece).hexdigest())
                    exact.append(bytes(piece) == data[c:d].tobytes())
                columns |= {"ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(backs, pa.string()), "exact": pa.array(exact, pa.bool_())}
            return columns

        return compute

    return tb.map_texts(df, text, new, start, BLOCK_BYTES)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes of ``ids`` (null ids: null) as a binary column."""
    from pyspark.sql import functions as F

    shared = df.sparkSession.sparkContext.broadcast(Ranks.load(ranks_path).tokens)

    @F.pandas_udf(T.BinaryType())
    def joined(column):
        tokens = shared.value
        return column.map(lambda x: None if x is None else b"".join([tokens[i] for i in x]))

    return df.withColumn(into, joined(ids))
