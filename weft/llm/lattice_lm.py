"""Language-model scores from the lattice of all segmentations into existing pieces.

The pieces and their scores come from a tokenizer file.  A text's probability is the sum,
over every way to cut it into pieces, of the product of the pieces' probabilities and that
of the end of a text; bytes are pieces too, so every text has one.  As piece sequences that
end once have total probability 1, so have texts.

**Forward recursion in log space.**  Between two bytes that stand side by side in no piece
every segmentation has a cut, so a text falls into *chunks* (about: words with the space
before) that multiply.  Each distinct chunk of a block is walked once: all places go down
a trie of the pieces together, then the chunks, longest first, advance a byte at a time:
``a[t] = log sum exp(a[t - l] + log p(piece))`` over the pieces that end there.  Chunks
above ``WIDE`` bytes are walked place by place in constant memory but for ``a``.

**Learning.**  The file's scores are the first estimate; where they are ranks (merges in
order), a piece's share is that of Zipf's law.  ``rounds`` passes of expected counts, forward
and backward over every training text and weighted by how often a chunk occurs, give each
piece its share, smoothed by the first estimate.  A task sends one number a piece at most.

**Base score.**  Words of a block are counted once; of each distinct word one row goes to
the task that sums its counts over all training texts, and its count comes back to the
block.  Blocks are rows of a written table, so both passes see the same ones; a word's rows
number at most the blocks, so no word is hot.

Defined cases: a null text is empty and has the end alone; a null doc_id is a training row;
repeated rows count each; without training rows all counts are zero and the file's scores
decide; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import textblock as tb
from weft.shared import fresh_path, written

#: Bytes of text in a block; of a chunk that is searched alone; places of such a chunk that are looked at together.
BLOCK_BYTES, WIDE, WINDOW = 6 << 20, 256, 1 << 15
#: Pieces that the first estimate is worth beside the expected counts.
PRIOR = 1000.0
#: Added to a rank in Zipf's law, and the first estimate's share of ends.
ZIPF, END = 2.7, 1e-3


def file_pieces(path: str) -> list[tuple[bytes, float]]:
    """(bytes, log probability) of the pieces of a sentencepiece file; a space is a space.

    Scores that are log probabilities stay; ranks below zero become those of Zipf's law, and pieces without a rank come last.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: list[tuple[bytes, float]] = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        found.append((raw, -math.inf if model.is_byte(i) else float(model.get_score(i))))
    usual = [s for _, s in found if -1e6 < s]
    if min(usual, default=0) < -1000:
        last = -min(usual) + 1
        found = [(b, -math.log((-s if s > -1e6 else last) + ZIPF)) for b, s in found]
    else:
        found = [(b, s if s > -1e6 else min(usual, default=0) - 1) for b, s in found]
    return found


def _log_sum(c: np.ndarray) -> np.ndarray:
    """log of the sum of exp over the first axis."""
    best = c.max(0)
    c -= best
    return best + np.log(np.exp(c, out=c).sum(0))


@dataclass
class Lattice:
    """A trie of the pieces as arrays (a node is its slot), their log probabilities, and which bytes may stand side by side in a piece."""

    shift: np.ndarray
    owner: np.ndarray
    piece: np.ndarray
    pairs: np.ndarray
    logp: np.ndarray
    log_end: float
    longest: int

    def matches(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length, which of the places ``at`` start a piece that ends by ``stop``, and the piece."""
        who, node = np.arange(len(at), dtype=np.int32), np.zeros(len(at), np.int32)
        for step in range(1, self.longest + 1):
            inside = at[who] + step <= stop[who]
            who, node = who[inside], node[inside]
            slot = self.shift[node] + data[at[who] + (step - 1)]
            there = self.owner[slot] == node
            who, node = who[there], slot[there]
            if not len(who):
                return
            p = self.piece[node]
            hit = p >= 0
            yield step, who[hit], p[hit]

    def chunk_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks start: at texts, and between bytes that no piece holds side by side."""
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        if len(data):
            first[1:-1] |= ~self.pairs[data[:-1], data[1:]]
        return np.flatnonzero(first[:-1])

    def marginals(self, chunks: pa.Array, weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each distinct chunk; with weights, its expected pieces are added to ``counts``."""
        data, offsets = tb.text_bytes(chunks)
        sizes = np.diff(offsets)
        out = np.zeros(len(sizes))
        for i in np.flatnonzero(sizes > WIDE).tolist():
            out[i] = self._long(data[offsets[i] : offsets[i + 1]], 0.0 if weights is None else float(weights[i]), counts)
        rows = np.flatnonzero(sizes <= WIDE)
        rows = rows[np.argsort(-sizes[rows], kind="stable")]
        if not len(rows):
            return out
        size = sizes[rows]
        top = int(size[0])
        live = np.searchsorted(-size, -np.arange(top + 1), side="right")  # rows of at least so many bytes
        # places in the order of (place in the chunk, row), so that what starts at a place of all chunks lies together
        base = np.concatenate(([0], np.cumsum(live[1:])))
        # 32 bits hold any place of a block
        starts, ends = offsets[rows].astype(np.int32), offsets[rows + 1].astype(np.int32)
        at = np.concatenate([starts[: live[t + 1]] + np.int32(t) for t in range(top)])
        stop = np.concatenate([ends[: live[t + 1]] for t in range(top)])
        by_length = [(length, who, p, np.searchsorted(who, base)) for length, who, p in self.matches(data, at, stop)]
        forward = [np.zeros(live[0])]
        for t in range(1, top + 1):
            own = [(length, who, p, bounds[t - length], bounds[t - length + 1]) for length, who, p, bounds in by_length if length <= t]
            own = [x for x in own if x[3] < x[4]]
            c = np.full((len(own), live[t]), -np.inf)
            for j, (length, who, p, a, b) in enumerate(own):
                r = who[a:b] - base[t - length]
                c[j, r] = forward[t - length][r] + self.logp[p[a:b]]
            forward.append(_log_sum(c))
        z = np.concatenate([forward[n][(live[n + 1] if n < top else 0) : live[n]] for n in range(top, 0, -1)])
        out[rows] = z
        if counts is not None and weights is not None:
            with np.errstate(divide="ignore"):
                w = np.log(weights[rows]) - z
            backward: list[np.ndarray] = [np.zeros(0)] * (top + 1)
            backward[top] = np.zeros(live[top])
            for t in range(top - 1, -1, -1):
                own = [(length, who, p, bounds[t], bounds[t + 1]) for length, who, p, bounds in by_length if bounds[t] < bounds[t + 1]]
                c = np.full((len(own), live[t]), -np.inf)
                c[0, live[t + 1] :] = 0.0  # rows that end here
                for j, (length, who, p, a, b) in enumerate(own):
                    r, which = who[a:b] - base[t], p[a:b]
                    c[j, r] = found = self.logp[which] + backward[t + length][r]
                    counts += np.bincount(which, np.exp(forward[t][r] + found + w[r]), len(counts))
                backward[t] = _log_sum(c)
        return out

    def _long(self, data: np.ndarray, weight: float, counts: np.ndarray | None) -> float:
        """A chunk alone, some places at a time."""
        n = len(data)
        logp = self.logp
        a = np.full(n + 1, -np.inf)
        a[0] = 0.0

        def window(lo: int) -> Iterator[list[tuple[int, int]]]:
            at = np.arange(lo, min(n, lo + WINDOW))
            found = [(who + lo, np.full(len(who), length), p) for length, who, p in self.matches(data, at, np.full(len(at), n))]
            start, length, p = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(start, kind="stable")
            start, ends, p = start[order], (start + length)[order], p[order]
            cuts = np.searchsorted(start, np.append(at, at[-1] + 1)).tolist()
            pairs = list(zip(ends.tolist(), p.tolist(), strict=True))
            for i in range(len(at)):
                yield pairs[cuts[i] : cuts[i + 1]]

        def plus(x: float, y: float) -> float:
            hi, lo = (x, y) if x > y else (y, x)
            return hi + math.log1p(math.exp(lo - hi)) if lo > -math.inf else hi

        for lo in range(0, n, WINDOW):
            own = a[lo : lo + WINDOW + self.longest + 1].tolist()
            for i, pieces in enumerate(window(lo)):
                for end, p in pieces:
                    own[end - lo] = plus(own[end - lo], own[i] + logp[p])
            a[lo : lo + len(own)] = own
        z = float(a[n])
        if counts is not None and weight:
            b = np.full(n + 1, -np.inf)
            b[n] = 0.0
            for lo in range((n - 1) // WINDOW * WINDOW, -1, -WINDOW):
                own, before = b[lo : lo + WINDOW + self.longest + 1].tolist(), a[lo : min(n, lo + WINDOW)].tolist()
                for i, pieces in zip(range(len(before) - 1, -1, -1), reversed(list(window(lo))), strict=True):
                    for end, p in pieces:
                        x = own[end - lo] + logp[p]
                        own[i] = plus(own[i], x)
                        counts[p] += weight * math.exp(before[i] + x - z)
                b[lo : lo + len(own)] = own
        return z


def build(pieces: list[tuple[bytes, float]]) -> tuple[Lattice, list[bytes]]:
    """The lattice of distinct pieces (of equal ones the probabilities add), normalised with the end, and the pieces by number."""
    share: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    for raw, logp in pieces:
        if raw:
            share[raw] = share.get(raw, 0.0) + math.exp(logp)
    least = min((p for p in share.values() if p), default=1.0)
    names = sorted(share)
    p = np.array([share[x] or least for x in names])
    p *= (1 - END) / p.sum()
    kids: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    pairs = np.zeros((256, 256), bool)
    for number, raw in enumerate(names):
        node = 0
        for b in raw:
            if b not in kids[node]:
                kids[node][b] = len(kids)
                kids.append({})
                ends.append(-1)
            node = kids[node][b]
        ends[node] = number
        for x, y in zip(raw, raw[1:], strict=False):
            pairs[x, y] = True
    # children of a node lie at its shift plus their byte, widest nodes first, wherever these slots are free
    room = 2 * len(kids) + 512
    owner, shift, piece = np.full(room, -1, np.int32), np.zeros(room, np.int32), np.full(room, -1, np.int32)
    free = np.ones(room, bool)
    free[0] = False  # the root
    slot_of = {0: 0}
    by_width = sorted((i for i in range(len(kids)) if kids[i]), key=lambda i: -len(kids[i]))
    shift_of: dict[int, int] = {}
    low = 1
    for node in by_width:
        own = np.array(sorted(kids[node]))
        while not free[low]:
            low += 1
        at = low - int(own[0])
        while True:
            cand = np.flatnonzero(free[max(0, at + int(own[0])) : max(0, at + int(own[0])) + 4096]) + max(0, at + int(own[0])) - int(own[0])
            cand = cand[(cand >= 0) & (cand + int(own[-1]) < room)]
            good = cand[free[cand[:, None] + own].all(1)] if len(cand) else cand
            if len(good):
                break
            at += 4096
            if at > room:
                raise ValueError("the trie does not fit its slots")
        shift_of[node] = int(good[0])
        free[shift_of[node] + own] = False
        for b in own.tolist():
            slot_of[kids[node][b]] = shift_of[node] + b
    for node, slot in slot_of.items():
        piece[slot] = ends[node]
        shift[slot] = shift_of.get(node, 0)
        for b, kid in kids[node].items():
            owner[slot_of[kid]] = slot
            assert slot_of[kid] == shift_of[node] + b
    pad = np.full(256, -1, np.int32)
    return Lattice(shift, np.concatenate((owner, pad)), piece, pairs, np.log(p), math.log(END), max(map(len, names))), names


FIRST = "kind int, block long, doc_ids array<long>, held array<boolean>, texts array<string>, idx int, word binary, n long, piece int, mass double"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word among the distinct words of a block, those, and each text's first word."""
    low = tb.LOWER[data]
    starts, ends = tb.word_spans(low, offsets, tb.NON_SPACE)
    return *_numbered(low[tb.NON_SPACE[low]], ends - starts), tb.row_bounds(starts, offsets)


def chunks_of(lattice: Lattice, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The same of chunks."""
    starts = lattice.chunk_starts(data, offsets)
    return *_numbered(data, np.diff(np.append(starts, len(data)))), tb.row_bounds(starts, offsets)


def _numbered(joined: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each of the byte strings that lie end to end among the distinct ones, and those."""
    if not len(sizes):
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    coded = tb.binary_array(joined, np.concatenate(([0], np.cumsum(sizes)))).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _of_rows(bounds: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which items belong to kept rows."""
    return np.repeat(kept, np.diff(bounds))


def _expect(model: Lattice, data: np.ndarray, offsets: np.ndarray, train: np.ndarray, mass: np.ndarray) -> None:
    """Add the expected pieces of a block's training texts to ``mass``."""
    numbers, distinct, bounds = chunks_of(model, data, offsets)
    weights = np.bincount(numbers[_of_rows(bounds, train)], minlength=len(distinct)).astype(float)
    used = np.flatnonzero(weights)
    with tb.watched(len(data)):
        model.marginals(distinct.take(pa.array(used)), weights[used], mass)


def _later_pass(lattice):
    """Expected pieces of the blocks under another estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Lattice = lattice.value
        mass = np.zeros(len(model.logp))
        for batch in batches:
            for i in range(batch.num_rows):
                data, offsets = tb.text_bytes(batch.column("texts")[i].values)
                _expect(model, data, offsets, ~np.array(batch.column("held")[i].as_py(), bool), mass)
        found = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(mass[found])], ["piece", "mass"])

    return run


def _first_pass(lattice, block_bytes: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(FIRST))

    def rows(size: int, of: int, /, **columns) -> pa.RecordBatch:
        filled = {"kind": pa.array(np.full(size, of, np.int32))} | columns
        return pa.RecordBatch.from_arrays([filled[f.name].cast(f.type) if f.name in filled else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Lattice = lattice.value
        mass = np.zeros(len(model.logp))
        for k, block in enumerate(tb.iter_blocks(batches, block_bytes)):
            number = (TaskContext.get().partitionId() << 32) + k
            data, offsets = tb.text_bytes(block.column("text"))
            held = block.column("held").combine_chunks()
            train = ~np.array(held.to_pylist(), bool)
            one = pa.array([0, block.num_rows], pa.int32())
            as_list = lambda name: pa.ListArray.from_arrays(one, block.column(name).combine_chunks())
            yield rows(1, 0, block=pa.array([number]), doc_ids=as_list("doc_id"), held=as_list("held"), texts=as_list("text"))
            numbers, distinct, bounds = words_of(data, offsets)
            n = np.bincount(numbers[_of_rows(bounds, train)], minlength=len(distinct))
            yield rows(len(distinct), 1, block=pa.array(np.full(len(distinct), number)), idx=pa.array(np.arange(len(distinct), dtype=np.int32)), word=distinct, n=pa.array(n))
            _expect(model, data, offsets, train, mass)
        found = np.flatnonzero(mass)
        yield rows(len(found), 2, piece=pa.array(found.astype(np.int32)), mass=pa.array(mass[found]))

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, log_p double"


def _second_pass(lattice, end_known: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCORED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Lattice = lattice.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, held, texts, idx, c = (batch.column(k)[i].values for k in ("doc_ids", "held", "texts", "idx", "c"))
                data, offsets = tb.text_bytes(texts)
                numbers, distinct, bounds = words_of(data, offsets)
                count = np.zeros(len(distinct), np.int64)
                if idx is not None:
                    count[idx.to_numpy()] = c.to_numpy()
                own = count[numbers]
                known = tb.per_row_sum((own > 0).astype(np.int64), bounds) + (end_known > 0)
                logs = tb.per_row_sum(np.log10(own + 1.0), bounds) + math.log10(end_known + 1.0)
                numbers, distinct, at = chunks_of(model, data, offsets)
                with tb.watched(len(data)):
                    z = model.marginals(distinct)
                total = tb.per_row_sum(z[numbers], at) + model.log_end
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(np.diff(bounds) + 1), pa.array(known), pa.array(logs), pa.array(total / math.log(10))], schema=schema)

    return run


def score(docs: DataFrame, held: Column, pieces: list[tuple[bytes, float]], block_bytes: int = BLOCK_BYTES, prior: float = PRIOR, rounds: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): scores are log10 probabilities of whole texts.

    Rows for which ``held`` is true are not learned from.  ``rounds`` is 1 at least.
    """
    spark = docs.sparkSession
    tb.arrow_batches(spark)
    first, _ = build(pieces)
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    shared = spark.sparkContext.broadcast(first)
    path = fresh_path(spark, "blocks")
    # a row of blocks holds megabytes: row groups of a few, as readers decode a group at a time
    given.mapInArrow(_first_pass(shared, block_bytes), FIRST).write.option("parquet.block.size", 2 * block_bytes).parquet(path)
    table = spark.read.schema(FIRST).parquet(path)
    blocks = table.where("kind = 0").select("block", "doc_ids", "held", "texts")
    train_docs = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    estimate = np.append(first.logp, first.log_end)
    for turn in range(rounds):
        found = table.where("kind = 2").select("piece", "mass") if not turn else blocks.select("held", "texts").mapInArrow(_later_pass(spark.sparkContext.broadcast(learned)), "piece int, mass double")
        masses = found.groupBy("piece").agg(F.sum("mass").alias("mass")).toArrow()  # one row a piece at most
        mass = np.zeros(len(estimate))
        mass[masses.column("piece").to_numpy()] = masses.column("mass").to_numpy()
        mass[-1] = train_docs
        share = mass + prior * np.exp(estimate)
        logs = np.log(share / share.sum())
        learned = Lattice(first.shift, first.owner, first.piece, first.pairs, logs[:-1], float(logs[-1]), first.longest)
    same = Window.partitionBy("word")
    words = table.where("kind = 1").select("block", "idx", "word", "n")
    counted = written(words.select("block", "idx", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("block", "idx")) == 1).alias("first")), "counts")
    total = counted.where("first AND c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = (total.n or 0) + train_docs, total.v + (train_docs > 0)
    back = counted.groupBy("block").agg(F.collect_list("idx").alias("idx"), F.collect_list("c").alias("c"))
    joined = blocks.join(back.hint("shuffle_hash"), "block", "left").select("doc_ids", "held", "texts", "idx", "c")
    found = joined.mapInArrow(_second_pass(spark.sparkContext.broadcast(learned), train_docs), SCORED)
    base = F.col("logs") - F.col("n_tokens") * math.log10(tokens + kinds + 1)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("log_p").alias("score"))
