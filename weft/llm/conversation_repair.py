"""Repair of conversations: the cheapest edits that give a legal order of roles.

A legal conversation has role initials ``(s?(ua)+)?``.  Its rows are kept (0), given
another role (2), deleted (3; a must for blank and repeated rows) or preceded by new
empty rows (2 each); a truncated row that stays costs 1.  Of the cheapest edits those
with the ASCII-least string of initials (D, I, K, R) count.

**Rank-compressed search over layers.**  An edit of a row is a macro: a run of inserts
and what becomes of the row, as a code ``I*X``.  No code is the beginning of another,
so of two lists of equally many codes the first different code decides, whatever
follows.  A layer (the rows so far) therefore needs no strings: per state of the
pattern (start, after s, after u, after a) it holds the least cost and the *rank* of
its string among the layer's, and which state and code it came from.  Ranks of the next
layer come from (rank of the parent, order of the code).  A run of three or more
inserts reaches the state that two fewer reach, so codes have two at most.  Strings and
roles are written down only once, backwards from the last layer.

**Long conversations in parts.**  Rows are dealt by ranges of (conversation, turn, role),
so a large conversation covers many partitions; what lies in one is a *segment*.  Each
segment is searched from all four states at once, with ranks among the strings from the
same state; per conversation the segments are joined by the same rule, a segment being
one long code; then each segment, its start and end now known, is reconstructed.  All
segments of a batch advance together in numpy, a layer at a time.  Last, a conversation's
rows stream in order past its edits into the digest, which has to see them in order.

Defined cases: a null role or text is one space, a null conv_id or turn one space in the
damage key; null conversations are one conversation; rows of one turn are ordered by role
and text (null turns first), equal rows stay side by side and count each; a role that is
empty has no initial and cannot be kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import textblock as tb
from weft.shared import written

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State after a row of class s (0), u (1), a (2) in each state; -1: not legal.  Class 3 (any other role) is never legal.
STEP = [[AFTER_S, AFTER_U, -1], [-1, AFTER_U, -1], [-1, -1, AFTER_A], [-1, AFTER_U, -1]]
#: What follows in each state where u or a is inserted or given.
NEXT = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]
#: Inserts that end a conversation in each state.
CLOSE = [0, 2, 1, 0]
CODES = sorted("I" * n + x for n in range(3) for x in "DKR")
FAR = 1 << 40
BLANK, AGAIN, CUT = 4, 8, 16  # a row's code: class + these flags; at most one of them


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """Cost and order of the best code by (row code, state before, state after)."""
    cost, order = np.full((32, 4, 4), FAR), np.full((32, 4, 4), len(CODES))
    for code, p, (k, macro) in itertools.product(range(32), range(4), enumerate(CODES)):
        q, price = p, 0
        for _ in macro[:-1]:
            q, price = NEXT[q], price + 2
        gone = bool(code & (BLANK | AGAIN))
        if macro[-1] == "D":
            price += 3
        elif gone:
            continue
        else:
            q, price = (NEXT[q], price + 2) if macro[-1] == "R" else (STEP[q][code & 3] if code & 3 < 3 else -1, price)
            price += bool(code & CUT)
            if q < 0:
                continue
        if (price, k) < (cost[code, p, q], order[code, p, q]):
            cost[code, p, q], order[code, p, q] = price, k
    return cost, order


COST, ORDER = _moves()


def search(rows: list[bytes], pointers: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Cost and rank by (segment, first state, last state); ``pointers``: also each layer's parent state and code order.

    ``rows`` are row codes; segments come longest first, so that those still open are a prefix.
    """
    n = len(rows)
    sizes = np.array([len(r) for r in rows])
    cost = np.full((n, 4, 4), FAR)
    cost[:, range(4), range(4)] = 0
    rank = np.tile(np.arange(4), (n, 4, 1))
    flat = np.frombuffer(b"".join(rows), np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else np.zeros(0, int)
    came: list[np.ndarray] = []
    codes = len(CODES) + 1
    for t in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        code = flat[first[:live] + t]
        c, o = cost[:live, :, :, None] + COST[code][:, None], rank[:live, :, :, None] * codes + ORDER[code][:, None]
        key = np.minimum(c, FAR) * 64 + o
        parent = key.argmin(2)
        best = np.take_along_axis(key, parent[:, :, None], 2)[:, :, 0]
        cost[:live] = best // 64
        rank[:live] = np.where(best // 64 < FAR, best % 64, 64).argsort(2, kind="stable").argsort(2, kind="stable")
        if pointers:
            came.append((parent * 16 + best % 64 % codes).astype(np.uint8))
    return cost, rank, came


def join_segments(costs: list[np.ndarray], ranks: list[np.ndarray]) -> tuple[int, list[tuple[int, int]], int]:
    """Cost, (first, last state) of every segment and closing inserts of a conversation from its segments' tables."""
    cost, rank = np.array([0, FAR, FAR, FAR]), np.arange(4)
    parents = []
    for c, r in zip(costs, ranks, strict=True):
        key = np.minimum(cost[:, None] + c, FAR) * 16 + rank[:, None] * 4 + r
        parents.append(key.argmin(0))
        best = key.min(0)
        cost = best // 16
        rank = np.where(cost < FAR, best % 16, 16).argsort(kind="stable").argsort(kind="stable")
    total = cost + 2 * np.array(CLOSE)
    last = int((np.minimum(total, FAR) * 4 + rank).argmin())
    ends = [last]
    for p in reversed(parents):
        ends.append(int(p[ends[-1]]))
    ends.reverse()
    return int(total[last]), list(itertools.pairwise(ends)), CLOSE[last]


def reconstruct(rows: list[bytes], ends: list[tuple[int, int]]) -> list[bytes]:
    """Of every segment the order of the code of each of its rows."""
    _, _, came = search(rows, pointers=True)
    out = []
    for i, (r, (first, last)) in enumerate(zip(rows, ends, strict=True)):
        found = bytearray(len(r))
        for t in range(len(r) - 1, -1, -1):
            p = int(came[t][i, first, last])
            found[t], last = p & 15, p >> 4
        out.append(bytes(found))
    return out


def damage(conversations: DataFrame, key: Column, period: int = 20) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of ``key`` modulo ``period``: 0 dropped, 1 emptied, 2 without ends of sentences, 3 repeated, 4 from the user."""
    fault = F.pmod(F.crc32(key), F.lit(period))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    return rows.where(F.col("fault") != 0).withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def cleaned(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a space for a null role or text."""
    c = conversations
    space = F.lit(" ")
    return c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), space).alias("role"), F.coalesce(c["text"].cast("string"), space).alias("text"))


def _by_length(found: list[int]) -> tuple[list[int], list[int]]:
    order = sorted(range(len(found)), key=lambda i: -found[i])
    back = [0] * len(order)
    for place, i in enumerate(order):
        back[i] = place
    return order, back


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = pdf.codes.tolist()
        order, back = _by_length([len(r) for r in rows])
        cost, rank, _ = search([rows[i] for i in order])
        yield pdf.assign(cost=[cost[k].ravel().tolist() for k in back], rank=[rank[k].ravel().tolist() for k in back])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for conv, parts in zip(pdf.conv_id, pdf.parts, strict=True):
            tables = [[np.array(x).reshape(4, 4) for x in (p["cost"], p["rank"])] for p in parts]
            cost, ends, close = join_segments([t[0] for t in tables], [t[1] for t in tables])
            out += [(conv, p["seg"], a, b, close if i == len(ends) - 1 else 0, cost if i == 0 else 0) for i, (p, (a, b)) in enumerate(zip(parts, ends, strict=True))]
        yield pd.DataFrame(out, columns=["conv_id", "seg", "first", "last", "close", "cost"]).astype({"conv_id": "Int64"})


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = pdf.codes.tolist()
        order, back = _by_length([len(r) for r in rows])
        firsts, lasts = pdf["first"].tolist(), pdf["last"].tolist()
        found = reconstruct([rows[i] for i in order], [(firsts[i], lasts[i]) for i in order])
        yield pdf[["conv_id", "seg", "least", "close", "cost", "codes"]].assign(edits=[found[k] for k in back])


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Stream:
    """What a conversation has shown so far."""

    def __init__(self, conv) -> None:
        self.conv, self.sha, self.first = conv, hashlib.sha256(), True
        self.least = self.most = self.turn = None
        self.turns = self.cost = self.close = self.state = self.blank = self.again = self.cut = self.illegal = 0
        self.before, self.audit, self.edits, self.codes, self.at = None, [], b"", b"", 0

    def put(self, role: str, text: str) -> None:
        self.sha.update((role + ":" + text if self.first else "\n" + role + ":" + text).encode())
        self.first = False

    def new(self) -> None:
        """An inserted row, by the state."""
        self.state = NEXT[self.state]
        self.put("user" if self.state == AFTER_U else "assistant", "")

    def header(self, edits: bytes, codes: bytes, close: int, cost: int) -> None:
        self.edits, self.codes, self.at = edits, codes, 0
        self.close, self.cost = close, self.cost + cost
        self.audit.append("".join(CODES[e] for e in edits))

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.turn
            self.most = self.turn = turn
        code, macro = self.codes[self.at], CODES[self.edits[self.at]]
        self.at += 1
        self.blank += bool(code & BLANK)
        self.again += bool(code & AGAIN)
        self.cut += bool(code & CUT)
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        for _ in macro[:-1]:
            self.new()
        if macro[-1] == "R":
            self.state = NEXT[self.state]
            self.put("user" if self.state == AFTER_U else "assistant", text)
        elif macro[-1] == "K":
            self.state = STEP[self.state][code & 3]
            self.put(role, text)

    def result(self) -> tuple:
        for _ in range(self.close):
            self.new()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv, gaps, self.blank, self.again, self.cut, self.illegal, self.cost, "".join(self.audit) + "I" * self.close, self.sha.hexdigest()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by conversation and place: a marker, then per segment its edits and its rows."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in RESULT.split(", ")]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    now: _Stream | None = None
    for batch in batches:
        done = []
        for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            conv, _, kind, turn, role, text, edits, codes, close, cost = r
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.result())
                now = _Stream(conv)
            if kind == 1:
                now.header(edits, codes, close, cost)
            elif kind == 2:
                now.row(turn, role, text)
        yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, now.result(), strict=True))], schema)


def repair(rows: DataFrame, conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per conv_id of ``conversations``: faults, cost, audit and digest of the repaired ``rows`` (conv_id, turn, role, text)."""
    spark = rows.sparkSession
    tb.arrow_batches(spark)
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text")
    placed = written(dealt.withColumn("seg", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "turns")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    bare = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    said = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    facts = placed.select("conv_id", "seg", "pos", role.alias("role"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), said.alias("said"))
    # of what is said in a conversation, all but the first are repeats; only what is said more than once is looked up
    firsts = facts.groupBy("conv_id", "said").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first_pos")
    marked = facts.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    flag = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first_pos"), AGAIN).when(F.col("cut"), CUT).otherwise(0)
    coded = marked.select("conv_id", "seg", F.struct("pos", (F.col("role") + flag).cast("tinyint").alias("code")).alias("r"))
    listed = coded.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("r")).alias("r"))
    hexed = F.array_join(F.transform("r", lambda x: F.lpad(F.hex(x.code), 2, "0")), "")
    segments = listed.select("conv_id", "seg", F.col("r")[0].pos.alias("least"), F.unhex(hexed).alias("codes"))
    tables = written(segments.mapInPandas(_searched, "conv_id long, seg int, least long, codes binary, cost array<long>, rank array<long>"), "segments")
    whole = tables.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "cost", "rank"))).alias("parts"))
    ends = whole.mapInPandas(_joined, "conv_id long, seg int, first int, last int, close int, cost long").withColumnsRenamed({"conv_id": "c", "seg": "g", "cost": "total"})
    known = tables.select("conv_id", "seg", "least", "codes").join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("g")))
    edits = known.select("conv_id", "seg", "least", "codes", "first", "last", "close", F.col("total").alias("cost")).mapInPandas(_rebuilt, "conv_id long, seg int, least long, close int, cost long, codes binary, edits binary")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("edits", "binary"), ("codes", "binary"), ("close", "int"), ("cost", "long"))]
    markers = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind"), *none)
    heads = edits.select("conv_id", F.col("least").alias("pos"), F.lit(1).alias("kind"), *none[:3], "edits", "codes", "close", "cost")
    lines = placed.select("conv_id", "pos", F.lit(2).alias("kind"), "turn", "role", "text", *none[3:])
    stream = markers.unionAll(heads).unionAll(lines)
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind").mapInArrow(_streamed, RESULT)
