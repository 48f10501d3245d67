"""Lattice scores against enumerated segmentations, expected counts against gradients, base scores against plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import lattice_lm as lm
from weft.llm import sampling

PIECES = [(b"ab", -1.0), (b"abc", -2.0), (b"bc", -1.5), (b" a", -1.2), (b" ab", -2.5), (b"aa", -1.0), (b"a", -0.7), ("é".encode(), -3.0), ("é".encode(), -4.0), (b"  ", -2.0)]


def every(data: bytes, logs: dict) -> float:
    """Sum over all segmentations, by recursion on the first piece."""
    return 1.0 if not data else sum(math.exp(p) * every(data[len(x) :], logs) for x, p in logs.items() if data.startswith(x))


@pytest.fixture(scope="module")
def lattice():
    return lm.build(PIECES)


def logs_of(lattice):
    model, names = lattice
    return dict(zip(names, model.logp.tolist(), strict=True))


def test_shares_and_trie(lattice):
    model, names = lattice
    assert math.isclose(np.exp(model.logp).sum() + math.exp(model.log_end), 1)
    logs = logs_of(lattice)
    assert len(names) == len(set(names)) and set(x for x, _ in PIECES) <= set(names) and len(names) == 256 + 8
    assert math.isclose(logs["é".encode()] - logs[b"aa"], math.log((math.exp(-3) + math.exp(-4)) / math.exp(-1)))
    for raw in (b"abc", b" ab", "é".encode()):
        data = np.frombuffer(raw + b"zz", np.uint8)
        got = {(n, names[p[0]]) for n, who, p in model.matches(data, np.array([0]), np.array([len(data)])) if len(who)}
        assert got == {(len(x), x) for x in names if (raw + b"zz").startswith(x)}


@pytest.mark.parametrize("wide", [256, 0])
def test_marginals_and_expected_counts(lattice, wide, monkeypatch):
    monkeypatch.setattr(lm, "WIDE", wide)
    monkeypatch.setattr(lm, "WINDOW", 3)
    model, names = lattice
    logs = logs_of(lattice)
    chunks = [b"ab", b"abcab", b" aab", "éa".encode(), b"x", b"aaaaaa", b"   ab", bytes(range(200, 206))]
    weights = np.array([1.0, 3, 0, 2, 1, 5, 1, 1])
    mass = np.zeros(len(names))
    z = model.marginals(pa.array(chunks, pa.binary()), weights, mass)
    assert np.allclose(z, [math.log(every(c, logs)) for c in chunks], rtol=1e-12)
    # the expected count of a piece is the derivative of the log probability by its log share
    for piece in (b"ab", b"abc", b"a", b"bc", b"aa", b" a", b"  "):
        moved = {s: {k: v + s * (k == piece) for k, v in logs.items()} for s in (1e-5, -1e-5)}
        slope = sum(w * (math.log(every(c, moved[1e-5])) - math.log(every(c, moved[-1e-5]))) / 2e-5 for c, w in zip(chunks, weights, strict=True))
        assert math.isclose(mass[names.index(piece)], slope, rel_tol=1e-5, abs_tol=1e-7)


def test_chunks_multiply(lattice):
    model, _ = lattice
    text = "abc ab\naab  abé ab".encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 7, 7, len(text)])
    numbers, distinct, bounds = lm.chunks_of(model, data, offsets)
    z = model.marginals(distinct)[numbers]
    for i in range(3):
        assert math.isclose(z[bounds[i] : bounds[i + 1]].sum(), math.log(every(text[offsets[i] : offsets[i + 1]], logs_of(lattice))), rel_tol=1e-12)
    assert len(numbers) > 5


def brute(rows, modulus=7, fold=2):
    held = [i is not None and zlib.crc32(str(i).encode()) % modulus == fold for i, _ in rows]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") for _, t in rows]
    words = [[w for w in ws if w] + [None] for ws in words]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), h, ws in zip(rows, held, words, strict=True)), key=repr)


def rows():
    texts = ["Abc ab. ab", "ab\tAB\n\nabé É", None, "", "   ", "a" * 700, "ab " * 4000 + "x", "Zß ß zß", "ab", "ab", "abcabcabc " * 40, "\x00ab\x01 c c"]
    return [(i, texts[i % len(texts)]) for i in range(60)] + [(5, "ab ab"), (5, "ab ab"), (None, "null id ab")]


@pytest.mark.parametrize("block", [6 << 20, 50])
def test_whole_query_against_plain_counts(spark, block):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows()], "doc_id long, text string, held string, score double").repartition(3)
    got = lm.score(df, sampling.in_fold(F.col("doc_id"), 7, 2), PIECES, block_bytes=block).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == brute(rows())
    by_text = {}
    ids = dict(rows())
    for r in got:
        if r.doc_id is not None and r.doc_id != 5:
            by_text.setdefault(ids[r.doc_id], set()).add(round(r.score, 9))
    assert all(len(v) == 1 for v in by_text.values()) and by_text[None] == by_text[""] and max(v for x in by_text.values() for v in x) < 0


def test_blocks_change_nothing(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    held = sampling.in_fold(F.col("doc_id"), 7, 2)
    one, many = (sorted(((r.doc_id, round(r.score, 8)) for r in lm.score(df.repartition(n), held, PIECES, block_bytes=b).collect()), key=repr) for n, b in ((1, 1 << 20), (5, 64)))
    assert one == many


def test_empty_table_and_no_training_rows(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert lm.score(df.where("doc_id > 1"), F.lit(False), PIECES).collect() == []
    row = lm.score(df, F.lit(True), PIECES).first()
    model, names = lm.build(PIECES)
    want = math.log10(every(b"ab", dict(zip(names, model.logp.tolist(), strict=True)))) + model.log_end / math.log(10)
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0.0) and math.isclose(row.score, want, rel_tol=1e-9)


def test_existing_vocabulary():
    import public_tokenizers

    pieces = lm.file_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    shares = dict(pieces)
    assert shares[b" t"] > shares[b"in"] > shares[b" the"] > shares["ö".encode()] > -math.inf and all(bytes([b]) in shares for b in range(256))
    model, names = lm.build(pieces)
    text = b" the house"
    got = model.marginals(pa.array([text], pa.binary()))[0]
    assert math.isclose(got, math.log(every(text, dict(zip(names, model.logp.tolist(), strict=True)))), rel_tol=1e-10)
