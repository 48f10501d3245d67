"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word is a run of letters; its parts are the word itself and its byte n-grams of
two to five bytes with marks for its ends, hashed to 16 bits.  A text's vector is
the mean over its words of the mean embedding of the parts; a linear softmax
gives the language.  Embeddings and softmax are trained in numpy by stochastic
gradient descent on random stretches of the training texts, so short texts are
as familiar as long ones.  As everything before the softmax is a mean, scoring
adds one row of logits per part of each *distinct* word of a block.

A temperature and a rejection limit are calibrated on training texts set aside:
the limit is the lowest confidence from which on at least ``PRECISION`` of them
are right.  Training takes at most ``PER_LANG`` texts a language and ``SAMPLE`` in all.

Defined cases: a null text, or one without any letter, is ``und`` with score 0;
if nothing can be learned every text is ``und``; null languages are not learned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import sampling
from weft.llm import textblock as tb

PER_LANG, SAMPLE = 900, 3600
#: Bytes of all training texts.
LANG_BYTES = 32 << 20
BUCKETS, SIZE = 1 << 16, 16
GRAMS = (2, 3, 4, 5)
PRECISION = 0.99
BLOCK_BYTES = 4 << 20

_WORD = tb.ALNUM.copy()
_WORD[48:58] = False
_WORD[65:91] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    out = tb.LOWER[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def word_parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every part of the distinct words, and each word's first part."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
    size = np.diff(at)
    starts = np.concatenate(([0], np.cumsum(size + 2)))
    marked = np.full(int(starts[-1]), 1, np.uint64)
    marked[starts[1:] - 1] = 2
    marked[tb.gather_ranges(starts[:-1] + 1, size)] = raw
    word = np.repeat(np.arange(n), size + 2)
    end = np.repeat(starts[1:], size + 2)
    place = np.arange(len(marked))
    buckets, owner = [], []
    key = np.zeros(len(marked), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(marked), np.uint64)
        shifted[: len(marked) - k + 1] = marked[k - 1 :]
        key = (key ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        if k in GRAMS:
            fits = place + k <= end
            buckets.append(key[fits] >> np.uint64(48))
            owner.append(word[fits])
    whole = np.add.reduceat(marked * (place.astype(np.uint64) - np.repeat(starts[:-1], size + 2).astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93), starts[:-1])
    buckets.append((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
    owner.append(np.arange(n))
    buckets, owner = np.concatenate(buckets).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.searchsorted(owner[order], np.arange(n + 1))


class SubwordSoftmax:
    """Embeddings, softmax, temperature and rejection limit."""

    def __init__(self) -> None:
        self.langs: list[str] = []
        self.limit = 0.0

    def _words(self, data: np.ndarray, offsets: np.ndarray):
        low = lowered(data)
        starts, ends = tb.word_spans(low, offsets, _WORD)
        which, distinct = tb.encode_words(low, starts, ends)
        return which, distinct, tb.row_bounds(starts, offsets)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Softmax of every text of a block."""
        which, distinct, bounds = self._words(data, offsets)
        parts, at = word_parts(distinct)
        words = tb.per_row_sum(self.table[parts], at) / np.maximum(np.diff(at), 1)[:, None]
        logit = tb.per_row_sum(words[which], bounds) / np.maximum(np.diff(bounds), 1)[:, None] + self.bias
        logit = logit * self.scale
        p = np.exp(logit - logit.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def fit(self, sample: pd.DataFrame, epochs: int = 4, seed: int = 11) -> SubwordSoftmax:
        """Train on text and lang; every fifth text is set aside to calibrate."""
        self.langs = sorted(set(sample.lang))
        if not self.langs:
            return self
        rng = np.random.default_rng(seed)
        target = np.array([self.langs.index(x) for x in sample.lang])
        data, offsets = tb.text_bytes(pa.array(sample.text.tolist(), pa.string()))
        which, distinct, bounds = self._words(data, offsets)
        parts, at = word_parts(distinct)
        size = np.diff(at)
        emb = rng.normal(0, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
        out, self.bias = np.zeros((SIZE, len(self.langs)), np.float32), np.zeros(len(self.langs), np.float32)
        out += rng.normal(0, 0.1, out.shape)
        aside = np.arange(len(sample)) % 5 == 4 if len(sample) >= 50 else np.zeros(len(sample), bool)
        train = np.flatnonzero(~aside & (np.diff(bounds) > 0))
        share = np.bincount(target[train], minlength=len(self.langs)).astype(float)
        weight = len(train) / len(self.langs) / np.maximum(share, 1)
        total = epochs * 3
        for turn in range(total):
            rate = 2.0 * (1 - turn / total)
            order = rng.permutation(train)
            for a in range(0, len(order), 32):
                docs = order[a : a + 32]
                n = np.diff(bounds)[docs]
                take = np.minimum(n, rng.integers(2, 41, len(docs)))
                first = bounds[docs] + (rng.random(len(docs)) * (n - take + 1)).astype(np.int64)
                words = which[tb.gather_ranges(first, take)]
                own = parts[tb.gather_ranges(at[words], size[words])]
                per = np.repeat(1 / size[words] / np.repeat(take, take), size[words]).astype(np.float32)
                text = np.repeat(np.repeat(np.arange(len(docs)), take), size[words])
                cut = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1))
                vectors = np.add.reduceat(emb[own] * per[:, None], cut, axis=0)
                logit = vectors @ out + self.bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(docs)), target[docs]] -= 1
                p *= (weight[target[docs]] / len(docs) * rate)[:, None]
                back = p @ out.T
                out -= vectors.T @ p
                self.bias -= p.sum(0)
                by = np.argsort(own, kind="stable")
                edge = np.concatenate(([0], np.flatnonzero(np.diff(own[by])) + 1))
                emb[own[by][edge]] -= 8 * np.add.reduceat((back[text] * per[:, None])[by], edge, axis=0)
        self.table, self.scale = (emb @ out).astype(np.float32), 1.0
        tune = np.flatnonzero(aside if aside.any() else np.ones(len(sample), bool))
        block = sample.iloc[tune]
        given = tb.text_bytes(pa.array(block.text.tolist(), pa.string()))
        base = np.log(np.maximum(self.probabilities(*given), 1e-12))
        y = target[tune]

        def loss(scale: float) -> float:
            z = base * scale
            return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(y)), y]).mean())

        self.scale = float(min((2.0**k for k in np.arange(-3, 4.1, 0.5)), key=loss))
        p = self.probabilities(*given)
        sure, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-sure, kind="stable")
        precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        fine = np.flatnonzero(precision >= PRECISION)
        self.limit = float(sure[order[fine[-1]]]) if len(fine) else 1.0
        return self


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter."""
    return text is not None and any(map(str.isalpha, text))


def train(docs: DataFrame, modulus: int = 4, held: int = 2, per_lang: int = PER_LANG, sample: int = SAMPLE) -> SubwordSoftmax:
    """Fit on text and non-null lang of a bounded sample outside the held-out fold: the first ids of every language in hash order."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~sampling.in_fold(F.col("doc_id"), modulus, held))
    known, langs = sampling.held_here(own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).select("lang"))
    if not langs:
        return SubwordSoftmax()
    each = min(per_lang, max(1, sample // langs))
    # the limit by rank is taken within each task before rows meet by language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*sampling.hash_order()))
    picked = own.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= each).join(F.broadcast(known), "lang", "left_semi").select("doc_id").distinct()
    chosen, _ = sampling.held_here(picked)
    rows = sampling.frame(sampling.texts_of(own, chosen, [], max_bytes=LANG_BYTES)).sort_values("doc_id", kind="stable").drop_duplicates("text")
    return SubwordSoftmax().fit(rows[rows.text.map(has_letter)].reset_index(drop=True))


def identify(docs: DataFrame, model: SubwordSoftmax, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` string, ``score`` double (its calibrated probability) and ``rejected`` boolean (below the limit).

    All other columns stay; one of the same name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value

        def compute(data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
            ascii_letters = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
            letter = (ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]) & bool(own.langs)
            if own.langs:
                for i in np.flatnonzero(~letter).tolist():
                    letter[i] = has_letter(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8"))
                p = own.probabilities(data, offsets)
                best, sure = p.argmax(1), np.where(letter, p.max(1), 0.0)
            else:
                best, sure = np.zeros(len(letter), int), np.zeros(len(letter))
            return {
                "lang_pred": pa.array([own.langs[b] if x else "und" for b, x in zip(best.tolist(), letter.tolist(), strict=True)], pa.string()),
                "score": pa.array(sure.astype(float)),
                "rejected": pa.array(~letter | (sure < own.limit)),
            }

        return compute

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return tb.map_texts(docs, text, new, start, BLOCK_BYTES)
