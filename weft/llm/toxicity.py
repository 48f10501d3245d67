"""Toxicity by a convolutional text classifier trained in numpy.

A word (lower-cased run of letters, digits and non-ASCII) is hashed whole and by its
first and last bytes, so that inflected forms share parts; hash values seen in at
least ``MIN_DOCS`` training documents own a row of the embedding table, all others
share the zero row, and a word's embedding is the sum of its rows.  Filters of
several widths slide over the words, their maxima over the whole text go through a
logistic unit whose weights are kept non-negative and filter biases non-positive:
only evidence that is found raises a score, and a text of unknown words stays at
the floor, below every threshold.  Because a filter is linear in each word, scoring looks up one table
row per part of each *distinct* word of a block: no matrix product per word, no
limit on text length.

A part of the training rows is set aside to calibrate one threshold per language.
A text's language is guessed from its own words (naive Bayes over the same
hashes), never read from a column; the score is the logistic of the logit less
the threshold's, so 0.5 is the threshold in every language.

Training takes at most ``2 * per_class`` labelled rows; scoring is a single pass
without a shuffle.  Defined cases: null and empty texts are scored as a text
without words; without both classes in training every score is 0; repeated rows
get equal scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weft.llm import sampling
from weft.llm import textblock as tb

PER_CLASS = 2000
MIN_DOCS = 3
#: Bytes of the first and last parts of a word that are hashed.
AFFIXES = (4, 5, 6)
WIDTHS = (1, 2, 3)
FILTERS, SIZE = 8, 8
BLOCK_BYTES = 4 << 20


def word_hashes(words: pa.Array) -> np.ndarray:
    """40-bit hashes of each distinct word: the whole, then its affixes; -1 where the word is no longer than the affix."""
    n = len(words)
    out = np.full((n, 1 + 2 * len(AFFIXES)), -1, np.int64)
    if not n:
        return out
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]].astype(np.uint64)
    at = at - at[0]
    out[:, 0] = [xxhash.xxh3_64_intdigest(w) >> 24 for w in words.to_pylist()]
    size = np.diff(at)
    for side, first, step in ((0, at[:-1], 1), (1, at[1:] - 1, -1)):
        for j, k in enumerate(AFFIXES):
            long = np.flatnonzero(size > k)
            key = np.full(len(long), 2 * k + side + 1, np.uint64)
            for i in range(k):
                key = (key ^ raw[first[long] + step * i]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            out[long, 1 + side * len(AFFIXES) + j] = (key >> np.uint64(24)).astype(np.int64)
    return out


def summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the table rows of each word's parts, part by part to stay small."""
    out = table[rows[:, 0]]
    for column in rows.T[1:]:
        out += table[column]
    return out


class TextCNN:
    """Hash rows, tap tables and thresholds; ``fit`` trains, ``scores`` applies."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.int64)
        self.taps = np.zeros((0, 0), np.float32)
        self.langs: list[str] = []
        self.threshold = np.zeros(1)  # by language, the last for any other

    @staticmethod
    def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Index of every word into the distinct ones, those, and the row bounds."""
        data = tb.LOWER[data]
        starts, ends = tb.word_spans(data, offsets, tb.ALNUM)
        return *tb.encode_words(data, starts, ends), tb.row_bounds(starts, offsets)

    def rows(self, distinct: pa.Array) -> np.ndarray:
        """Table rows of every distinct word's parts, 0 for none."""
        hashed = word_hashes(distinct)
        at = np.searchsorted(self.hashes, hashed.ravel()).reshape(hashed.shape)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashed, at + 1, 0).astype(np.int32)

    @staticmethod
    def padded(rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words with zeros behind each text, each text's first window and the places of its windows' texts."""
        pad = max(WIDTHS)
        size = np.diff(bounds)
        starts = bounds[:-1] + pad * np.arange(len(size))
        out = np.zeros(int(bounds[-1]) + pad * (len(size) + 1), np.int64)
        out[tb.gather_ranges(starts, size)] = rows
        return out, starts, size

    def _guess(self, which: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = tb.per_row_sum(summed(self.profile, rows)[which], bounds)
        return np.where(np.abs(sums).sum(1) > 0, sums.argmax(1), len(self.langs))

    def _logits(self, which: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        by_word = np.concatenate((np.zeros((1, self.taps.shape[1]), np.float32), summed(self.taps, rows)))
        words, starts, size = self.padded(which + 1, bounds)
        n = len(words) - max(WIDTHS)
        cut = np.empty(2 * len(size), np.int64)
        cut[::2], cut[1::2] = starts, starts + np.maximum(size, 1)
        out, column = [], 0
        for k in WIDTHS:
            conv = by_word[words[:n], column : column + FILTERS]
            for j in range(1, k):
                column += FILTERS
                conv += by_word[words[j : n + j], column : column + FILTERS]
            column += FILTERS
            out.append(np.maximum.reduceat(conv, cut, axis=0)[::2])
        return np.maximum(np.concatenate(out, 1) + self.bias, 0) @ self.out + self.out_bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated score of every text of a block."""
        if not len(self.taps):
            return np.zeros(len(offsets) - 1)
        which, distinct, bounds = self.words(data, offsets)
        rows = self.rows(distinct)
        logit = self._logits(which, rows, bounds) - self.threshold[self._guess(which, rows, bounds)]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def fit(self, sample: pd.DataFrame, epochs: int = 6, seed: int = 5) -> TextCNN:
        """Train on text and y (0 or 1) and calibrate by lang on every fifth row."""
        if sample.y.nunique() < 2:
            return self
        rng = np.random.default_rng(seed)
        which, distinct, bounds = self.words(*tb.text_bytes(pa.array(sample.text.tolist(), pa.string())))
        if not len(which):
            return self
        y = sample.y.to_numpy(float)
        aside = np.arange(len(sample)) % 5 == 4
        if len(set(y[~aside])) < 2:
            aside[:] = False
        # documents of each part, over training rows alone
        hashed = word_hashes(distinct)
        pair = np.unique(np.repeat(np.arange(len(sample)), np.diff(bounds)) * np.int64(len(distinct)) + which)
        pair = pair[~aside[pair // len(distinct)]]
        values = np.unique(hashed)
        part = np.stack([np.searchsorted(values, column) for column in hashed.T], 1).astype(np.int32)
        del hashed
        word, text = (pair % len(distinct)).astype(np.int32), pair // len(distinct)
        ones, zeros = np.zeros(len(values)), np.zeros(len(values))
        for column in part.T:  # a hash belongs to one kind of part
            seen = np.unique(text * np.int64(len(values)) + column[word])
            own, positive = seen % len(values), y[seen // len(values)]
            ones += np.bincount(own, positive, len(values))
            zeros += np.bincount(own, 1 - positive, len(values))
        keep = (ones + zeros >= MIN_DOCS) & (values >= 0)
        self.hashes = values[keep]
        n = len(self.hashes)
        if not n:
            return self
        rows = self.rows(distinct)
        # first coordinate of an embedding: smoothed log odds of the part's documents
        ones, zeros = ones[keep] + 1, zeros[keep] + 1
        odds = np.log(ones / (y[~aside].sum() + 2)) - np.log(zeros / ((1 - y[~aside]).sum() + 2))
        w = {"e": rng.normal(0, 0.05, (n + 1, SIZE)), "b": np.zeros(FILTERS * len(WIDTHS)), "o": np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))), "c": np.zeros(1)}
        w["e"][1:, 0] = np.clip(odds, -3, 3) / 3
        w["e"][0] = 0
        for k in WIDTHS:
            w[f"f{k}"] = rng.normal(0, 0.3, (k, SIZE, FILTERS))
        train = np.flatnonzero(~aside)
        weight = np.where(y == 1, 0.5 / max(y[train].sum(), 1), 0.5 / max((1 - y[train]).sum(), 1)) * len(train)
        adam = sampling.Adam(w, 0.01)
        for _ in range(epochs):
            order = rng.permutation(train)
            for a in range(0, len(order), 64):
                self._step(w, adam, order[a : a + 64], which, rows, bounds, y, weight)
        self.taps = np.concatenate([(w["e"] @ w[f"f{k}"][j]).astype(np.float32) for k in WIDTHS for j in range(k)], 1)
        self.bias, self.out, self.out_bias = w["b"].astype(np.float32), w["o"].astype(np.float32), float(w["c"][0])
        self._calibrate(sample, y, aside, which, rows, bounds)
        return self

    def _calibrate(self, sample: pd.DataFrame, y: np.ndarray, aside: np.ndarray, which: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> None:
        def by_chunk(f) -> np.ndarray:
            out = []
            for a in range(0, len(sample), 250):
                b = min(a + 250, len(sample))
                own, local = np.unique(which[bounds[a] : bounds[b]], return_inverse=True)
                out.append(f(local, rows[own], bounds[a : b + 1] - bounds[a]))
            return np.concatenate(out)

        logit = by_chunk(self._logits)
        tune = aside if aside.any() else np.ones(len(y), bool)
        langs = sample.lang.fillna("").to_numpy(str)
        self.langs = sorted({x for x in langs if x})
        n = len(self.hashes) + 1
        counts = np.ones((n, max(1, len(self.langs))))
        for j, lang in enumerate(self.langs):
            words = np.bincount(which[np.repeat(langs == lang, np.diff(bounds))], minlength=len(rows))
            for column in rows.T:
                counts[:, j] += np.bincount(column, words, n)
        self.profile = np.log(counts / counts.sum(0))
        self.profile -= self.profile.mean(1, keepdims=True)
        self.profile[0] = 0
        guess = by_chunk(self._guess)
        floor = self.out_bias + 1e-6
        self.threshold = np.full(len(self.langs) + 1, max(floor, best_threshold(logit[tune], y[tune])))
        for j in range(len(self.langs)):
            mine = tune & (guess == j)
            if min(y[mine].sum(), (1 - y[mine]).sum()) >= 10:
                self.threshold[j] = max(floor, best_threshold(logit[mine], y[mine]))

    def _step(self, w: dict, adam: sampling.Adam, batch: np.ndarray, which: np.ndarray, rows: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        size = np.diff(bounds)[batch]
        own, local = np.unique(which[tb.gather_ranges(bounds[:-1][batch], size)], return_inverse=True)
        table = np.concatenate((np.zeros((1, rows.shape[1]), rows.dtype), rows[own]))
        words, starts, size = self.padded(local + 1, np.concatenate(([0], np.cumsum(size))))
        n = len(words) - max(WIDTHS)
        cut = np.empty(2 * len(size), np.int64)
        cut[::2], cut[1::2] = starts, starts + np.maximum(size, 1)
        text = np.repeat(np.arange(len(size)), np.maximum(size, 1))
        place = tb.gather_ranges(starts, np.maximum(size, 1))
        by_word = w["e"][table].sum(1)
        emb = by_word[words]
        best, pooled = [], []
        for k in WIDTHS:
            conv = sum(emb[j : n + j] @ w[f"f{k}"][j] for j in range(k))
            top = np.maximum.reduceat(conv, cut, axis=0)[::2]
            reached = conv[place] == top[text]
            first = np.empty((len(size), FILTERS), np.int64)
            for f in range(FILTERS):
                hit = np.flatnonzero(reached[:, f])[::-1]
                first[text[hit], f] = place[hit]
            best.append(first)
            pooled.append(top)
        z = np.concatenate(pooled, 1) + w["b"]
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ w["o"] + w["c"], -30, 30)))
        d = (p - y[batch]) * weight[batch] / len(batch)
        dz = d[:, None] * w["o"] * (z > 0)
        grads: dict = {"o": h.T @ d, "c": np.array([d.sum()]), "b": dz.sum(0)}
        at, values = [], []
        for i, k in enumerate(WIDTHS):
            g, first = dz[:, i * FILTERS : (i + 1) * FILTERS], best[i]
            gf = np.empty_like(w[f"f{k}"])
            for j in range(k):
                taken = emb[first + j]  # text, filter, size
                gf[j] = np.einsum("tf,tfs->sf", g, taken)
                at.append(table[words[first + j].ravel()])
                values.append((g[:, :, None] * w[f"f{k}"][j].T[None]).reshape(-1, SIZE))
            grads[f"f{k}"] = gf
        at, values = np.concatenate(at), np.concatenate(values)
        live = (at > 0) & np.any(values != 0, 1)[:, None]
        unique, inverse = np.unique(at[live], return_inverse=True)
        total = np.zeros((len(unique), SIZE))
        np.add.at(total, inverse, values[np.nonzero(live)[0]])
        grads["e"] = (unique, total)
        adam.step(grads)
        np.maximum(w["o"], 0, out=w["o"])
        np.minimum(w["b"], 0, out=w["b"])


def best_threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap in the logits that gives the best F1; ties take the widest gap."""
    order = np.argsort(-logit, kind="stable")
    z, t = logit[order], y[order]
    hits = np.cumsum(t)
    f1 = 2 * hits / (np.arange(1, len(t) + 1) + t.sum())
    gap = np.append(z[:-1] - z[1:], 2.0)
    f1[gap <= 0] = -1
    best = max(range(len(z)), key=lambda i: (round(float(f1[i]), 9), float(gap[i])))
    return float(z[best] - gap[best] / 2)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = PER_CLASS) -> TextCNN:
    """Fit on a bounded sample of ``labels.toxic`` outside the held-out fold."""
    return TextCNN().fit(sampling.labelled(docs, labels, "toxic", modulus, held, per_class))


def score(docs: DataFrame, model: TextCNN, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score (double, 0 to 1); all other columns stay."""
    return add_scores(docs, model, text, into)


def add_scores(docs: DataFrame, model, text: str, into: str) -> DataFrame:
    """Add ``model.scores`` of every whole text as a double column, block by block; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value
        return lambda data, offsets: {into: pa.array(np.asarray(own.scores(data, offsets), float))}

    return tb.map_texts(docs, text, [T.StructField(into, T.DoubleType())], start, BLOCK_BYTES)
