"""Quality by positive-unlabelled learning with a non-negative risk.

A small network over counts of the whole text (byte classes, punctuation, word
and line repetition, lengths, shares of hashed words) is trained in numpy on
*trusted positives* and *unlabelled* web text; labels 0 are never looked at.  With
the class prior p the risk is

    p E+[l(z)] + max(0, Eu[l(-z)] - p E+[l(-z)]),

the logistic loss for l, so that the logistic of the output z is itself the
probability of quality and the score; where the second part falls below zero, its
gradient is reversed as in non-negative PU learning.  The prior is estimated from
the two samples: a classifier that tells them apart is trained on one half, and on
the other half the share of unlabelled over the share of positive texts above a
threshold is smallest where hardly any text above it is negative; that least ratio,
with a bound for chance, is the share of positives in unlabelled text.

Training takes at most ``per_class`` positives and ``unlabelled`` other rows, of
bounded bytes; scoring is a single pass without a shuffle.  Defined cases: null and
empty texts have zero counts and a score like any text; without positives every
score is 0; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import sampling
from weft.llm import textblock as tb
from weft.llm.toxicity import add_scores

PER_CLASS = 2500
UNLABELLED = 5000
HIDDEN = 24
#: Hashed words whose shares are features.
WORDS = 64

_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]
_COLUMNS = np.full(256, 6 + len(_PUNCT), np.int64)  # non-ASCII last
_COLUMNS[:128] = 5  # control
for _i, _b in enumerate(_PUNCT):
    _COLUMNS[_b] = 6 + _i
_COLUMNS[65:91], _COLUMNS[97:123], _COLUMNS[48:58], _COLUMNS[[32, 9]], _COLUMNS[10] = 0, 1, 2, 3, 4
N_CLASSES = 7 + len(_PUNCT)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of counts and ratios for every text of a block."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    classes = np.bincount(row * N_CLASSES + _COLUMNS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    starts, ends = tb.word_spans(data, offsets, tb.NON_SPACE)
    bounds = tb.row_bounds(starts, offsets)
    words = np.diff(bounds)
    which, distinct = tb.encode_words(tb.LOWER[data], starts, ends)
    word_row = np.repeat(np.arange(n), words)
    kinds = len(distinct) + 1
    seen = np.bincount(np.unique(word_row * np.int64(kinds) + which) // kinds, minlength=n)
    same = np.zeros(len(which), bool)
    same[1:] = (which[1:] == which[:-1]) & (word_row[1:] == word_row[:-1])
    pair = word_row[:-1] == word_row[1:]
    pairs = np.stack((word_row[:-1], which[:-1], which[1:]), 1)[pair]
    two = pairs[:, 1].astype(np.int64) * kinds + pairs[:, 2]
    order = np.lexsort((two, pairs[:, 0]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (two[order][1:] != two[order][:-1]) | (pairs[order, 0][1:] != pairs[order, 0][:-1])
    two_seen = np.bincount(pairs[order, 0][fresh], minlength=n)
    two_all = np.bincount(pairs[:, 0], minlength=n)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    letters = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128))))
    caps, alpha = upper[ends] - upper[starts], letters[ends] - letters[starts]
    length = ends - starts
    marks = length - alpha  # bytes of a word that are no letters
    bucket = word_buckets(distinct)[which]
    shares = np.bincount(word_row * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
    count = lambda mask: np.bincount(word_row[mask], minlength=n)
    cols = [
        np.log1p(size) / 5,
        np.log1p(words) / 5,
        _ratio(size, words) / 10,
        _ratio(seen, words),
        _ratio(count(same), words) * 2,
        _ratio(two_seen, two_all),
        _ratio(count(alpha == 0), words) * 2,
        _ratio(count((caps > 1) & (caps == alpha)), words) * 2,
        _ratio(count(marks >= 2), words) * 2,
        _ratio(np.bincount(word_row, length**2, n), np.bincount(word_row, length, n)) / 20,
        _ratio(classes[:, 4], words) * 5,
        (words == 0).astype(float),
    ]
    return np.concatenate((np.stack(cols, 1), np.sqrt(_ratio(classes, size[:, None])), np.sqrt(_ratio(shares, words[:, None]))), 1)


def word_buckets(words: pa.Array) -> np.ndarray:
    """Hash of each distinct word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % WORDS for w in words.to_pylist()), np.int64, len(words))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class PUNet:
    """One hidden layer on standardised features; the logistic of its output is the score."""

    def __init__(self) -> None:
        self.w: dict = {}
        self.prior = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of quality for every text of a block."""
        if not self.w:
            return np.zeros(len(offsets) - 1)
        return self.of_features(features(data, offsets))

    def of_features(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality for rows of features."""
        x = np.clip((x - self.mean) / self.sd, -6, 6)
        return _logistic(np.tanh(x @ self.w["h"] + self.w["hb"]) @ self.w["o"] + self.w["ob"][0])

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 40, seed: int = 3) -> PUNet:
        """Minimise the non-negative risk over rows of features."""
        rng = np.random.default_rng(seed)
        self.mean, self.sd = unlabelled.mean(0), unlabelled.std(0) + 1e-3
        p, u = (np.clip((x - self.mean) / self.sd, -6, 6) for x in (positive, unlabelled))
        self.prior = prior
        self.w = {"h": rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), "hb": np.zeros(HIDDEN), "o": rng.normal(0, 0.3, HIDDEN), "ob": np.zeros(1)}
        adam = sampling.Adam(self.w, 0.005)
        steps = max(8, max(len(p), len(u)) // 512)
        for _ in range(epochs):
            order_p, order_u = (np.resize(rng.permutation(len(x)), max(len(p), len(u))) for x in (p, u))
            for k in range(steps):
                xp, xu = p[order_p[k::steps]], u[order_u[k::steps]]
                x = np.concatenate((xp, xu))
                hidden = np.tanh(x @ self.w["h"] + self.w["hb"])
                z = np.clip(hidden @ self.w["o"] + self.w["ob"][0], -30, 30)
                d, _ = risk_slope(z, len(xp), prior)
                back = d[:, None] * self.w["o"] * (1 - hidden**2)
                adam.step({"o": hidden.T @ d + 1e-4 * self.w["o"], "ob": np.array([d.sum()]), "h": x.T @ back + 1e-4 * self.w["h"], "hb": back.sum(0)})
        return self


def risk_slope(z: np.ndarray, n_positive: int, prior: float) -> tuple[np.ndarray, float]:
    """Slope of the non-negative risk by each output (positives first), and the part that must not fall below zero."""
    zp, zu = slice(0, n_positive), slice(n_positive, None)
    s = _logistic(z)  # l(z) = log(1 + e^-z) has slope s - 1, l(-z) = log(1 + e^z) has slope s
    softplus = np.logaddexp(0, z)
    negative = float(softplus[zu].mean() - prior * softplus[zp].mean())
    d = np.zeros(len(z))
    sign = 1.0 if negative >= 0 else -1.0
    if negative >= 0:
        d[zp] = prior * (s[zp] - 1) / n_positive
    d[zu] += sign * s[zu] / (len(z) - n_positive)
    d[zp] -= sign * prior * s[zp] / n_positive
    return d, negative


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1) -> float:
    """Share of positives in unlabelled rows: the least ratio of tails of a classifier that tells the samples apart."""
    mean, sd = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((x - mean) / sd, -6, 6) for x in (positive, unlabelled))
    half = lambda x, k: np.concatenate((x[k::2], np.ones((len(x[k::2]), 1))), 1)
    x, y = np.concatenate((half(p, 0), half(u, 0))), np.repeat([1.0, 0.0], [len(p[::2]), len(u[::2])])
    beta = np.zeros(x.shape[1])
    for _ in range(15):
        q = _logistic(x @ beta)
        beta -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 10 * np.eye(len(beta)), x.T @ (q - y) + 10 * beta)
    zp, zu = np.sort(half(p, 1) @ beta), np.sort(half(u, 1) @ beta)
    if not len(zp) or not len(zu):
        return 0.5
    tail_p = 1 - np.arange(len(zp)) / len(zp)
    tail_u = 1 - np.searchsorted(zu, zp) / len(zu)
    chance = np.sqrt(np.log(4 / sure) / 2 / len(zu)) + np.sqrt(np.log(4 / sure) / 2 / len(zp))
    best = int(np.argmin((tail_u + chance) / tail_p))
    return float(np.clip(tail_u[best] / tail_p[best], 0.01, 0.99))


def _matrix(texts: list[str]) -> np.ndarray:
    parts = [features(*tb.text_bytes(pa.array(texts[i : i + 500], pa.string()))) for i in range(0, len(texts), 500)]
    return np.concatenate(parts) if parts else np.zeros((0, 12 + N_CLASSES + WORDS))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, per_class: int = PER_CLASS, unlabelled: int = UNLABELLED) -> PUNet:
    """Fit on the positives among the labels outside the held-out fold and on text outside it, whatever its label."""
    known = sampling.labelled(docs, labels.where(F.col("quality").cast("int") == 1), "quality", modulus, held, per_class)
    fold = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~sampling.in_fold(F.col("doc_id"), modulus, held))
    # ids that repeat stand together in hash order: some more are drawn, then each once
    ids, _ = sampling.held_here(sampling.hashed_first(sampling.hashed_first(fold, 4 * unlabelled).distinct(), unlabelled))
    web = sampling.frame(sampling.texts_of(docs, ids, [])).sort_values("doc_id", kind="stable")
    model = PUNet()
    if not len(known) or not len(web):
        return model
    p, u = _matrix(known.text.tolist()), _matrix(web.text.tolist())
    return model.fit(p, u, estimate_prior(p, u))


def score(docs: DataFrame, model: PUNet, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score (double, 0 to 1); all other columns stay."""
    return add_scores(docs, model, text, into)
