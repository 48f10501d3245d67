"""Hard negatives by branch and bound over one ball tree per partition.

Rows become integer vectors; their partitions, dealt by hash, hold a ball tree
each.  A node knows its ball and the range of its labels, so that the product of
a query with any row below it lies between ``q.c - |q| r`` and ``q.c + |q| r``.
A query leaves out a node whose labels can't serve it, whose bounds lie outside
its score window on either side, or whose upper bound is strictly beneath its
current k-th score; equal scores are decided by id, so such nodes are opened.
Queries go down a tree in groups of neighbours, the nearer child first.

Two searches: the best rows of the anchor's label give the positives, then every
different positive score of an anchor gives a window for rows of other labels.
Each partition returns k rows a query, merged by a window of k rows a query.
Products are exact: doubles where they hold all integers that occur, else longs.

Equal rows (label and vector) have equal scores with everything, so beyond the
first ``max(positives + 1, negatives)`` ids of such a class none can be returned;
one search serves all anchors of a class, which then leave themselves out.  A hot
vector or label is thus spread over the partitions like any other.

Defined cases: rows whose id, label or vector is null, or that hold null or
non-finite components, take no part; nor do rows whose integer vectors have a
squared norm of 2^58 or more (their products would be no longs).  Vectors of
different lengths never meet.  Repeated rows count each: a repeated id may be its
own copy's positive, and a repeated anchor gives its rows again.  An empty table
gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.shared import written

#: Rows and bytes of a partition's vectors, rows of a leaf, queries of a block and of a group that walks together.
PART, PART_BYTES, LEAF, BLOCK, TOGETHER = 65_536, 64 << 20, 128, 8192, 192
LEAST_PARTS = 8
NONE = np.iinfo(np.int64).min


class BallTree:
    """Ball tree over integer vectors; the rows of a node lie side by side, nodes are split by label until pure, then by distance.

    Rows are known by their place in ``x``; of equal scores the smaller place comes first.
    """

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(x))
        spans, kids, stack = [(0, len(x))], [(-1, -1)], [0]
        while stack:
            node = stack.pop()
            a, b = spans[node]
            if b - a <= leaf:
                continue
            own = order[a:b]
            lab = labels[own]
            if lab.min() != lab.max():
                own = own[np.argsort(lab, kind="stable")]
                cuts = np.flatnonzero(np.diff(labels[own])) + 1
                at = int(cuts[np.argmin(np.abs(cuts - (b - a) // 2))])
            else:
                p = x[own]
                far = p[np.argmax(((p - p.mean(0)) ** 2).sum(1))]
                along = p @ (p[np.argmax(((p - far) ** 2).sum(1))] - far)
                at = (b - a) // 2
                own = own[np.argsort(along, kind="stable")]
            order[a:b] = own
            kids[node] = (len(spans), len(spans) + 1)
            spans += [(a, a + at), (a + at, b)]
            kids += [(-1, -1), (-1, -1)]
            stack += kids[node]
        self.x, self.labels, self.ids = x[order], labels[order], order
        self.spans, self.kids = spans, kids
        self.centre = np.array([self.x[a:b].mean(0) for a, b in spans])
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, self.centre, strict=True)])
        self.lengths = np.sqrt((self.centre**2).sum(1))
        self.low = np.array([self.labels[a:b].min() for a, b in spans])
        self.high = np.array([self.labels[a:b].max() for a, b in spans])
        self.longest = float(np.sqrt((self.x**2).sum(1).max()))

    def leaves(self) -> list[np.ndarray]:
        """Places of the rows of each leaf."""
        return [self.ids[a:b] for (a, b), (left, _) in zip(self.spans, self.kids, strict=True) if left < 0]

    def search(self, q: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores (NONE: none) and places of the ``k`` best rows of each query within its window, of its label or of others."""
        n = len(q)
        score, found = np.full((n, k), NONE), np.full((n, k), len(self.x))
        if not n or not len(self.x):
            return score, found
        norm = np.sqrt((q**2).sum(1))
        whole = norm.max() * self.longest < 2**52
        rows, asked = (self.x, q) if whole else (self.x.astype(np.int64), q.astype(np.int64))
        least, most = low.astype(float), high.astype(float)

        def open_to(node: int, act: np.ndarray) -> np.ndarray:
            if same:
                act = act[(labels[act] >= self.low[node]) & (labels[act] <= self.high[node])]
            elif self.low[node] == self.high[node]:
                act = act[labels[act] != self.low[node]]
            mid = q[act] @ self.centre[node]
            reach = norm[act] * (self.radius[node] + 1e-9 * (self.lengths[node] + self.radius[node])) + 1e-6
            bar = np.maximum(least[act], score[act, -1].astype(float))
            return act[(mid + reach >= bar - 1e-12 * np.abs(bar)) & (mid - reach <= most[act] + 1e-12 * np.abs(most[act]))]

        def read(a: int, b: int, act: np.ndarray) -> None:
            s = (asked[act] @ rows[a:b].T).astype(np.int64)
            fits = ((self.labels[a:b] == labels[act][:, None]) == same) & (s >= np.maximum(low[act], score[act, -1])[:, None]) & (s <= high[act][:, None])
            hit = fits.any(1)
            act, s = act[hit], np.where(fits[hit], s[hit], NONE)
            if not len(act):
                return
            new = np.where(s > NONE, self.ids[a:b], len(self.x))
            if s.shape[1] > k:  # only what ties with the k-th best or beats it needs to be ordered
                bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                width = max(1, int(((s >= bar[:, None]) & (s > NONE)).sum(1).max()))
                top = np.argsort(-np.maximum(s, NONE + 1), axis=1, kind="stable")[:, :width]
                s, new = np.take_along_axis(s, top, 1), np.take_along_axis(new, top, 1)
            s, new = np.concatenate((score[act], s), 1), np.concatenate((found[act], new), 1)
            best = np.lexsort((new, -np.maximum(s, NONE + 1)), axis=1)[:, :k]
            score[act], found[act] = np.take_along_axis(s, best, 1), np.take_along_axis(new, best, 1)

        for group in BallTree(q, np.zeros(n, np.int64), TOGETHER).leaves():
            stack = [(0, group)]
            while stack:
                node, act = stack.pop()
                act = open_to(node, act)
                if not len(act):
                    continue
                left, right = self.kids[node]
                if left < 0:
                    read(*self.spans[node], act)
                else:
                    nearer = float((q[act] @ (self.centre[left] - self.centre[right])).sum()) >= 0
                    stack += [(right, act), (left, act)] if nearer else [(left, act), (right, act)]
        return score, found


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float).reshape(len(vectors), dim)


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["vec_id", "key"], kind="stable")  # places are in the order that ties ask for
    dim = int(pdf.dim.iloc[0])
    tree = BallTree(_matrix(pdf.q, dim), pdf.label.to_numpy(np.int64))
    blob = pickle.dumps((tree, pdf.vec_id.to_numpy(np.int64), pdf.key.to_numpy()))
    return pd.DataFrame({"dim": [dim], "part": [int(pdf.part.iloc[0])], "blob": [blob]})


HITS = "key binary, asked long, score long, vec_id long, found binary"


def _searcher(k: int, same: bool):
    def run(queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"key": [], "asked": [], "score": [], "vec_id": [], "found": []}
        if len(queries) and len(trees):
            tree, ids, keys = pickle.loads(trees.blob.iloc[0])
            score, place = tree.search(_matrix(queries.q, tree.x.shape[1]), queries.label.to_numpy(np.int64), queries.low.to_numpy(np.int64), queries.high.to_numpy(np.int64), k, same)
            row, col = np.nonzero(score > NONE)
            at = place[row, col]
            out = {"key": queries.key.to_numpy()[row], "asked": queries.asked.to_numpy(np.int64)[row], "score": score[row, col], "vec_id": ids[at], "found": keys[at]}
        return pd.DataFrame(out)

    return run


def _share(p: Column, percent: int) -> Column:
    """``floor(p * percent / 100)`` without leaving longs."""
    rest = F.pmod(p, F.lit(100))
    return F.floor((p - rest).cast("decimal(20,0)") / 100).cast("long") * percent + F.floor(rest * percent / 100).cast("long")


def integer_rows(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: float) -> DataFrame:
    """(vec_id, label, q, dim, key): the rows that take part, as integer vectors, and a digest of label and vector."""
    given = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("long").alias("label"), vectors[embedding].cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floors = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    size = F.aggregate("y", F.lit(0.0), lambda s, y: s + y * y)
    kept = given.where(fine & F.forall("v", lambda x: F.abs(x * F.lit(float(scale))) < 2.0**30)).withColumn("y", floors).where(size < 2.0**58)
    q = F.col("y").cast("array<int>")
    key = F.unhex(F.sha2(F.concat_ws(",", F.col("label").cast("string"), q.cast("array<string>")), 256))
    return kept.select("vec_id", "label", q.alias("q"), F.size("v").cast("long").alias("dim"), key.alias("key"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", part: int = PART, least_parts: int = LEAST_PARTS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``; a negative's score is between ``low`` and ``high`` percent of the positive's.
    """
    rows = integer_rows(vectors, vec_id, embedding, label, scale)
    per_class = Window.partitionBy("key").orderBy("vec_id")
    index = rows.withColumn("n", F.row_number().over(per_class)).where(F.col("n") <= max(positives + 1, negatives)).drop("n")
    index = written(index, "rows")
    size = index.agg(F.count("*").alias("n"), F.max("dim").alias("d")).first()
    room = max(64, min(part, PART_BYTES // (8 * max(1, size.d or 1))))
    parts = min(max(least_parts, -(-size.n // room)), max(1, size.n // 64))
    dealt = index.withColumn("part", F.pmod(F.xxhash64("vec_id", "key"), F.lit(parts)))
    trees = written(dealt.groupBy("dim", "part").applyInPandas(_built, "dim long, part long, blob binary"), "trees")
    anchors = written(rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "key", "label", "q", "dim"), "anchors")
    classes = anchors.groupBy("key").agg(*[F.first(c).alias(c) for c in ("label", "q", "dim")])

    def search(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows of (key, asked), with their ranks."""
        asked = written(asked, "queries")
        blocks = max(1, -(-asked.count() // block))
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
        queries = asked.withColumn("block", F.pmod(F.xxhash64("key", "asked"), F.lit(blocks))).withColumn("part", F.explode(numbers))
        copies = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        by = ["dim", "part", "block"]
        hits = queries.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(_searcher(k, same), HITS)
        place = F.row_number().over(Window.partitionBy("key", "asked").orderBy(F.col("score").desc(), "vec_id", "found"))
        return hits.withColumn("rank", place).where(F.col("rank") <= k)

    whole = [F.lit(NONE + 1).alias("low"), F.lit(-NONE - 1).cast("long").alias("high")]
    top = search(classes.select("*", F.lit(0).cast("long").alias("asked"), *whole), positives + 1, True)
    listed = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id", "found"))).alias("top"))
    own = F.array_position(F.transform("top", lambda x: (x.vec_id == F.col("anchor_id")) & (x.found == F.col("key"))), F.lit(True))
    others = F.slice(F.filter("top", lambda x, i: i + 1 != own), 1, positives)
    pairs = anchors.select("anchor_id", "key").join(listed, "key").select("anchor_id", "key", F.explode(others).alias("p"))
    pairs = written(pairs.select("anchor_id", "key", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score")), "pairs")
    windows = pairs.where("positive_score >= 0").select("key", F.col("positive_score").alias("asked")).distinct()
    windows = windows.join(classes, "key").withColumn("low", -_share(-F.col("asked"), low)).withColumn("high", _share(F.col("asked"), high))
    found = search(windows, negatives, False).select("key", F.col("asked").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(found, ["key", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
