"""Embedding near-duplicates with one navigable small-world graph hierarchy per shard.

Distinct vectors are dealt into shards by hash; each shard holds a hierarchy of
graphs: random nested subsets above, all vectors below, every vector joined to
near and mutually diverse neighbours.  Every vector queries every shard: from the
top layer down, then by a beam in the lowest layer, many queries at a time in
numpy.  At every beam the queries whose beam is not full of links are audited: random
ones are compared with the whole shard until ``AUDIT_LINKED`` have links other than
themselves, or all are compared.  Only at a recall of ``RECALL`` are the others of
them accepted; else they join the full ones at twice the beam.  A query
whose widest beam is full of links is compared with the whole shard, which is the
exact way for hot groups.  What is found is verified by cosine in double precision.

Hot groups yield counts and spanning edges, not pairs; only queries with few links
in a shard yield pairs, so that a link found from either side counts for both.
Exact copies are one vector with a multiplicity from the start.  Shards hold at
most about ``SHARD`` vectors and query blocks ``BLOCK``, fewer where ``SHARD_BYTES``
and ``BLOCK_BYTES`` ask for it, whatever the input.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never link; equal
vectors always do; a null vec_id counts as a vector and takes part, its own
component_id is that of its links; an empty table gives an empty result.

A graph travels in chunks to the ``LANES`` tasks that share its shard's queries: they
read it once and take their queries a block at a time.  What a query finds is counted
and joined to its group at once, so a task holds one graph and one block.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import textblock as tb
from weft.operators.components import connected_components
from weft.shared import written

SHARD, LEAST_SHARDS, BLOCK = 65_536, 8, 8192
#: Bytes of a shard's vectors (as doubles and floats) and of a block's (as doubles).
SHARD_BYTES, BLOCK_BYTES = 128 << 20, 32 << 20
#: Seconds that a shard's graph may take.
STUCK_S = 3600
LINKS, DIVERSE, RATIO = 20, 10, 16
BEAM, BUILD_BEAM, RECALL = 32, 48, 0.98
#: Links of one query in one shard from which on it is compared exactly and counted.
HOT = 128
#: Bytes of a row that holds a piece of a shard's graph, and tasks that share a shard's queries.
CHUNK, LANES = 1 << 20, 4
#: Queries compared with the whole shard at a time, until so many of them have links.
AUDIT, AUDIT_LINKED = 96, 64


def select_diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """From candidates (-1: none) sorted by similarity, LINKS neighbours: first mutually diverse ones, then the nearest."""
    n, c = ids.shape
    out = np.full((n, LINKS), -1, np.int32)
    for a in range(0, n, 512):
        i, s = ids[a : a + 512], sims[a : a + 512]
        v = x[i]
        between = v @ v.transpose(0, 2, 1)
        chosen = np.zeros(i.shape, bool)
        for k in range(c):
            near = (between[:, k, :k] > s[:, k, None]) & chosen[:, :k]
            chosen[:, k] = (i[:, k] >= 0) & ~near.any(1) & (chosen[:, :k].sum(1) < DIVERSE)
        rank = np.where(i < 0, 2, np.where(chosen, 0, 1))
        order = np.argsort(rank, axis=1, kind="stable")[:, :LINKS]
        got = np.take_along_axis(i, order, 1)
        out[a : a + 512, : got.shape[1]] = got
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes found for every query and their similarities, best first (-1: none)."""
    found, value = np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), -2, np.float32)
    step = max(16, min(512, (32 << 20) // max(1, len(x))))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        n = len(q)
        row = np.arange(n)
        first = entry[a : a + step]
        seen = np.zeros((n, len(x) + 1), bool)
        seen[:, -1] = True  # -1 stands for none
        np.put_along_axis(seen, first.astype(np.int64), True, 1)
        s = np.where(first >= 0, np.einsum("qd,qkd->qk", q, x[first]), -2)
        pad = max(beam, first.shape[1])
        ids, sims, done = np.full((n, pad), -1, np.int32), np.full((n, pad), -2, np.float32), np.zeros((n, pad), bool)
        ids[:, : first.shape[1]], sims[:, : first.shape[1]] = first, s
        order = np.argsort(-sims, axis=1)[:, :beam]
        ids, sims, done = (np.take_along_axis(y, order, 1) for y in (ids, sims, done))
        live = row
        while len(live):
            free = np.where(done[live] | (ids[live] < 0), -3, sims[live])
            best = np.argpartition(-free, min(expand, beam) - 1, axis=1)[:, : min(expand, beam)]
            usable = np.take_along_axis(free, best, 1) > -3
            keep = usable.any(1)
            live, best, usable = live[keep], best[keep], usable[keep]
            if not len(live):
                break
            nodes = np.where(usable, np.take_along_axis(ids[live], best, 1), -1)
            mark = done[live]
            np.put_along_axis(mark, best, True, 1)
            done[live] = mark
            near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            width = int((near >= 0).sum(1).max())
            if not width:
                continue
            near = -np.sort(-near, axis=1)[:, :width]
            seen[live[:, None], near] = True
            s = np.where(near >= 0, np.einsum("qd,qkd->qk", q[live], x[near]), -2)
            ids2, sims2 = np.concatenate((ids[live], near), 1), np.concatenate((sims[live], s), 1)
            done2 = np.concatenate((done[live], np.zeros(near.shape, bool)), 1)
            order = np.argsort(-sims2, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(y, order, 1) for y in (ids2, sims2, done2))
        found[a : a + step], value[a : a + step] = ids, sims
    return found, value


def _exact_graph(x: np.ndarray) -> np.ndarray:
    n = len(x)
    k = min(n - 1, 48)
    if k < 1:
        return np.full((n, LINKS), -1, np.int32)
    ids, sims = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(s, top, 1)
        order = np.argsort(-v, axis=1)
        ids[a : a + 1024], sims[a : a + 1024] = np.take_along_axis(top, order, 1), np.take_along_axis(v, order, 1)
    return select_diverse(x, ids, sims)


class ShardIndex:
    """Graphs over unit vectors (float32); vectors are in random order, each layer is a prefix of the next."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        sizes = [len(x)]
        while sizes[-1] > 256:
            sizes.append(max(64, sizes[-1] // RATIO))
        self.top = sizes[-1]
        self.graphs = [_exact_graph(x[:n]) for n in sizes[1:-1]] if len(sizes) > 2 else []
        self.graphs.insert(0, self._grow())
        self.sizes = sizes

    def _grow(self) -> np.ndarray:
        x, n = self.x, len(self.x)
        at = min(n, 512)
        graph = np.full((n, LINKS), -1, np.int32)
        graph[:at] = _exact_graph(x[:at])
        while at < n:
            to = min(n, at + min(at, 2048))
            new = x[at:to]
            s0 = new @ x[: min(at, 128)].T
            entry = np.argsort(-s0, axis=1)[:, :8].astype(np.int32)
            ids, sims = beam_search(x[:at], graph[:at], new, entry, BUILD_BEAM)
            own = new @ new.T
            np.fill_diagonal(own, -2)
            k = min(16, len(new) - 1)
            if k > 0:
                top = np.argpartition(-own, k - 1, axis=1)[:, :k]
                ids = np.concatenate((ids, (top + at).astype(np.int32)), 1)
                sims = np.concatenate((sims, np.take_along_axis(own, top, 1)), 1)
            order = np.argsort(-sims, axis=1)
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            graph[at:to] = select_diverse(x, ids, sims)
            # links back: what gained links chooses anew among old and new ones
            source = np.repeat(np.arange(at, to), LINKS)
            target = graph[at:to].ravel()
            source, target = source[target >= 0], target[target >= 0]
            order = np.lexsort((-np.einsum("kd,kd->k", x[source], x[target]), target))
            source, target = source[order], target[order]
            gained, first, count = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, count)
            fits = place < 28
            extra = np.full((len(gained), 28), -1, np.int32)
            extra[np.repeat(np.arange(len(gained)), count)[fits], place[fits]] = source[fits]
            both = np.concatenate((graph[gained], extra), 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.where(both >= 0, np.einsum("nd,nkd->nk", x[gained], x[both]), -2)
            order = np.argsort(-s, axis=1)
            graph[gained] = select_diverse(x, np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1))
            at = to
        return graph

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from the top layer down."""
        s = queries @ self.x[: self.top].T
        entry = np.argsort(-s, axis=1)[:, :8].astype(np.int32)
        for n, graph in zip(self.sizes[-2:0:-1], self.graphs[:0:-1], strict=True):
            entry, _ = beam_search(self.x[:n], graph, queries, entry, 8, 2)
        return beam_search(self.x, self.graphs[0], queries, entry, beam)


def range_search(index: ShardIndex, queries: np.ndarray, least: float, hot: int = HOT, recall: float = RECALL, own: np.ndarray | None = None, take: Callable[[int, np.ndarray, bool], None] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Candidates (vector numbers) of every query with similarity near ``least`` or above, and which queries were compared exactly and are to be counted.

    ``own`` has the number of each query in the index (-1: not in it); audits leave that match out.
    With ``take`` each query's candidates are handed to it (query, candidates, whether they are to be counted) as soon
    as they are known, and are not held: those of a hot group are as many as the group is large.
    """
    low = np.float32(least - 1e-4)
    n = len(queries)
    own = np.full(n, -1) if own is None else own
    hits: list = [None] * n
    known, exact = np.zeros(n, bool), np.zeros(n, bool)

    def put(k: int, found: np.ndarray, compared: bool = False) -> None:
        known[k], exact[k] = True, compared or len(found) > 2 * hot
        if take is None:
            hits[k] = found
        else:
            take(k, found, bool(exact[k]))

    def compare(part: np.ndarray, last: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, len(part), 256):
            s = queries[part[a : a + 256]] @ index.x.T >= low
            for i, k in enumerate(part[a : a + 256].tolist()):
                found = np.flatnonzero(s[i])
                put(k, found, last)
                yield k, found

    def audited(some: np.ndarray, found: list[np.ndarray]) -> bool:
        """Compare queries with the whole shard until AUDIT_LINKED have links or none is left; whether what was found is recall enough."""
        shares, got, want = [], 0, 0
        order = np.random.default_rng(len(some)).permutation(len(some))
        for a in range(0, len(order), AUDIT):
            part = order[a : a + AUDIT]
            for i, (k, links) in zip(part.tolist(), compare(some[part]), strict=True):
                links = links[links != own[k]]
                if len(links):
                    there = int(np.isin(links, found[i]).sum())
                    shares.append(there / len(links))
                    got, want = got + there, want + len(links)
            if len(shares) >= AUDIT_LINKED:
                break
        return got >= recall * want and sum(shares) >= recall * len(shares)

    pending, beam = np.arange(n), BEAM
    while len(pending):
        if beam >= len(index.x) or beam > 2 * hot:
            break
        ids, sims = index.search(queries[pending], beam)
        good = (sims >= low) & (ids >= 0)
        full = good.all(1)
        # full beams go on to the next one, so only the others are decided here, and audits are drawn from them
        decided, found = pending[~full], [i[g] for i, g in zip(ids[~full], good[~full], strict=True)]
        if audited(decided, found):
            for k, f in zip(decided.tolist(), found, strict=True):
                if not known[k]:
                    put(k, f)
        pending = pending[~known[pending]]
        beam *= 2
    for _ in compare(pending, True):
        pass
    return hits, exact


RESULT = "kind int, a long, b long, n long"


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Unit vectors; divided by the largest component first, as the squares of very small or large ones are no doubles."""
    v = np.stack(vectors.to_numpy()).astype(float)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    order = np.random.default_rng(1).permutation(len(pdf))
    pdf = pdf.sort_values("cid", kind="stable").iloc[order]
    unit = unit_rows(pdf.v)
    with tb.watched(0, STUCK_S):
        index = ShardIndex(unit.astype(np.float32))
    index.x = None  # made again from the doubles where it is read
    blob = pickle.dumps((index, pdf.cid.to_numpy(), pdf.n.to_numpy(), unit))
    cuts = range(0, len(blob), CHUNK)
    return pd.DataFrame({"shard": int(pdf.shard.iloc[0]), "part": np.arange(len(cuts)), "blob": [blob[a : a + CHUNK] for a in cuts]})


def _querier(least: float, hot: int):
    def run(queries: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(blobs):
            shard = int(queries.shard.iloc[0])
            index, cids, times, unit = pickle.loads(blobs.blob.iloc[0])
            if index.x is None:
                index.x = unit.astype(np.float32)
            v = unit_rows(queries.v)
            own = queries.cid.to_numpy()
            order = np.argsort(cids)
            at = order[np.searchsorted(cids, own, sorter=order) % len(cids)]
            at = np.where(cids[at] == own, at, -1)
            # nodes are the shard's vectors, then the queries that are not among them
            node = np.where(at >= 0, at, len(cids) + np.arange(len(own)))
            ids = np.concatenate((cids, own))
            parent = np.arange(len(ids))

            def roots(x: np.ndarray) -> np.ndarray:
                top = parent[x]
                while (parent[top] != top).any():
                    top = parent[top]
                parent[x] = top
                return top

            def take(k: int, found: np.ndarray, counted: bool) -> None:
                found = found[(unit[found] @ v[k] >= least) & (cids[found] != own[k])]
                if counted:
                    out.append(([1], [own[k]], [shard], [int(times[found].sum())]))
                if not len(found):
                    return
                if not counted:
                    out.append(([0] * len(found), [own[k]] * len(found), cids[found], [0] * len(found)))
                tops = np.unique(roots(np.append(found, node[k])))
                parent[tops] = tops[0]

            range_search(index, v.astype(np.float32), least, hot, own=at, take=take)
            top = roots(np.arange(len(ids)))
            under = np.flatnonzero(top != np.arange(len(ids)))
            out.append((np.full(len(under), 2), ids[under], ids[top[under]], np.zeros(len(under), int)))
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i, c in enumerate(("kind", "a", "b", "n"))})

    return run


def _streamed(least: float, hot: int, wide: int):
    """Over rows sorted by shard, lane and part: the chunks of a shard's graph come first, then its queries, ``wide`` of them at a time."""
    run = _querier(least, hot)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunks, graph, held = None, [], None, []

        def asked() -> pd.DataFrame:
            found = run(pd.concat(held), graph)
            held.clear()
            return found

        for batch in batches:
            for key, rows in batch.groupby(["shard", "lane"], sort=True):
                if key != now:
                    if held:
                        yield asked()
                    now, chunks, graph = key, [], None
                chunks += rows.blob[rows.part >= 0].tolist()
                rows = rows[rows.part < 0]
                if not len(rows):
                    continue
                if graph is None:
                    graph, chunks = pd.DataFrame({"shard": [key[0]], "blob": [b"".join(chunks)]}), []
                for a in range(0, len(rows), wide):
                    held.append(rows.iloc[a : a + wide])
                    if sum(map(len, held)) >= wide:
                        yield asked()
        if held:
            yield asked()

    return stream


def link_vectors(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", hot: int = HOT, shard: int = SHARD, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``."""
    given = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    given = given.withColumn("ok", F.coalesce(fine, F.lit(False)))
    classes = written(given.where("ok").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    total = classes.groupBy("dim").count().toPandas()
    members = given.where("ok").select("vec_id", "v").join(classes.select("v", "cid"), "v").select("vec_id", "cid")
    results, spark = None, vectors.sparkSession
    tb.arrow_batches(spark)
    for dim, count in zip(total.dim.tolist(), total["count"].tolist(), strict=True):
        room, wide = max(64, min(shard, SHARD_BYTES // (12 * dim))), max(64, min(BLOCK, BLOCK_BYTES // (8 * dim)))
        shards, blocks = max(least_shards, -(-count // room)), max(1, -(-count // wide))
        shards = min(shards, max(1, count // 64))
        own = classes.where(F.col("dim") == dim).select("cid", "v", "n", F.pmod(F.xxhash64("cid"), F.lit(shards)).alias("shard"))
        lanes = min(blocks, LANES)
        built = written(own.groupBy("shard").applyInPandas(_build, "shard long, part long, blob binary"), "graphs")
        lane = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
        dealt = built.select("shard", F.explode(lane(lanes)).alias("lane"), "part", "blob", F.lit(None).cast("long").alias("cid"), F.lit(None).cast("array<double>").alias("v"))
        asked = own.select(F.explode(lane(shards)).alias("shard"), F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(lanes)).alias("lane"), F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("blob"), "cid", "v")
        # a graph's chunks, then (part -1) the queries: both of a group in one partition, no row larger than a chunk
        rows = dealt.union(asked).repartitionById(shards * lanes, (F.col("shard") * lanes + F.col("lane")).cast("int")).sortWithinPartitions("shard", "lane", F.col("part") < 0, "part")
        part = rows.mapInPandas(_streamed(least, hot, wide), RESULT)
        part = written(part.withColumn("shards", F.lit(shards)), "links")
        results = part if results is None else results.union(part)
    if results is None:
        results = spark.range(0).select(*[F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in (RESULT + ", shards int").split(", "))])
    pairs = results.where("kind = 0").select("a", "b", "shards")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shards")).distinct()
    both = both.withColumn("shard", F.pmod(F.xxhash64("b"), F.col("shards")))
    counted = results.where("kind = 1").select("a", F.col("b").alias("shard"), "n")
    sparse = both.join(counted.select("a", "shard"), ["a", "shard"], "left_anti").join(classes.select(F.col("cid").alias("b"), "n"), "b").select("a", "n")
    links = sparse.union(counted.select("a", "n")).groupBy("a").agg(F.sum("n").alias("n_links"))
    found = written(connected_components(results.where("kind IN (0, 2)").select("a", "b")).withColumnRenamed("node", "cid"), "components")
    joined = classes.select("cid", "n", "least").join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    by = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    resolved = joined.join(by, "component").join(links.withColumnRenamed("a", "cid"), "cid", "left").select("cid", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), "component_id")
    linked = members.join(resolved, "cid").select("vec_id", "n_links", "component_id")
    alone = given.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
