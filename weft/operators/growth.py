"""Growth of a concept graph: what to ask next, when a run stops, and the graph that merged concepts leave.

Strategies name anchors for the next questions; a run's stop is a fold over its steps,
the same in a batch and in a stream; the canonical graph maps every concept to the one
it was merged into.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.embedding import pairs_above, sequential_dedup
from weft.operators.mining import dot
from weft.shared import written

#: The least cosine of a pair that is asked about, and the order in which ``mixed`` takes turns.
LINK_SIM = 0.55
TURNS = ["frontier", "node", "edge", "novelty", "leap"]
#: The reasons for a stop, the first that holds counts.
REASONS = ["budget_calls", "budget_tokens", "max_iters", "frontier_empty", "novelty_stop"]


@dataclass(frozen=True)
class State:
    """Where a run stands: ``degree`` (id, degree, seq), ``simple`` edges, ``vectors`` (id, v), ``new`` (id, seq) of the last step, ``queried`` (id), ``between`` (id, betweenness) or None, and how many anchors to name."""

    degree: DataFrame
    simple: DataFrame
    vectors: DataFrame
    new: DataFrame
    queried: DataFrame
    between: DataFrame | None = None
    fanout: int = 4


def _first(rows: DataFrame, order: list, n: int, other: Column | None = None) -> DataFrame:
    """(rank, anchor, other) of the first ``n`` rows."""
    pair = F.lit(None).cast("long") if other is None else other
    return rows.withColumn("__other", pair).orderBy(*order).limit(n).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col("id").alias("anchor"), F.col("__other").alias("other"))


def _unvisited(rows: DataFrame, s: State) -> DataFrame:
    """Rows not asked about yet, or all where none is left."""
    fresh = rows.join(s.queried.select("id"), "id", "left_anti")
    return fresh if fresh.limit(1).count() else rows


def node(s: State) -> DataFrame:
    """The newest concepts."""
    return _first(s.new, ["seq", "id"], s.fanout)


def edge(s: State) -> DataFrame:
    """Pairs of similar concepts without an edge, the most similar first."""
    linked = s.simple.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = pairs_above(s.vectors, LINK_SIM).join(linked, ["a", "b"], "left_anti")
    return _first(pairs.select(F.col("a").alias("id"), "b", "similarity"), [F.desc("similarity"), F.desc("id"), F.desc("b")], s.fanout, F.col("b"))


def frontier(s: State) -> DataFrame:
    """Concepts of lowest degree, and, where there is room, the one most between others."""
    n = max(1, s.fanout)
    leaves = _first(_unvisited(s.degree, s), ["degree", "seq", "id"], n)
    if s.between is None:
        return leaves
    hub = s.between.join(s.queried.select("id"), "id", "left_anti").orderBy(F.desc("betweenness"), "id").limit(1)
    hub = hub.join(leaves.select(F.col("anchor").alias("id")), "id", "left_anti").select(F.lit(n + 1).alias("rank"), F.col("id").alias("anchor"), F.lit(None).cast("long").alias("other"))
    both = leaves.unionAll(hub)
    return both.withColumn("rank", F.row_number().over(Window.orderBy("rank"))).where(F.col("rank") <= s.fanout)


def _central(s: State) -> DataFrame:
    """Vectors with their product with the mean of all."""
    mean = s.vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    return s.vectors.crossJoin(F.broadcast(centre)).select("id", "v", dot("v", "c").alias("central"))


def novelty(s: State) -> DataFrame:
    """Concepts farthest from the mean; the newest where there are fewer than three vectors."""
    if s.vectors.limit(3).count() < 3:
        return node(s)
    return _first(_unvisited(_central(s), s), ["central", "id"], s.fanout)


def leap(s: State) -> DataFrame:
    """Outlying concepts, each with the concept least like it, then outlying concepts alone."""
    if s.vectors.limit(3).count() < 3:
        return novelty(s)
    far = written(_unvisited(_central(s), s).orderBy("central", "id").limit(max(1, s.fanout)), "far")
    seeds = far.orderBy("central", "id").limit(max(1, s.fanout // 2)).select(F.col("id").alias("seed"), F.col("v").alias("sv"), "central")  # ``fanout`` rows at most
    pairs = s.vectors.join(F.broadcast(seeds), F.col("id") != F.col("seed")).groupBy("seed", "central").agg(F.min(F.struct(dot("v", "sv").alias("s"), "id")).alias("least"))
    mixed_ = pairs.select(F.lit(0).alias("part"), "central", F.col("seed").alias("id"), F.col("least.id").alias("other"))
    alone = far.select(F.lit(1).alias("part"), "central", "id", F.lit(None).cast("long").alias("other"))
    return _first(mixed_.unionAll(alone), ["part", "central", "id"], s.fanout, F.col("other"))


STRATEGIES = {"node": node, "edge": edge, "frontier": frontier, "novelty": novelty, "leap": leap}


def choose(name: str, s: State, turn: int = 0) -> DataFrame:
    """(strategy, rank, anchor, other) of a strategy by name; ``mixed`` takes turns."""
    own = TURNS[turn % len(TURNS)] if name == "mixed" else name
    if own not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {[*STRATEGIES, 'mixed']}")
    return STRATEGIES[own](s).select(F.lit(name).alias("strategy"), "rank", "anchor", "other")


@dataclass(frozen=True)
class Limits:
    """When a run stops: calls, tokens and steps, and the mean of new concepts over a window of steps."""

    calls: int
    tokens: int
    iters: int
    window: int
    min_new: float


def stops(steps: DataFrame, run: str, order: str, limits: Limits) -> DataFrame:
    """(run, steps, tokens, frontier, nodes, reason) of every run at the step that stops it, reason null while it goes on.

    ``steps`` has tokens, new_nodes and pushed (questions added) of every step; each step takes one question from the
    frontier, which starts with one.  Windows go along one run; a run's steps are as many as its budget allows.
    """
    so_far = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    recent = Window.partitionBy(run).orderBy(order).rowsBetween(1 - limits.window, 0)
    s = steps.select(run, order, F.count("*").over(so_far).alias("steps"), F.sum("tokens").over(so_far).alias("tokens"), (1 + F.sum("pushed").over(so_far) - F.count("*").over(so_far)).alias("frontier"), F.sum("new_nodes").over(so_far).alias("nodes"), F.sum("new_nodes").over(recent).alias("fresh"))
    novel = (F.col("steps") >= limits.window) & (F.col("fresh") < limits.min_new * limits.window)
    reason = F.when(F.col("steps") >= limits.calls, REASONS[0]).when(F.col("tokens") >= limits.tokens, REASONS[1]).when(F.col("steps") >= limits.iters, REASONS[2]).when(F.col("frontier") <= 0, REASONS[3]).when(novel, REASONS[4])
    s = s.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("steps", "tokens", "frontier", "nodes", "reason")))
    last = F.max(F.struct("steps", "tokens", "frontier", "nodes", "reason"))
    return s.groupBy(run).agg(F.coalesce(first, last).alias("x")).select(run, "x.*")


def stream_stops(stream: DataFrame, run: str, order: str, limits: Limits) -> DataFrame:
    """(run, steps, tokens, frontier, nodes, reason) once for every run of a stream, when a step stops it; the state of a run is six numbers and a window.

    Steps of a batch go by ``order``; later steps of a run that has stopped change nothing.
    """

    def fold(key, batches, state: GroupState):
        done, steps, tokens, frontier, nodes, fresh = state.get if state.exists else (False, 0, 0, 1, 0, [])
        recent = deque(fresh, limits.window)
        out = []
        rows = pd.concat(list(batches)).sort_values("order")
        for used, new, pushed in zip(rows.tokens.tolist(), rows.new_nodes.tolist(), rows.pushed.tolist(), strict=True):
            if done:
                break
            steps, tokens, frontier, nodes = steps + 1, tokens + used, frontier + pushed - 1, nodes + new
            recent.append(new)
            facts = (steps >= limits.calls, tokens >= limits.tokens, steps >= limits.iters, frontier <= 0, len(recent) == limits.window and sum(recent) < limits.min_new * limits.window)
            reason = next((r for r, holds in zip(REASONS, facts, strict=True) if holds), None)
            if reason:
                done = True
                out.append((key[0], steps, tokens, frontier, nodes, reason))
        state.update((done, steps, tokens, frontier, nodes, list(recent)))
        yield pd.DataFrame(out, columns=["run", "steps", "tokens", "frontier", "nodes", "reason"])

    given = stream.select(F.col(run).cast("long").alias("run"), F.col(order).cast("long").alias("order"), *[F.col(c).cast("long").alias(c) for c in ("tokens", "new_nodes", "pushed")])
    return given.groupBy("run").applyInPandasWithState(fold, "run long, steps long, tokens long, frontier long, nodes long, reason string", "done boolean, steps long, tokens long, frontier long, nodes long, recent array<long>", "append", GroupStateTimeout.NoTimeout)


def canonical_graph(concepts: DataFrame, edges: DataFrame, by: str, order: str, vector: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each group's graph after its concepts, in order of arrival, were merged into the most similar earlier one.

    ``concepts`` has the group, its ``order`` (the concept's number), the vector and iter; ``edges`` the group, src, dst,
    relation, iter and seq.  Nodes: (group, id, iter, merged) with the round of the concept that was kept and the
    numbers that joined it; edges: (group, src, dst, relation, iter, seq), without loops, of parallel ones the first.
    """
    merged = written(sequential_dedup(concepts, by, order, vector, threshold).select(by, F.col("id").alias("raw"), F.col("merged_into").alias("id")), "merged")
    born = concepts.select(by, F.col(order).cast("long").alias("raw"), "iter")
    nodes = merged.join(born, [by, "raw"]).groupBy(by, "id").agg(F.min(F.when(F.col("raw") == F.col("id"), F.col("iter"))).alias("iter"), F.array_sort(F.collect_list(F.when(F.col("raw") != F.col("id"), F.col("raw")))).alias("merged"))
    e = edges
    for end in ("src", "dst"):
        e = e.join(merged.select(by, F.col("raw").alias(end), F.col("id").alias(f"__{end}")), [by, end])
    e = e.where("__src <> __dst").groupBy(by, F.col("__src").alias("src"), F.col("__dst").alias("dst")).agg(F.min(F.struct("seq", "relation", "iter")).alias("first"))
    return nodes, e.select(by, "src", "dst", "first.relation", "first.iter", "first.seq")
