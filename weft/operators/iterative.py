"""Iterative graph operators: breadth-first search, paths, cycles, PageRank, cores, colours.

Each is a loop of DataFrame jobs over a small state table; states are written to
the shared folder between rounds, so plans stay small and a lost executor costs
one round.  Only counts and convergence figures reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.distances import dealt_distances
from weft.operators.graph import both
from weft.shared import remove, written

#: Links, in both directions, that a task may hold to search pairs: 4 bytes each.
PAIR_LINKS = 128_000_000


def bfs(neighbours: DataFrame, sources: DataFrame, max_depth: int) -> DataFrame:
    """(source, id, dist, via): nodes within ``max_depth`` steps of every source over (a, b); via is the smallest predecessor on a shortest path.

    Every level is a table of its own: what was reached before is read, never written again.
    """
    levels = [written(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(None).cast(sources.schema["id"].dataType).alias("via")), "bfs")]
    seen = levels[0]
    for depth in range(1, max_depth + 1):
        step = levels[-1].select("source", F.col("id").alias("a")).join(neighbours, "a").groupBy("source", F.col("b").alias("id")).agg(F.min("a").alias("via"))
        fresh = written(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(depth).alias("dist"), "via"), "bfs")
        if not fresh.limit(1).count():
            remove(fresh)
            break
        levels.append(fresh)
        seen = seen.union(fresh)
    return seen


def pair_distances(neighbours: DataFrame, pairs: DataFrame, max_depth: int, task_links: int = PAIR_LINKS) -> DataFrame:
    """(a, b, dist) of the pairs that are joined within ``max_depth`` steps over (a, b) in both directions.

    Links are counted first: up to ``task_links`` go to every task, and no table has a row for what lies around a pair.
    In larger graphs each pair is searched by joins, from both ends at once and only until they meet, so a table holds
    what lies within half the distance of an end, not what any end reaches.
    """
    if neighbours.count() <= task_links:
        return dealt_distances(neighbours, pairs, max_depth)
    ends = pairs.select("a", "b").distinct().where("a <> b")
    near = neighbours.select(F.col("a").alias("node"), F.col("b").alias("next"))
    sides = [written(ends.withColumn("node", F.col(c)), "side") for c in ("a", "b")]
    found = None
    for dist in range(1, max_depth + 1):
        mine, other = (dist - 1) % 2, dist % 2
        grown = written(sides[mine].join(near, "node").select("a", "b", F.col("next").alias("node")).distinct(), "side")
        met = written(grown.join(sides[other], ["a", "b", "node"], "left_semi").select("a", "b").distinct().withColumn("dist", F.lit(dist)), "met")
        found = met if found is None else found.union(met)
        gone = met.select("a", "b")
        sides[mine] = written(grown.join(gone, ["a", "b"], "left_anti"), "side")
        sides[other] = written(sides[other].join(gone, ["a", "b"], "left_anti"), "side")
        remove(grown)
        if not sides[mine].limit(1).count():
            break
    return found


def shortest_paths(neighbours: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """(source, target, dist, path) for (source, target) pairs that are connected within ``max_depth``; of equals the smallest predecessors.

    ``neighbours`` has both directions.  All ends are searched at once, a level at a time, and each pair only until its
    ends' levels meet: a table holds what lies within half the distance of an end, not what any end reaches.  An end is
    searched no further than its open pairs need.
    """
    near = written(neighbours.select("a", "b"), "near")
    pairs = written(pairs.select("source", "target").distinct(), "pairs")
    kind = pairs.schema["source"].dataType
    sides = []
    for end in ("source", "target"):
        own = pairs.select(F.col(end).alias("end")).distinct()
        sides.append([written(own.select("end", F.col("end").alias("id"), F.lit(None).cast(kind).alias("via")), "level")])
    left = written(pairs.where("source <> target"), "open")
    done = pairs.where("source = target").select("source", "target", F.lit(0).alias("dist"), F.array("source").alias("path"))
    for dist in range(1, max_depth + 1):
        mine = (dist - 1) % 2
        grown, end = sides[mine], ("source", "target")[mine]
        live = grown[-1].join(left.select(F.col(end).alias("end")).distinct(), "end", "left_semi")
        step = live.select("end", F.col("id").alias("a")).join(near, "a").groupBy("end", F.col("b").alias("id")).agg(F.min("a").alias("via"))
        # both directions are there, so what a level reaches was seen, if at all, in it or the one before
        for seen in grown[-2:]:
            step = step.join(seen.select("end", "id"), ["end", "id"], "left_anti")
        grown.append(written(step, "level"))
        ones, others = (side[-1].select(F.col("end").alias(c), "id") for side, c in zip(sides, ("source", "target"), strict=True))
        met = written(left.join(ones, "source").join(others, ["target", "id"]).select("source", "target", "id"), "met")
        if met.limit(1).count():
            done = done.unionByName(_joined(near, met, *sides).withColumn("dist", F.lit(dist)))
            left = written(left.join(met.select("source", "target").distinct(), ["source", "target"], "left_anti"), "open")
        if not left.limit(1).count() or not grown[-1].limit(1).count():
            break
    return done.select("source", "target", "dist", "path")


def _joined(near: DataFrame, met: DataFrame, fore: list[DataFrame], back: list[DataFrame]) -> DataFrame:
    """(source, target, path) of pairs whose levels just met at ``id``: from the target over the smallest nodes that lie on a shortest path, then over the smallest predecessors."""
    # nodes of shortest paths on the target's side, from where the sides met to the target
    alive = [met]
    for level in back[-2:0:-1]:
        step = alive[-1].select("source", "target", F.col("id").alias("a")).join(near, "a").select("source", "target", F.col("b").alias("id")).distinct()
        alive.append(written(step.join(level.select(F.col("end").alias("target"), "id"), ["target", "id"], "left_semi").select("source", "target", "id"), "alive"))
    now = met.select("source", "target").distinct().withColumn("at", F.col("target")).withColumn("path", F.array("target"))
    if len(back) > 1:
        for nodes in reversed(alive):
            step = now.join(near.withColumnRenamed("a", "at"), "at").join(nodes.withColumnRenamed("id", "b"), ["source", "target", "b"])
            chosen = step.groupBy("source", "target").agg(F.min("b").alias("to"))
            now = now.join(chosen, ["source", "target"]).select("source", "target", F.col("to").alias("at"), F.concat(F.array("to"), "path").alias("path"))
    for level in fore[:0:-1]:
        via = level.select(F.col("end").alias("source"), F.col("id").alias("at"), "via")
        now = now.join(via, ["source", "at"]).select("source", "target", F.col("via").alias("at"), F.concat(F.array("via"), "path").alias("path"))
    return written(now.select("source", "target", "path"), "paths")


def simple_paths(edges: DataFrame, start: str, end: str, cutoff: int) -> DataFrame:
    """All simple directed paths of at most ``cutoff`` edges in every graph_id."""
    grown = edges.where(F.col("src") == start).select("graph_id", F.array("src", "dst").alias("path"))
    done = grown.where(F.element_at("path", -1) == end)
    for _ in range(cutoff - 1):
        live = grown.where(F.element_at("path", -1) != end)
        grown = live.join(edges, (live.graph_id == edges.graph_id) & (F.element_at("path", -1) == edges.src)).where(~F.array_contains("path", F.col("dst"))).select(live.graph_id, F.concat("path", F.array("dst")).alias("path"))
        done = done.union(grown.where(F.element_at("path", -1) == end))
    return done


def simple_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """Simple directed cycles of at most ``longest`` nodes in every graph_id, each once, from its smallest node."""
    grown = edges.where("src < dst").select("graph_id", F.array("src", "dst").alias("path"))
    done = None
    for k in range(2, longest + 1):
        last = F.element_at("path", -1)
        e = edges.select(F.col("graph_id").alias("g"), "src", "dst")
        on = grown.join(e, (F.col("graph_id") == F.col("g")) & (last == F.col("src")))
        closed = on.where(F.col("dst") == F.col("path")[0]).select("graph_id", "path")
        done = closed if done is None else done.union(closed)
        if k < longest:
            grown = on.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select("graph_id", F.concat("path", F.array("dst")).alias("path"))
    return done


def pagerank(simple: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_iter: int = 100) -> DataFrame:
    """(id, rank): damped ranks that sum to one; nodes without out-edges spread theirs evenly; stops at an L1 change of nodes * tolerance."""
    nodes = simple.select(F.col("src").alias("id")).union(simple.select("dst")).distinct()
    n = nodes.count()
    out = simple.groupBy("src").agg(F.count("*").alias("out"))
    edges = written(simple.select("src", "dst").join(out, "src"), "rank-edges")
    now = written(nodes.withColumn("rank", F.lit(1.0 / max(n, 1))), "rank")
    for _ in range(max_iter):
        sent = edges.join(now, edges.src == now.id).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        used = sent.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("used"))
        spread = (1 - damping) / n + damping * (1 - F.col("used")) / n
        step = now.join(sent, now.id == sent.dst, "left").crossJoin(F.broadcast(used)).select("id", (damping * F.coalesce("got", F.lit(0.0)) + spread).alias("rank"), F.col("rank").alias("was"))
        after = written(step, "rank")
        change = after.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        remove(now)
        now = after.select("id", "rank")
        if change < n * tolerance:
            break
    return now


def eigenvector(undirected: DataFrame, max_iter: int = 300, tolerance: float = 1e-4) -> DataFrame:
    """(id, value): power iteration on the adjacency with a unit shift, of Euclidean length one."""
    n = both(undirected)
    nodes = n.select(F.col("a").alias("id")).distinct()
    count = nodes.count()
    links = written(n, "eigen-links")
    now = written(nodes.withColumn("value", F.lit(1.0 / max(count, 1))), "eigen")
    for _ in range(max_iter):
        got = links.join(now, links.b == now.id).groupBy("a").agg(F.sum("value").alias("got"))
        raw = now.join(got, now.id == got.a, "left").select("id", (F.col("value") + F.coalesce("got", F.lit(0.0))).alias("raw"), "value")
        size = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
        after = written(raw.crossJoin(F.broadcast(size)).select("id", (F.col("raw") / F.col("size")).alias("value"), F.col("value").alias("was")), "eigen")
        change = after.agg(F.sum(F.abs(F.col("value") - F.col("was")))).first()[0] or 0.0
        remove(now)
        now = after.select("id", "value")
        if change < count * tolerance:
            break
    return now


def core_numbers(undirected: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(id, core) by h-index rounds: a node's number is the largest h with h neighbours of number h or more, until nothing changes."""
    n = written(both(undirected), "core-links")
    now = written(n.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("core")), "core")
    for _ in range(max_rounds):
        seen = n.join(now.select(F.col("id").alias("b"), F.col("core").alias("k")), "b").join(now.select(F.col("id").alias("a"), F.col("core").alias("own")), "a")
        counts = seen.groupBy("a", "own", F.least("k", "own").alias("k")).agg(F.count("*").alias("c"))
        # at most as many rows per node as it has different neighbour numbers
        spread = F.aggregate(F.reverse(F.array_sort(F.collect_list(F.struct("k", "c")))), F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("h")), lambda s, x: F.struct((s.c + x.c).alias("c"), F.greatest(s.h, F.least(x.k, s.c + x.c)).alias("h")))
        after = written(counts.groupBy("a", "own").agg(spread.alias("s")).select(F.col("a").alias("id"), F.col("s.h").alias("core"), "own"), "core")
        changed = after.where("core <> own").limit(1).count()
        remove(now)
        now = after.select("id", "core")
        if not changed:
            return now
    raise RuntimeError("core numbers did not settle")


def refine_colours(edges: DataFrame, key: list[str], rounds: int) -> DataFrame:
    """(key, id, colour): colours refined by the sorted relations and colours of out- and in-neighbours."""
    both_ways = edges.select(*key, F.col("src").alias("id"), F.col("dst").alias("other"), F.concat(F.lit(">"), "relation").alias("r")).union(edges.select(*key, F.col("dst").alias("id"), F.col("src").alias("other"), F.concat(F.lit("<"), "relation").alias("r")))
    now = both_ways.select(*key, "id").distinct().withColumn("colour", F.sha1(F.lit("")))
    for _ in range(rounds):
        near = both_ways.join(now.withColumnRenamed("id", "other"), [*key, "other"]).groupBy(*key, "id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("r", F.lit(":"), "colour"))), ",").alias("near"))
        now = now.join(near, [*key, "id"]).select(*key, "id", F.sha1(F.concat("colour", F.lit("|"), "near")).alias("colour"))
    return now
