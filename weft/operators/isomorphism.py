"""Exact isomorphism classes of small graphs: ego nets and modules of one large graph.

Every small graph gets a canonical certificate, so equal graphs meet by a group key:
classes are grouped sums, and no bucket of look-alikes is walked by one task.  A
certificate is found by colour refinement and, where colours don't tell nodes apart, by
trying each node of a colour in turn; automorphisms that show up on the way save the
others.  Concept labels count for nothing, directions, relations and the root do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import both, links
from weft.shared import written

#: Sizes of ego nets and of modules that are compared.
EGO_LEAST, EGO_MOST, MODULE_LEAST, MODULE_MOST = 3, 36, 2, 40


def _refined(colour: list[int], near: list[list[tuple]]) -> list[int]:
    """Colours split by the multiset of (direction, relation, colour) around each node until nothing splits; numbers follow the sorted signatures."""
    count = len(set(colour))
    while True:
        signs = [(colour[x], tuple(sorted((d, r, colour[y]) for d, r, y in near[x]))) for x in range(len(near))]
        place = {s: i for i, s in enumerate(sorted(set(signs)))}
        colour = [place[s] for s in signs]
        if len(place) == count:
            return colour
        count = len(place)


def certificate(edges: Iterable[tuple], nodes: Iterable | None = None, root=None) -> str:
    """A digest that two labelled digraphs (src, dst, relation) share exactly if they match, roots on each other."""
    edges = list(edges)
    names = sorted({x for e in edges for x in e[:2]} | set(nodes or ()) | ({root} if root is not None else set()), key=str)
    number = {x: i for i, x in enumerate(names)}
    near: list[list[tuple]] = [[] for _ in names]
    plain = [(number[s], number[d], "related_to" if r is None else r) for s, d, r in edges]
    for s, d, r in plain:
        near[s].append((0, r, d))
        near[d].append((1, r, s))
    best: tuple | None = None
    best_at: list[int] = []
    best_path: list[int] = []
    found: list[list[int]] = []  # automorphisms, as images of nodes

    def leaf(colour: list[int], fixed: list[int]) -> int:
        """How far up the search goes on: an automorphism shows that all below the parting of two paths is the same."""
        nonlocal best, best_at, best_path
        form = tuple(sorted((colour[s], colour[d], r) for s, d, r in plain))
        if best is None or form < best:
            best, best_at, best_path = form, colour, fixed
        elif form == best:
            back = {c: x for x, c in enumerate(best_at)}
            found.append([back[c] for c in colour])
            return next(i for i, (x, y) in enumerate(zip(fixed, best_path, strict=False)) if x != y)
        return len(fixed)

    def orbit(start: list[int], fixed: list[int]) -> set[int]:
        """What automorphisms that leave ``fixed`` in place make of some nodes."""
        moves = [m for m in found if all(m[x] == x for x in fixed)]
        seen, queue = set(start), list(start)
        while queue:
            x = queue.pop()
            for m in moves:
                for y in (m[x], m.index(x)):
                    if y not in seen:
                        seen.add(y)
                        queue.append(y)
        return seen

    def grow(colour: list[int], fixed: list[int]) -> int:
        colour = _refined(colour, near)
        cells: dict[int, list[int]] = {}
        for x, c in enumerate(colour):
            cells.setdefault(c, []).append(x)
        open_cells = [(len(v), c) for c, v in cells.items() if len(v) > 1]
        if not open_cells:
            return leaf(colour, fixed)
        _, chosen = min(open_cells)
        tried: list[int] = []
        for x in cells[chosen]:
            if tried and x in orbit(tried, fixed):
                continue
            tried.append(x)
            # the chosen node comes before the others of its colour
            level = grow([2 * c + (c == chosen and y != x) for y, c in enumerate(colour)], [*fixed, x])
            if level < len(fixed):
                return level
        return len(fixed)

    grow([int(x == root) if root is not None else 0 for x in names], [])
    return hashlib.sha256(repr((len(names), root is not None and best_at[number[root]], best)).encode()).hexdigest()


def _certified(small: DataFrame, rooted: bool) -> DataFrame:
    """``small`` (key, [radius], root, nodes, e) with ``certificate``; e are the edges of one small graph."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            marks = [certificate([(x["src"], x["dst"], x["relation"]) for x in e], list(n), r if rooted else None) for e, n, r in zip(pdf.e, pdf.members, pdf.key, strict=True)]
            yield pdf[["radius", "key", "nodes", "edges"]].assign(certificate=marks)

    kind = dict(small.dtypes)["key"]
    return small.mapInPandas(run, f"radius int, key {kind}, nodes int, edges int, certificate string")


def ego_nets(simple: DataFrame, roots: DataFrame, least: int = EGO_LEAST, most: int = EGO_MOST) -> DataFrame:
    """(radius, key, nodes, edges, certificate) of the ego nets of radius 1 and 2 around ``roots`` (id), of ``least`` to ``most`` nodes with an edge.

    A node of ``most`` or more neighbours makes every net that holds all of them too large, so such nets are left out
    before they are spread: no hub is ever expanded.
    """
    near = both(links(simple))
    degree = near.groupBy("a").agg(F.count("*").alias("d"))
    fine = degree.where(F.col("d") < most).select("a")
    one = roots.select(F.col("id").alias("key")).distinct().join(fine.withColumnRenamed("a", "key"), "key").join(near.select(F.col("a").alias("key"), F.col("b").alias("id")), "key")
    one = written(one, "egos")
    whole = one.join(degree.select(F.col("a").alias("id"), "d"), "id").groupBy("key").agg(F.max("d").alias("d")).where(F.col("d") < most).select("key")
    two = one.join(whole, "key").select("key", F.col("id").alias("a")).join(near, "a").select("key", F.col("b").alias("id"))
    own = one.select("key").distinct().withColumn("id", F.col("key"))
    parts = one.union(own).withColumn("radius", F.lit(1)).unionByName(two.union(one.join(whole, "key")).union(own.join(whole, "key")).distinct().withColumn("radius", F.lit(2)))
    listed = parts.groupBy("radius", "key").agg(F.collect_set("id").alias("members")).where(F.size("members").between(least, most))
    listed = written(listed, "members")
    # at most ``most`` squared pairs a net, looked up among the edges
    pairs = listed.select("radius", "key", "members", F.explode("members").alias("src")).select("radius", "key", "src", F.explode("members").alias("dst")).where("src <> dst")
    held = pairs.join(simple.select("src", "dst", "relation"), ["src", "dst"]).groupBy("radius", "key").agg(F.collect_list(F.struct("src", "dst", "relation")).alias("e"))
    small = listed.join(held, ["radius", "key"]).select("radius", "key", F.size("members").alias("nodes"), F.size("e").alias("edges"), "members", "e")
    return _certified(small, True)


def _classes(marked: DataFrame, cents: DataFrame, member: DataFrame, weight: float) -> DataFrame:
    """Classes of two or more, as grouped sums: size, modules, PageRank, the first members."""
    facts = marked.join(cents.select(F.col("id").alias("key"), "pagerank"), "key", "left").join(member.select(F.col("id").alias("key"), "module"), "key", "left")
    g = facts.groupBy("radius", "certificate").agg(F.first("nodes").alias("nodes"), F.first("edges").alias("edges"), F.count("*").alias("class_size"), F.count_distinct("module").alias("modules"), F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("rank"), F.min("key").alias("first"))
    return g.where("class_size >= 2").withColumn("score", F.col("class_size") * (1.0 + F.col("modules")) + F.col("radius") + weight * F.col("rank")).drop("rank")


def ego_isomorphisms(simple: DataFrame, roots: DataFrame, cents: DataFrame, member: DataFrame) -> DataFrame:
    """(radius, certificate, nodes, edges, class_size, modules, first, score): classes of two or more matching ego nets."""
    return _classes(ego_nets(simple, roots), cents, member, 1500.0)


def module_nets(simple: DataFrame, member: DataFrame, least: int = MODULE_LEAST, most: int = MODULE_MOST) -> DataFrame:
    """(radius 0, key module, nodes, edges, certificate) of the modules of ``least`` to ``most`` nodes, with the edges inside."""
    small = member.groupBy("module").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    own = member.join(small.select("module"), "module")
    listed = own.groupBy(F.col("module").alias("key")).agg(F.collect_list("id").alias("members"))
    inside = simple.join(own.select(F.col("id").alias("src"), F.col("module").alias("key")), "src").join(own.select(F.col("id").alias("dst"), F.col("module").alias("__m")), "dst").where("key = __m")
    held = inside.groupBy("key").agg(F.collect_list(F.struct("src", "dst", "relation")).alias("e"))
    return _certified(listed.join(held, "key").select(F.lit(0).alias("radius"), "key", F.size("members").alias("nodes"), F.size("e").alias("edges"), "members", "e"), False)


def module_isomorphisms(simple: DataFrame, member: DataFrame, cents: DataFrame) -> DataFrame:
    """(certificate, nodes, edges, class_size, first, score): classes of two or more modules that match."""
    marked = written(module_nets(simple, member), "modules")
    rank = member.join(cents.select("id", "pagerank"), "id").groupBy(F.col("module").alias("key")).agg(F.sum("pagerank").alias("rank"))
    g = marked.join(rank, "key", "left").groupBy("certificate").agg(F.first("nodes").alias("nodes"), F.first("edges").alias("edges"), F.count("*").alias("class_size"), F.coalesce(F.sum("rank"), F.lit(0.0)).alias("rank"), F.min("key").alias("first"))
    return g.where("class_size >= 2").withColumn("score", F.col("class_size") * F.col("nodes") + 1200.0 * F.col("rank")).drop("rank")


def graph_classes(graphs: DataFrame, key: str = "graph_id") -> DataFrame:
    """(key, same_as): for every small graph of a table of edges the smallest key among those that match it."""
    listed = graphs.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("src", "dst", "relation")).alias("e"))
    ends = F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(x["src"], x["dst"]))))
    small = listed.select(F.lit(0).alias("radius"), "key", F.size(ends).alias("nodes"), F.size("e").alias("edges"), ends.alias("members"), "e")
    marked = written(_certified(small, False), "marked")
    first = marked.groupBy("certificate").agg(F.min("key").alias("same_as"))
    return marked.join(first, "certificate").select(F.col("key").alias(key), "same_as")
