"""Search over a concept graph and the context that a question gets from it.

``nodes`` has id, label, degree, pagerank and core (and, for texts, iter and depth);
``near`` is (a, b), both directions of the links; ``vectors`` (id, v) with the query's
vector, where there are any.  Every list has a cap, so what goes into one text is
bounded by parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.iterative import shortest_paths
from weft.operators.retrieval import keyword_score, rank_context, semantic_top
from weft.shared import written

#: What the sources of a context add to a score.
SELECTED, HIT_LEAST, HIT_FIRST, HIT_STEP, CENTRAL, CENTRAL_FIRST, CENTRAL_STEP, NEAR, INNER, END = 500.0, 20.0, 60, 0.35, 12.0, 40, 0.15, 4.0, 35.0, 12.0
#: Seeds, those whose neighbourhood counts, pairs that are joined, nodes of a path.
SEEDS, AROUND, PAIRS, PATH_NODES, SHOWN_NODES = 24, 16, 8, 14, 10
#: Least and most nodes and edges of the ranked mode, most edges among selected nodes, hits of the focused mode.
NODE_BOUNDS, EDGE_BOUNDS, SELECTED_EDGES, FOCUS_HITS = (120, 900), (220, 1400), 80, 12


@dataclass(frozen=True)
class Graph:
    """What a search looks at."""

    nodes: DataFrame
    near: DataFrame
    simple: DataFrame
    vectors: DataFrame | None = None
    asked: tuple[float, ...] | None = None


def _best(rows: DataFrame, order: list, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows with their place from 0."""
    return rows.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def search_nodes(g: Graph, query: str, limit: int = 50) -> DataFrame:
    """(id, score, degree, semantic, rank) of the best hits: by words of label, id and other columns, and by similarity, whichever scores higher."""
    words = " ".join(query.lower().split())
    own = g.nodes
    if not words:
        return own.limit(0).select("id", F.lit(0.0).alias("score"), "degree", F.lit(None).cast("double").alias("semantic"), F.lit(0).alias("rank"))
    hay = F.concat_ws(" ", F.coalesce("label", F.col("id").cast("string")), F.col("id").cast("string"), *[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in own.columns if c not in ("id", "degree", "pagerank", "core")])
    hits = keyword_score(hay, words)
    text = own.withColumn("hits", hits).where("hits > 0").select("id", (F.col("hits") + F.log1p("degree") + 10 * F.col("pagerank")).alias("score"), F.lit(None).cast("double").alias("semantic"))
    if g.vectors is not None and g.asked is not None:
        top = semantic_top(g.vectors.join(own.select("id", "degree"), "id"), list(g.asked), max(12, limit))
        text = text.unionByName(top.select("id", "score", F.col("similarity").alias("semantic")))
    found = text.groupBy("id").agg(F.max("score").alias("score"), F.max("semantic").alias("semantic")).join(own.select("id", "degree"), "id")
    return _best(found, [F.desc("score"), F.desc("degree"), "id"], limit).select("id", "score", "degree", "semantic", "rank")


def resolve(g: Graph, asked: list[str], limit: int = 8) -> list[tuple[str, int]]:
    """(text, id) of the concepts that texts name: by id, else by label whatever the case, else the best hit; each id once, ``limit`` at most.

    ``asked`` is a request of a user, a handful of texts.
    """
    texts = [t.strip() for t in asked if t and t.strip()]
    ids = g.nodes.where(F.col("id").cast("string").isin(texts)).select(F.col("id").cast("string").alias("t"), "id")
    low = g.nodes.groupBy(F.lower("label").alias("t")).agg(F.max("id").alias("id")).where(F.col("t").isin([t.lower() for t in texts]))
    by_id, by_label = ({r.t: r.id for r in df.collect()} for df in (ids, low))
    out: list[tuple[str, int]] = []
    for t in texts:
        found = by_id.get(t, by_label.get(t.lower()))
        if found is None:
            first = search_nodes(g, t, 1).first()
            found = first.id if first else None
        if found is not None and found not in [i for _, i in out]:
            out.append((t, found))
        if len(out) >= limit:
            break
    return out


def neighbourhood(near: DataFrame, degree: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """(id, degree, seed) within ``depth`` steps of the seeds; no further once ``limit`` are there, and of more than that the seeds and those of highest degree."""
    seen = written(seeds.select("id").distinct().join(degree.select("id"), "id").withColumn("dist", F.lit(0)), "around")
    for step in range(1, depth + 1):
        if seen.limit(limit).count() >= limit:
            break
        fresh = seen.where(F.col("dist") == step - 1).select(F.col("id").alias("a")).join(near, "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = written(seen.unionByName(fresh.withColumn("dist", F.lit(step))), "around")
    facts = seen.join(degree.select("id", "degree"), "id").select("id", "degree", (F.col("dist") == 0).alias("seed"))
    return facts.orderBy(F.desc("seed"), F.desc("degree"), "id").limit(limit)


def ranked_context(g: Graph, question: str, selected: list[int], query: str = "", max_nodes: int = 240) -> tuple[DataFrame, DataFrame]:
    """(id, score, sources, rank) of the concepts that a question is about, and the paths (pair, path) among its seeds.

    Scores add up over what was selected, found, central, near the seeds, or between them.
    """
    spark = g.nodes.sparkSession
    given = spark.createDataFrame([(i, x) for i, x in enumerate(selected)], "place int, id long") if selected else spark.range(0).select(F.lit(0).alias("place"), "id")
    given = given.join(g.nodes.select("id"), "id")
    parts: list[tuple[str, DataFrame]] = [("selected", given.select("id", F.lit(SELECTED).alias("score")))]
    words = " ".join(x for x in (query.strip(), question.strip()) if x)
    if words:
        hits = search_nodes(g, words, max(60, min(180, max_nodes)))
        parts.append(("semantic/text", hits.select("id", (F.greatest(F.lit(HIT_LEAST), F.col("score")) + F.greatest(F.lit(0), HIT_FIRST - F.col("rank")) * HIT_STEP).alias("score"))))
    central = _best(g.nodes, [F.desc("pagerank"), F.desc("degree"), F.desc("core"), "id"], max(16, min(80, max_nodes // 4)))
    parts.append(("centrality", central.select("id", (CENTRAL + F.greatest(F.lit(0), CENTRAL_FIRST - F.col("rank")) * CENTRAL_STEP).alias("score"))))
    first = written(rank_context(parts).select("id", "score"), "first")
    best = _best(first, [F.desc("score"), "id"], SEEDS, "place").select((F.col("place") + len(selected)).alias("place"), "id")
    once = given.select("place", "id").union(best).groupBy("id").agg(F.min("place").alias("place"))
    seeds = written(once.withColumn("place", F.row_number().over(Window.orderBy("place")) - 1), "seeds")  # the selected and ``SEEDS`` rows
    around = neighbourhood(g.near, g.nodes, seeds.where(F.col("place") < AROUND), 2, 3 * max_nodes)
    parts.append(("neighborhood", around.select("id", (NEAR + F.log1p("degree")).alias("score"))))
    follow = lambda rows, start, step, most: rows.where((F.col("place") % step == 0) & (F.col("place") < most)).alias("x").join(rows.alias("y"), F.col("y.place") == F.col("x.place") + 1).select((F.col("x.place") + start).alias("pair"), F.col("x.id").alias("source"), F.col("y.id").alias("target"))
    pairs = follow(given, 0, 1, len(selected)).union(follow(seeds.where("place < 8"), len(selected), 2, 8))
    pairs = _best(pairs, ["pair"], PAIRS, "n").groupBy(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(F.min(F.struct("n", "source", "target")).alias("f")).where("lo <> hi").select("f.n", "f.source", "f.target")
    found = written(shortest_paths(g.near, written(pairs.select("source", "target"), "pairs"), PATH_NODES - 1).join(pairs, ["source", "target"]).select(F.col("n").alias("pair"), "path"), "paths")
    on = found.select("pair", F.size("path").alias("size"), F.posexplode("path").alias("i", "id"))
    parts.append(("path", on.select("id", F.when((F.col("i") > 0) & (F.col("i") < F.col("size") - 1), INNER).otherwise(END).alias("score"))))
    ranked = _best(rank_context(parts), [F.desc("score"), "id"], max_nodes)
    return ranked.select("id", "score", "sources", "rank"), found


def _line(nodes: DataFrame) -> Column:
    bits = [F.concat(F.lit("id="), F.col("id").cast("string")), F.concat(F.lit("label="), F.coalesce("label", F.col("id").cast("string")))]
    bits += [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("iter", "depth") if c in nodes.columns]
    return F.concat(F.lit("- "), F.concat_ws("; ", *bits), F.lit("; degree="), F.col("degree").cast("string"))


def _joined(rows: DataFrame, order: Column, text: Column, name: str) -> DataFrame:
    """One row: the lines in order; rows are as many as a cap allows."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "\n").alias(name), F.count("*").alias(f"n_{name}"))


def context(g: Graph, question: str, selected: list[int], query: str = "", mode: str = "none", depth: int = 1, max_nodes: int = 90, max_edges: int = 160, name: str = "(loaded graph)", topic: str = "(not recorded)") -> DataFrame:
    """One row (mode, node_count, edge_count, text): the nodes, edges and short paths that a question gets.

    Modes: none (only what was selected), focused (around what was selected or found), graph_rag (the ranked context).
    """
    if mode not in ("none", "focused", "graph_rag"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = g.nodes.sparkSession
    words, rag = query, None
    if mode == "graph_rag":
        max_nodes, max_edges = (min(max(n, b[0]), b[1]) for n, b in ((max_nodes, NODE_BOUNDS), (max_edges, EDGE_BOUNDS)))
        ranked, rag = ranked_context(g, question, selected, query, max_nodes)
        kept = written(ranked, "ranked").join(g.nodes, "id")
        words = " ".join(x for x in (query.strip(), question.strip()) if x)
    else:
        seeds = spark.createDataFrame([(x,) for x in selected], "id long") if selected else spark.range(0)
        if mode == "none":
            max_edges, words = min(max(max_edges, 0), SELECTED_EDGES), ""
            members = seeds.distinct()
        else:
            if query:
                seeds = seeds.union(search_nodes(g, query, FOCUS_HITS).select("id"))
            around = neighbourhood(g.near, g.nodes, seeds, depth, max_nodes) if selected or query else g.nodes.orderBy(F.desc("degree"), "id").limit(max_nodes)
            members = around.select("id")
        kept = _best(g.nodes.join(members, "id"), [F.desc("degree"), "id"], max_nodes)
    kept = written(kept, "kept")
    degree = g.nodes.select("id", F.col("degree").alias("d"))
    e = g.simple.select("src", "dst", F.coalesce("relation", F.lit("related_to")).alias("relation"))
    for end in ("src", "dst"):
        e = e.join(kept.select(F.col("id").alias(end)), end, "left_semi").join(degree.select(F.col("id").alias(end), F.col("d").alias(f"d_{end}")), end)
    order = [F.desc(F.col("d_src") + F.col("d_dst")), F.desc(F.col("src").cast("string")), F.desc(F.col("dst").cast("string")), F.desc("relation")]
    shown = _best(e if mode != "none" or selected else e.limit(0), order, max_edges)
    line = _line(kept)
    if mode == "graph_rag":
        line = F.concat(line, F.lit("; retrieval="), F.coalesce(F.nullif("sources", F.lit("")), F.lit("ranked")), F.lit("; score="), F.format_string("%.2f", "score"))
    paths = None
    if mode != "none" and len(selected) >= 2:
        steps = list(dict.fromkeys(zip(selected, selected[1:], strict=False)))
        pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(steps) if a != b], "pair int, source long, target long")
        paths = shortest_paths(g.near, pairs.select("source", "target"), SHOWN_NODES - 1).join(pairs, ["source", "target"]).select("pair", "path")
    if rag is not None:
        more = rag.select((F.col("pair") + 1000).alias("pair"), "path")
        paths = more if paths is None else paths.union(more)
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ")
    listed = paths.select("pair", text.alias("t")).groupBy("t").agg(F.min("pair").alias("pair")) if paths is not None else spark.range(0).select(F.lit("").alias("t"), F.lit(0).alias("pair"))
    rows = _joined(kept, F.col("rank"), line, "nodes").crossJoin(_joined(shown, F.col("rank"), F.concat(F.lit("- "), F.col("src").cast("string"), F.lit(" -["), F.col("relation"), F.lit("]- "), F.col("dst").cast("string")), "edges")).crossJoin(_joined(listed, F.col("pair"), F.concat(F.lit("- "), F.col("t")), "paths"))  # one row each
    heads = ("Selected nodes", "Edges among selected nodes") if mode == "none" else ("Key nodes in focus context", "Edges in focus context")
    filled = lambda c, other: F.when(F.col(c) == "", other).otherwise(F.col(c))
    top = f"Graph: {name}\nTopic: {topic}\nQuestion: {question}\nContext mode: {mode}\nSelected nodes: {', '.join(map(str, selected)) or '(none)'}\nRetrieval query: {words or '(none)'}\n\n{heads[0]}:\n"
    body = F.concat(F.lit(top), filled("nodes", "(none)"), F.lit(f"\n\n{heads[1]}:\n"), filled("edges", "(none)"), F.lit("\n\nShort selected paths:\n"), filled("paths", "(none requested or no short path found)"), F.lit("\n"))
    return rows.select(F.lit(mode).alias("mode"), F.col("n_nodes").alias("node_count"), F.col("n_edges").alias("edge_count"), body.alias("text"))
