"""Queries: sampled paths, conceptual bridges, greedy leads, profile report, hulls, random pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weft.catalog.core import EDGE_SQL, SQL, edges, query, sessions, table
from weft.catalog.flows import nodes
from weft.catalog.graphs import links, member, simple
from weft.operators import graph, iterative, kernels, retrieval, sampling
from weft.operators.components import connected_components


@query("g09_anchor_paths")
def g09(spark, d):
    return kernels.per_graph(sessions(spark, d), lambda es: kernels.jittered_paths(es, 6, "anchors"), "source string, target string, path string, hops long")


@query("g09b_sequence_connectors")
def g09b(spark, d):
    anchors = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("id"))
    a = anchors.select(F.col("c_mktsegment").alias("s"), F.col("id").alias("source"))
    pairs = a.join(a.select(F.col("s").alias("t"), F.col("source").alias("target")), F.col("s") < F.col("t")).select("source", "target")
    paths = iterative.shortest_paths(graph.both(links(spark, d)), pairs, 5)
    inner = paths.select(F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("id"))
    return inner.join(anchors.select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").alias("paths"))


def vectors_of_nodes(spark, d):
    """Concepts with a vector each: the embedding numbered by the key modulo their count."""
    e = table(spark, d, "embeddings")
    n = max(e.count(), 1)
    linked = graph.both(links(spark, d)).select(F.col("a").alias("id")).distinct()
    return linked.join(e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("v")), F.col("id") % n == F.col("k")).select("id", "v")


def random_pairs(spark, n: int, count: int, seed: int = 0):
    """(rank, i, j): index pairs of a seeded generator, with repeats, without equal ends; made on the driver, ``count`` of them."""
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, n, 2 * count), rng.integers(0, n, 2 * count)
    keep = i != j
    return spark.createDataFrame([(r, int(a), int(b)) for r, (a, b) in enumerate(list(zip(i[keep], j[keep], strict=True))[:count])], "rank int, i long, j long")


def numbered(df):
    """Rows numbered by id: a rank from range-partitioned counts, without a single task for all rows."""
    ordered = df.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part"), F.col("x.first").alias("first")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    return ordered.join(F.broadcast(before), "part").select("id", (F.col("at") - F.col("first") + F.col("before")).alias("i"))  # a row per partition


@query("l12_random_pairs")
def l12(spark, d):
    n = numbered(vectors_of_nodes(spark, d))
    p = random_pairs(spark, n.count(), 500)
    x = p.join(n.select("i", F.col("id").alias("u")), "i").join(n.select(F.col("i").alias("j"), F.col("id").alias("v")), "j").select("rank", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return x.join(links(spark, d), ["u", "v"], "left_anti")


@query("m01_conceptual_bridges")
def m01(spark, d):
    from weft.functions.measures import dot

    v = vectors_of_nodes(spark, d)
    n = numbered(v).join(v, "id")
    p = random_pairs(spark, n.count(), 2000)
    x = p.join(n.select("i", F.col("id").alias("source"), F.col("v").alias("x")), "i").join(n.select(F.col("i").alias("j"), F.col("id").alias("target"), F.col("v").alias("y")), "j")
    far = x.select("source", "target", (1 - dot(F.col("x"), F.col("y"))).alias("distance")).orderBy(F.desc("distance"), "source", "target").limit(60)
    paths = iterative.shortest_paths(graph.both(links(spark, d)), far.select("source", "target").distinct(), 8).where("dist >= 2")
    return paths.join(far, ["source", "target"]).select("source", "target", F.col("dist").alias("hops"), "distance", (F.col("distance") * F.col("dist")).alias("score")).orderBy(F.desc("score"), "source", "target").limit(10)


@query("l08_capped_leads")
def l08(spark, d):
    # each node is one candidate, so the greedy choice is the best 30 of the best two of every module
    c = nodes(spark, d).join(member(spark, d), "id").select(F.col("id").cast("long"), F.col("module").cast("long"), (0.35 * F.col("rank") + 0.2 * F.log1p("degree")).alias("score"))
    two = sampling.take_ordered(c, ["module"], [F.desc("score"), F.desc("id")], 2)
    return two.select("id", "module", "score").orderBy(F.desc("score"), "module", F.desc("id")).limit(30)


@query("m24_context_blocks", f"WITH {EDGE_SQL}, t AS (SELECT src, concat('- ', src, ' --', relation, '--> ', dst) AS line FROM simple QUALIFY row_number() OVER (PARTITION BY src ORDER BY multiplicity DESC, seq) <= 3) SELECT src, string_agg(line, chr(10) ORDER BY line) AS block FROM t GROUP BY src")
def m24(spark, d):
    s = sampling.take_ordered(simple(spark, d), ["src"], [F.desc("multiplicity"), "seq"], 3)
    lines = s.select("src", F.concat(F.lit("- "), F.col("src").cast("string"), F.lit(" --"), "relation", F.lit("--> "), F.col("dst").cast("string")).alias("line"))
    return lines.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("block"))


_PROFILE = {
    "nodes": f"SELECT nodes FROM ({SQL['g02b_graph_stats']})",
    "edges": f"SELECT edges FROM ({SQL['g02b_graph_stats']})",
    "max degree": f"SELECT max(degree) FROM ({SQL['g02_degrees']})",
    "components": f"SELECT count(DISTINCT component) FROM ({SQL['g03_components']})",
    "largest share": f"SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM ({SQL['g03_components']}) GROUP BY component)",
    "average clustering": f"SELECT avg(clustering) FROM ({SQL['c06_clustering']})",
    "reciprocity": f"SELECT reciprocity FROM ({SQL['c08_reciprocity']})",
    "assortativity": f"SELECT assortativity FROM ({SQL['c08b_assortativity']})",
    "modularity": f"SELECT q FROM ({SQL['c09b_modularity']})",
    "self loops": f"SELECT loops FROM ({SQL['g02b_graph_stats']})",
}


@query("k09_profile_report", " UNION ALL ".join(f"SELECT '{name}' AS metric, round((({sql})::DOUBLE), 6) AS value" for name, sql in _PROFILE.items()))
def k09(spark, d):
    s, u = simple(spark, d), links(spark, d)
    deg = graph.degrees(s)
    comp = connected_components(u.select(F.col("u").alias("a"), F.col("v").alias("b")))
    size = comp.groupBy("component").agg(F.count("*").alias("n"))
    metric = lambda df, name, col: df.select(F.lit(name).alias("metric"), F.col(col).cast("double").alias("value"))
    parts = [
        metric(deg.agg(F.count("*").alias("v")), "nodes", "v"),
        metric(deg.agg(F.sum("out_degree").alias("v")), "edges", "v"),
        metric(deg.agg(F.max("degree").alias("v")), "max degree", "v"),
        metric(size.agg(F.count("*").alias("v")), "components", "v"),
        metric(size.agg((F.max("n") / F.sum("n")).alias("v")), "largest share", "v"),
        metric(graph.clustering(u).agg(F.avg("clustering").alias("v")), "average clustering", "v"),
        metric(graph.reciprocity(s), "reciprocity", "reciprocity"),
        metric(graph.assortativity(u), "assortativity", "assortativity"),
        metric(graph.modularity(u, member(spark, d)), "modularity", "q"),
        metric(edges(spark, d).where("src = dst").agg(F.count("*").alias("v")), "self loops", "v"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("value", F.round("value", 6))


@query("q08_path_leads")
def q08(spark, d):
    n = nodes(spark, d)
    top = n.agg(F.max("degree").alias("m"))
    ends = n.where("degree > 0").orderBy(F.desc("rank"), "id").limit(8).select("id")
    pairs = ends.select(F.col("id").alias("source")).join(ends.select(F.col("id").alias("target")), F.col("source") < F.col("target"))
    p = iterative.shortest_paths(graph.both(links(spark, d)), pairs, 5).join(n.select(F.col("id").alias("target"), "rank", "degree"), "target")
    score = retrieval.lead_score(F.col("rank"), 1 - F.col("rank"), F.lit(0.65), F.col("dist"), F.col("degree"), F.col("m"))
    return p.crossJoin(F.broadcast(top)).select("source", "target", F.col("dist").alias("hops"), score.alias("score")).orderBy(F.desc("score"), "source", "target").limit(15)


@query("v10_hull_area")
def v10(spark, d):
    # the hull of the first two coordinates: of each batch by label, then of these hulls' corners
    p = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))

    def corners(batches):
        for pdf in batches:
            for label, part in pdf.groupby("label", dropna=False):
                h = kernels.convex_hull(part[["x", "y"]].to_numpy(float))
                h = h if len(h) else np.full((1, 2), np.nan)  # a label stays without points too
                yield pd.DataFrame({"label": [None if pd.isna(label) else label] * len(h), "x": h[:, 0], "y": h[:, 1]})

    def area(pdf):
        h = kernels.convex_hull(pdf[["x", "y"]].to_numpy(float))
        x, y = h.T - h[:1].T if len(h) else h.T
        return pd.DataFrame({"label": pdf.label.iloc[:1], "area": [float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2) if len(h) else None]})

    kind = p.schema["label"].dataType.simpleString()
    return p.mapInPandas(corners, f"label {kind}, x double, y double").groupBy("label").applyInPandas(area, f"label {kind}, area double")
