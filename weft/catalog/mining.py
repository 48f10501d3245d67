"""Queries: whole-graph centralities and the miners that rest on them, over the concept graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.catalog.core import EDGE_SQL, edges, query, table
from weft.catalog.graphs import links, simple
from weft.catalog.rules import LABEL_SQL, LABELS, TOPIC, pick, quoted
from weft.catalog.vectors import vectors
from weft.functions import labels
from weft.operators import centrality, communities, mining, sampling
from weft.operators.graph import both
from weft.operators.graph import links as graph_links
from weft.shared import written

E = f"WITH {EDGE_SQL}"


def names(spark, d):
    """(id, label) of every concept."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), pick(LABELS, F.col("c_custkey")).alias("label"))


def cents(spark, d):
    """Centralities of the concept graph, computed once for a query."""
    return written(centrality.centralities(written(simple(spark, d), "simple")), "cents")


def modules(spark, d):
    """(id, module): communities of the concept graph, found once for a query."""
    return written(communities.communities(links(spark, d)), "modules")


def concept_vectors(spark, d):
    """(id, v): vectors of the concepts that have one."""
    return vectors(spark, d).select("id", "v")


@query("c02_betweenness")
def c02(spark, d):
    return centrality.betweenness(links(spark, d)).select("id", F.round("betweenness", 9).alias("betweenness"))


@query("c03_closeness")
def c03(spark, d):
    return centrality.closeness(links(spark, d)).select("id", F.round("closeness", 9).alias("closeness"))


_OPEN = "nb AS (SELECT a, b FROM both_ QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 200), op AS (SELECT DISTINCT x.b AS u, y.b AS v FROM nb x JOIN nb y ON x.a = y.a AND x.b < y.b WHERE (x.b, y.b) NOT IN (SELECT u, v FROM link))"
_COS = "LEFT JOIN embeddings e1 ON e1.vec_id = u LEFT JOIN embeddings e2 ON e2.vec_id = v"
_DOT = "list_dot_product(e1.embedding::DOUBLE[], e2.embedding::DOUBLE[])"


@query(
    "m02_latent_links",
    f"""{E}, {_OPEN}, aa AS (SELECT u, v, count(*) AS common, sum(1 / ln(d)) AS aa FROM op JOIN both_ x ON x.b = u JOIN both_ y ON y.b = v AND y.a = x.a JOIN deg ON deg.id = x.a GROUP BY u, v)
SELECT u, v, common, round(aa / max(aa) OVER (), 6) AS structural, round(coalesce({_DOT}, 0), 6) AS semantic, round(0.5 * aa / max(aa) OVER () + 0.5 * greatest(0, coalesce({_DOT}, 0)), 6) AS score FROM aa {_COS}""",
)
def m02(spark, d):
    found = mining.latent_links(written(links(spark, d), "links"), concept_vectors(spark, d))
    return found.select("u", "v", "common", *[F.round(c, 6).alias(c) for c in ("structural", "semantic", "score")])


@query(
    "m06_dissonance",
    f"""WITH RECURSIVE {EDGE_SQL}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT id FROM deg)), pr AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS s FROM v a JOIN v b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= 0.55),
w(source, id, dist) AS (SELECT DISTINCT a, a, 0 FROM pr UNION SELECT source, both_.b, dist + 1 FROM w JOIN both_ ON both_.a = w.id WHERE dist < 8), h AS (SELECT source, id, min(dist) AS dist FROM w GROUP BY 1, 2)
SELECT a, b, round(s, 6) AS similarity, dist AS hops, round(s * CASE WHEN dist IS NULL THEN 1.5 ELSE 1 + dist / 8.0 END, 6)::DOUBLE AS score FROM pr LEFT JOIN h ON source = a AND id = b WHERE dist IS NULL OR dist >= 3""",
)
def m06(spark, d):
    found = mining.dissonance(written(simple(spark, d), "simple"), concept_vectors(spark, d), beyond=False)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"), "hops", F.round("score", 6).alias("score"))


@query("m07_broker_ideas")
def m07(spark, d):
    return mining.broker_ideas(simple(spark, d), modules(spark, d), cents(spark, d)).withColumn("score", F.round("score", 6))


@query("m09_long_range_paths")
def m09(spark, d):
    return mining.long_range_paths(written(simple(spark, d), "simple"), cents(spark, d), modules(spark, d), names(spark, d), concept_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("m10_short_bridges")
def m10(spark, d):
    return mining.short_bridges(written(simple(spark, d), "simple"), cents(spark, d), modules(spark, d), names(spark, d), concept_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("m13_brokers")
def m13(spark, d):
    return mining.brokers(simple(spark, d), modules(spark, d), cents(spark, d), names(spark, d)).withColumn("score", F.round("score", 6))


@query("m20_bridge_scores")
def m20(spark, d):
    return mining.bridge_scores(simple(spark, d), modules(spark, d), cents(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "m25_recombinations",
    f"""{E}, {_OPEN}, fe AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, min(iter) AS iter FROM edge WHERE src <> dst GROUP BY 1, 2), fb AS (SELECT u AS x, v AS y, iter FROM fe UNION ALL SELECT v, u, iter FROM fe),
nbe AS (SELECT nb.a, nb.b, iter FROM nb JOIN fb ON x = a AND y = b), mt AS (SELECT x.b AS u, y.b AS v, min(greatest(nu.iter, nv.iter, x.iter, y.iter)) AS iter FROM nbe x JOIN nbe y ON x.a = y.a AND x.b < y.b JOIN node nu ON nu.id = x.b JOIN node nv ON nv.id = y.b WHERE (x.b, y.b) IN (SELECT u, v FROM op) GROUP BY 1, 2),
g AS (SELECT avg(s) AS mean, stddev_pop(s) AS sd FROM (SELECT list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id))
SELECT u, v, round(({_DOT} - mean) / sd, 5) AS z, iter FROM mt {_COS}, g WHERE ({_DOT} - mean) / sd < -1""",
)
def m25(spark, d):
    e = edges(spark, d)
    born = e.select(F.col("src").alias("id"), "iter").union(e.select("dst", "iter")).groupBy("id").agg(F.min("iter").alias("iter"))
    return mining.recombinations(e, born, concept_vectors(spark, d)).withColumn("z", F.round("z", 5))


@query("q07_graph_leads")
def q07(spark, d):
    v = concept_vectors(spark, d)
    asked = v.orderBy("id").limit(1).first()["v"]
    return mining.graph_leads(written(simple(spark, d), "simple"), names(spark, d), v, [float(x) for x in asked]).select("id", "seed", "hop", F.round("score", 6).alias("score"))


@query("m22_path_pairs")
def m22(spark, d):
    # scored paths, then the greedy pick: label pairs once, each end twice at most
    p = written(mining.path_pairs(written(simple(spark, d), "simple"), names(spark, d), TOPIC), "pairs")
    best = F.row_number().over(Window.partitionBy("label_pair").orderBy(F.desc("score"), "source", "target"))
    once = written(p.withColumn("rn", best).where("rn = 1"), "once")
    picked = sampling.greedy_blocks(once, "score", "source", "target", 20, 2)
    chosen = [(int(a), int(b)) for _, a, b, _ in picked]
    rows = once.where(F.struct("source", "target").isin(*[F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in chosen])) if chosen else once.limit(0)
    return rows.select("source", "target", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.round("score", 6).alias("score"))


@query(
    "p11_quality_flags",
    f"""{E}, {LABEL_SQL}, nm AS (SELECT c_custkey AS id, lab.* FROM customer JOIN lab ON i = c_custkey % {len(LABELS)}) SELECT 'self_loop' AS flag, count(*) AS n FROM edge WHERE src = dst UNION ALL SELECT 'isolate', count(*) FROM customer WHERE c_custkey NOT IN (SELECT id FROM deg)
UNION ALL SELECT 'weak_relation', count(*) FROM edge WHERE relation IN ('4-NOT SPECIFIED', '5-LOW') UNION ALL SELECT 'duplicate_label', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM nm WHERE norm <> '' GROUP BY norm HAVING count(*) > 1) UNION ALL SELECT 'generic_label', count(*) FROM nm WHERE s IN ({quoted(labels.GENERIC)}) OR norm IN ({quoted(labels.GENERIC)})""",
)
def p11(spark, d):
    e = edges(spark, d)
    linked = both(graph_links(e)).select(F.col("a").alias("c_custkey")).distinct()
    n = names(spark, d)
    flags = [
        e.agg(F.count_if(F.col("src") == F.col("dst")).alias("n")).select(F.lit("self_loop").alias("flag"), "n"),
        table(spark, d, "customer").join(linked, "c_custkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("isolate"), "n"),
        e.agg(F.count_if(F.col("relation").isin("4-NOT SPECIFIED", "5-LOW")).alias("n")).select(F.lit("weak_relation"), "n"),
        n.groupBy(labels.normal(F.col("label")).alias("k")).agg(F.count("*").alias("c")).where("c > 1 AND k <> ''").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).select(F.lit("duplicate_label"), "n"),
        n.agg(F.count_if(F.array_contains(labels.noise_flags(F.col("label")), "generic")).alias("n")).select(F.lit("generic_label"), "n"),
    ]
    out = flags[0]
    for f in flags[1:]:
        out = out.union(f)
    return out
