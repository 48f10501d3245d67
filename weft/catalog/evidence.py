"""Queries: communities and classes of the concept graph, deeper evidence, growth of a run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.catalog import flows
from weft.catalog.core import EDGE_SQL, edges, query, table
from weft.catalog.graphs import MEMBER, links, member, simple
from weft.catalog.mining import _COS, _DOT, _OPEN, cents, concept_vectors, names
from weft.operators import centrality, communities, context, embedding, evidence, graph, growth, insights, isomorphism, iterative, mining, probes
from weft.shared import written
from weft.streaming import incremental

E = f"WITH {EDGE_SQL}"
R = f"WITH RECURSIVE {EDGE_SQL}"


def born(spark, d):
    """(id, iter) of every concept."""
    e = edges(spark, d)
    return e.select(F.col("src").alias("id"), "iter").union(e.select("dst", "iter")).groupBy("id").agg(F.min("iter").alias("iter"))


def found_modules(spark, d):
    """(id, module): communities of the concept graph itself."""
    return communities.communities(links(spark, d))


@query("c09c_graph_communities")
def c09c(spark, d):
    return found_modules(spark, d)


@query("c09d_community_profiles")
def c09d(spark, d):
    return graph.module_profiles(simple(spark, d), written(found_modules(spark, d), "modules"))


@query("v12b_linear_probes")
def v12b(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("layer"), (F.col("label") % 2).alias("y"), "embedding")
    p = probes.probes(e, "layer", "y", "embedding")
    return p.select("layer", "n", *[F.round(c, 4).alias(c) for c in ("accuracy", "auroc", "f1")])


def early_graph(spark, d):
    """The graph of the first rounds, which is sparse, with its centralities and communities."""
    s = written(simple(spark, d).where("iter <= 3"), "simple")
    return s, written(centrality.centralities(s), "cents"), written(communities.communities(graph.links(s)), "modules")


@query("m15b_rooted_ego_classes")
def m15b(spark, d):
    s, c, m = early_graph(spark, d)
    return isomorphism.ego_isomorphisms(s, mining.candidates(c, m, names(spark, d), 500), c, m).withColumn("score", F.round("score", 6))


@query("m16b_module_classes")
def m16b(spark, d):
    s, c, m = early_graph(spark, d)
    return isomorphism.module_isomorphisms(s, m, c).withColumn("score", F.round("score", 6))


@query(
    "m18b_distant_paths",
    f"""{R}, {MEMBER}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), ce AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) GROUP BY i)),
cd AS (SELECT id, 1 - list_dot_product(v, c) / sqrt(list_dot_product(c, c)) AS far FROM v, ce), dg AS (SELECT v.id, count(s.id) AS d FROM v LEFT JOIN (SELECT src AS id FROM simple UNION ALL SELECT dst FROM simple) s ON s.id = v.id GROUP BY v.id),
ca AS (SELECT id, row_number() OVER (ORDER BY far DESC, id) AS rn FROM cd QUALIFY rn <= 20 UNION ALL SELECT id, 100 + row_number() OVER (ORDER BY d DESC, id) AS rn FROM dg QUALIFY rn <= 300), en AS (SELECT DISTINCT ca.id, module, v FROM ca JOIN v USING (id) LEFT JOIN member USING (id)),
pr AS (SELECT x.id AS source, y.id AS target, 1 - list_dot_product(x.v, y.v) AS distance FROM en x JOIN en y ON x.id < y.id AND x.module IS DISTINCT FROM y.module WHERE list_dot_product(x.v, y.v) <= 0.35),
w(source, id, dist) AS (SELECT DISTINCT source, source, 0 FROM pr UNION SELECT source, b, dist + 1 FROM w JOIN both_ ON both_.a = w.id WHERE dist < 6), h AS (SELECT source, id AS target, min(dist) AS dist FROM w GROUP BY 1, 2)
SELECT source, target, dist AS hops, round(distance, 6) AS distance FROM pr JOIN h USING (source, target) ORDER BY pr.distance DESC, source, target LIMIT 20""",
)
def m18b(spark, d):
    p = evidence.distant_paths(written(simple(spark, d), "simple"), member(spark, d), concept_vectors(spark, d))
    return p.select("source", "target", "hops", F.round("distance", 6).alias("distance"))


@query("m19b_deep_evidence")
def m19b(spark, d):
    return evidence.deep_evidence(written(simple(spark, d), "simple"), cents(spark, d), written(found_modules(spark, d), "modules"), born(spark, d)).withColumn("value", F.round("value", 9))


@query(
    "m19c_epoch_relations",
    f"{E}, q AS (SELECT quantile_cont(iter, 0.25) AS q1, quantile_cont(iter, 0.75) AS q3 FROM node), e AS (SELECT s.relation, greatest(s.iter, x.iter, y.iter) AS t FROM simple s JOIN node x ON x.id = src JOIN node y ON y.id = dst) SELECT CASE WHEN t <= q1 THEN 'early' WHEN t <= q3 THEN 'middle' ELSE 'late' END AS epoch, relation, count(*) AS n FROM e, q GROUP BY 1, 2",
)
def m19c(spark, d):
    return evidence.epoch_relations(simple(spark, d), born(spark, d))


@query("m19d_hub_free_paths")
def m19d(spark, d):
    p = evidence.hub_free_paths(written(simple(spark, d), "simple"), cents(spark, d), written(found_modules(spark, d), "modules"))
    return p.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">")).withColumn("score", F.round("score", 9))


_STEP = "list_transform(list_zip({y}.v, {x}.v), lambda t: t[1] - t[2])"
_LEN = "CASE WHEN list_dot_product({p}, {p}) > 1e-18 THEN sqrt(list_dot_product({p}, {p})) ELSE 1 END"


@query(
    "m04b_scored_analogies",
    f"""{E}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.relation AS r1, y.relation AS r2, x.src AS a, x.dst AS b, y.dst AS c, row_number() OVER (PARTITION BY x.relation, y.relation ORDER BY x.seq, y.seq) AS rn FROM simple x JOIN simple y ON x.dst = y.src AND x.src <> y.dst QUALIFY rn <= 60),
i AS (SELECT p.*, {_STEP.format(x="va", y="vb")} AS p1, {_STEP.format(x="vb", y="vc")} AS p2, va.v AS va, vc.v AS vc FROM p JOIN v va ON va.id = a JOIN v vb ON vb.id = b JOIN v vc ON vc.id = c),
j AS (SELECT *, {_LEN.format(p="p1")} AS n1, {_LEN.format(p="p2")} AS n2 FROM i),
s AS (SELECT x.r1, x.r2, x.a, x.b, x.c, y.a AS d, y.b AS e, y.c AS f, 0.5 * (list_dot_product(x.p1, y.p1) / (x.n1 * y.n1) + list_dot_product(x.p2, y.p2) / (x.n2 * y.n2)) AS par, 1 - greatest(list_dot_product(x.va, y.va), list_dot_product(x.vc, y.vc)) AS nov
FROM j x JOIN j y ON x.r1 = y.r1 AND x.r2 = y.r2 AND x.rn < y.rn AND NOT list_has_any([x.a, x.b, x.c], [y.a, y.b, y.c]))
SELECT r1, r2, a, b, c, d, e, f, round(par, 6) AS parallelism, round(nov, 6) AS novelty, round(par * greatest(0, nov), 6) AS score FROM s""",
)
def m04b(spark, d):
    p = evidence.analogies(simple(spark, d), concept_vectors(spark, d))
    return p.select("r1", "r2", *"abcdef", *[F.round(c, 6).alias(c) for c in ("parallelism", "novelty", "score")])


@query(
    "w19b_reach_and_recombinations",
    f"""{E}, {_OPEN}, fe AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, min(iter) AS iter FROM edge WHERE src <> dst GROUP BY 1, 2), fb AS (SELECT u AS x, v AS y, iter FROM fe UNION ALL SELECT v, u, iter FROM fe),
nbe AS (SELECT nb.a, nb.b, iter FROM nb JOIN fb ON x = a AND y = b), mt AS (SELECT x.b AS u, y.b AS v, min(greatest(nu.iter, nv.iter, x.iter, y.iter)) AS iter FROM nbe x JOIN nbe y ON x.a = y.a AND x.b < y.b JOIN node nu ON nu.id = x.b JOIN node nv ON nv.id = y.b WHERE (x.b, y.b) IN (SELECT u, v FROM op) GROUP BY 1, 2),
g AS (SELECT avg(s) AS mean, stddev_pop(s) AS sd FROM (SELECT list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)),
rc AS (SELECT iter, count(*) AS new FROM (SELECT iter FROM mt {_COS}, g WHERE ({_DOT} - mean) / sd < -1) GROUP BY 1),
nv AS (SELECT node.*, embedding::DOUBLE[] AS v FROM node JOIN embeddings ON vec_id = node.id), sd AS (SELECT v FROM nv ORDER BY depth, iter, id LIMIT 1), lo AS (SELECT iter, min(list_dot_product(nv.v, sd.v)) AS low FROM nv, sd GROUP BY 1)
SELECT iter, round(1 - min(low) OVER w, 6) AS reach, coalesce(sum(new) OVER w, 0)::BIGINT AS recombinations FROM lo FULL JOIN rc USING (iter) WINDOW w AS (ORDER BY iter ROWS UNBOUNDED PRECEDING)""",
)
def w19b(spark, d):
    e, v = edges(spark, d), concept_vectors(spark, d)
    n = e.select(F.col("src").alias("id"), "iter", "depth").union(e.select("dst", "iter", "depth")).groupBy("id").agg(F.min("iter").alias("iter"), F.min("depth").alias("depth"))
    seed = n.join(v, "id").agg(F.min_by("v", F.struct("depth", "iter", "id")).alias("v"))
    met = mining.recombinations(e, n.select("id", "iter"), v)
    return evidence.reach_by_round(n.select("id", "iter"), v, met, seed).withColumn("reach", F.round("reach", 6))


_CANON = "WITH e AS (SELECT label AS g, vec_id AS id, embedding FROM embeddings)"


def canonical(spark, d):
    """Canonical graphs of the labels: concepts are vectors, edges join a vector with the next two of its label."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("g"), "vec_id", "embedding", (F.col("vec_id") % 10).alias("iter"))
    w = Window.partitionBy("g").orderBy("vec_id")
    steps = None
    for k in (1, 2):
        one = e.select("g", F.col("vec_id").alias("src"), F.lead("vec_id", k).over(w).alias("dst"), F.concat(F.lit("r"), (F.col("vec_id") % 3).cast("string")).alias("relation"), "iter", (F.col("vec_id") * 2 + k).alias("seq")).where("dst IS NOT NULL")
        steps = one if steps is None else steps.union(one)
    return growth.canonical_graph(e, steps, "g", "vec_id", "embedding", 0.3)


@query("e01_canonical_nodes")
def e01(spark, d):
    return canonical(spark, d)[0]


@query("e02b_canonical_edges")
def e02b(spark, d):
    return canonical(spark, d)[1]


_STEPS = "st AS (SELECT user_id AS run, event_id AS seq, floor(value * 10)::BIGINT AS tokens, (event_id % 4)::BIGINT AS new_nodes, (event_id % 3)::BIGINT AS pushed FROM events)"
LIMITS = growth.Limits(calls=60, tokens=9000, iters=50, window=4, min_new=0.5)


def run_steps(events):
    """Steps of runs: a user's events."""
    return events.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 10).cast("long").alias("tokens"), (F.col("event_id") % 4).cast("long").alias("new_nodes"), (F.col("event_id") % 3).cast("long").alias("pushed"))


_WINDOWED = "x AS (SELECT run, count(*) OVER w AS steps, (sum(tokens) OVER w)::BIGINT AS tokens, (1 + sum(pushed) OVER w - count(*) OVER w)::BIGINT AS frontier, (sum(new_nodes) OVER w)::BIGINT AS nodes, sum(new_nodes) OVER (PARTITION BY run ORDER BY seq ROWS 3 PRECEDING) AS fresh FROM st WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)), y AS (SELECT *, CASE WHEN steps >= 60 THEN 'budget_calls' WHEN tokens >= 9000 THEN 'budget_tokens' WHEN steps >= 50 THEN 'max_iters' WHEN frontier <= 0 THEN 'frontier_empty' WHEN steps >= 4 AND fresh < 2.0 THEN 'novelty_stop' END AS reason FROM x)"


@query("k06b_stop_reasons", f"WITH {_STEPS}, {_WINDOWED} SELECT run, steps, tokens, frontier, nodes, reason FROM y QUALIFY row_number() OVER (PARTITION BY run ORDER BY reason IS NULL, CASE WHEN reason IS NULL THEN -steps ELSE steps END) = 1")
def k06b(spark, d):
    return growth.stops(run_steps(table(spark, d, "events")), "run", "seq", LIMITS)


@query("k06c_stream_stops", f"WITH {_STEPS}, {_WINDOWED} SELECT run, steps, tokens, frontier, nodes, reason FROM y WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY steps) = 1")
def k06c(spark, d):
    return incremental.drained(growth.stream_stops(run_steps(incremental.source(spark, f"{d}/events.parquet")), "run", "seq", LIMITS))


_STRATEGY_SQL = f"""{E}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), dg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM simple UNION ALL SELECT dst FROM simple) GROUP BY id), nq AS (SELECT id FROM dg WHERE id % 5 <> 0),
ce AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) GROUP BY i)), cn AS (SELECT id, v, list_dot_product(v, c) AS s FROM v, ce), fa AS (SELECT id, v, s, row_number() OVER (ORDER BY s, id) AS rn FROM cn WHERE id % 5 <> 0 QUALIFY rn <= 4),
nd AS (SELECT row_number() OVER (ORDER BY iter DESC, id) AS rank, id AS anchor, NULL::BIGINT AS other FROM node QUALIFY rank <= 4),
ed AS (SELECT row_number() OVER (ORDER BY list_dot_product(x.v, y.v) DESC, x.id DESC, y.id DESC) AS rank, x.id AS anchor, y.id AS other FROM v x JOIN v y ON x.id < y.id WHERE list_dot_product(x.v, y.v) >= 0.55 AND (x.id, y.id) NOT IN (SELECT u, v FROM link) QUALIFY rank <= 4),
fr AS (SELECT row_number() OVER (ORDER BY d, id) AS rank, id AS anchor, NULL::BIGINT AS other FROM dg WHERE id % 5 <> 0 QUALIFY rank <= 4),
pt AS (SELECT fa.id, fa.s, arg_min(v.id, (list_dot_product(v.v, fa.v), v.id)) AS other FROM fa JOIN v ON v.id <> fa.id WHERE rn <= 2 GROUP BY 1, 2),
le AS (SELECT row_number() OVER (ORDER BY part, s, id) AS rank, id AS anchor, other FROM (SELECT 0 AS part, s, id, other FROM pt UNION ALL SELECT 1, s, id, NULL FROM fa) QUALIFY rank <= 4)
SELECT 'node' AS strategy, rank, anchor, other FROM nd UNION ALL SELECT 'edge', * FROM ed UNION ALL SELECT 'frontier', * FROM fr UNION ALL SELECT 'novelty', rn, id, NULL FROM fa UNION ALL SELECT 'leap', * FROM le UNION ALL SELECT 'mixed', rn, id, NULL FROM fa"""


@query("k07b_strategies", _STRATEGY_SQL)
def k07b(spark, d):
    s, n = simple(spark, d), born(spark, d)
    degree = graph.degrees(s).select("id", "degree", F.lit(0).alias("seq"))
    state = growth.State(written(degree, "degree"), s, written(concept_vectors(spark, d), "vectors"), n.select("id", (-F.col("iter")).alias("seq")), degree.where("id % 5 = 0").select("id").union(concept_vectors(spark, d).where("id % 5 = 0").select("id")).distinct())
    out = None
    for name in [*growth.STRATEGIES, "mixed"]:
        one = growth.choose(name, state, 3)
        out = one if out is None else out.unionAll(one)
    return out.withColumn("rank", F.col("rank").cast("long"))


def concept_graph(spark, d, ranked: bool) -> context.Graph:
    """The concept graph for searches; with PageRank and core numbers, or the given rank of the catalog in their place."""
    n, s = flows.nodes(spark, d), written(simple(spark, d), "simple")
    u = written(graph.links(s), "links")
    if ranked:
        pr = iterative.pagerank(s).withColumnRenamed("rank", "pagerank")
        n = n.drop("rank").join(pr, "id", "left").join(iterative.core_numbers(u), "id", "left").join(born(spark, d), "id", "left").na.fill(0)
    else:
        n = n.select("id", "label", "degree", F.col("rank").alias("pagerank"), F.lit(0).alias("core"))
    v = concept_vectors(spark, d)
    asked = v.orderBy("id").limit(1).first()["v"]
    return context.Graph(written(n, "nodes"), written(graph.both(u), "near"), s, v, tuple(float(x) for x in asked))


@query(
    "q01b_node_search",
    f"""{E}, {flows.NODES}, h AS (SELECT id, degree, rank, lower(concat(label, ' ', id, ' label ', label)) AS hay FROM nd), k AS (SELECT id, contains(hay, 'machinery')::INT + contains(hay, '#00000001')::INT + 2 * contains(hay, 'machinery #00000001')::INT AS hits, degree, rank FROM h),
t AS (SELECT id, hits + ln(1 + degree) + 10 * rank AS score FROM k WHERE hits > 0), s AS (SELECT nd.id, 100 + 25 * list_dot_product(embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]) + ln(1 + degree) AS score FROM embeddings JOIN nd ON nd.id = vec_id ORDER BY score DESC, nd.id LIMIT 50)
SELECT id, round(max(score), 5) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM s) JOIN nd USING (id) GROUP BY id, degree ORDER BY max(score) DESC, degree DESC, id LIMIT 50""",
)
def q01b(spark, d):
    return context.search_nodes(concept_graph(spark, d, False), "MACHINERY  #00000001", 50).select("id", F.round("score", 5).alias("score"))


@query("q05b_ranked_context")
def q05b(spark, d):
    rows, _ = context.ranked_context(concept_graph(spark, d, True), "which customers of the machinery segment are linked", [1, 5, 9], "building", 240)
    return rows.select("id", F.round("score", 6).alias("score"), "sources", "rank")


@query("q06b_context_texts")
def q06b(spark, d):
    g = concept_graph(spark, d, True)
    out = None
    for mode in ("none", "focused", "graph_rag"):
        one = context.context(g, "which customers of the machinery segment are linked", [1, 5, 9], "building", mode)
        out = one if out is None else out.unionAll(one)
    return out


@query("c14b_candidates")
def c14b(spark, d):
    return mining.candidates(cents(spark, d), written(found_modules(spark, d), "modules"), names(spark, d))


@query("k08b_all_insights")
def k08b(spark, d):
    s, v, c = written(simple(spark, d), "simple"), concept_vectors(spark, d), cents(spark, d)
    found = written(insights.mine_all(s, v, c, written(found_modules(spark, d), "modules")), "insights")
    return insights.actionability(found, c, v).withColumn("score", F.round("score", 6))


_INSIGHTS = "ins AS (SELECT kind, place, concepts FROM (SELECT 'open_triad' AS kind, row_number() OVER (ORDER BY s DESC, a, b, c) - 1 AS place, [a, b, c] AS concepts FROM tri QUALIFY place < 10))"


@query(
    "w10b_actionability",
    f"""{E}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.src AS a, arg_min(x.dst, (x.seq, y.seq)) AS b, y.dst AS c FROM simple x JOIN simple y ON x.dst = y.src AND x.src <> y.dst WHERE (x.src, y.dst) NOT IN (SELECT src, dst FROM simple) GROUP BY x.src, y.dst),
tri AS (SELECT a, b, c, greatest(0, list_dot_product(va.v, vc.v)) AS s FROM p JOIN v va ON va.id = a JOIN v vc ON vc.id = c), {_INSIGHTS},
ce AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) GROUP BY i)), nv AS (SELECT id, row_number() OVER (ORDER BY 1 - list_dot_product(v, c), id) / count(*) OVER () AS p FROM v, ce), sl AS (SELECT id, row_number() OVER (ORDER BY d, id) / count(*) OVER () AS p FROM deg),
x AS (SELECT place, avg(coalesce(nv.p, 0.5)) AS n, avg(sl.p) AS s FROM (SELECT place, unnest(concepts) AS id FROM ins) JOIN sl USING (id) LEFT JOIN nv USING (id) GROUP BY place)
SELECT kind, place::INTEGER AS place, round(0.45 * n + 0.3 * s + 0.25 * (1 - place / (SELECT count(*) FROM ins)), 4) AS actionability FROM ins JOIN x USING (place)""",
)
def w10b(spark, d):
    s, v = simple(spark, d), concept_vectors(spark, d)
    degree = graph.both(graph.links(s)).groupBy(F.col("a").alias("id")).agg(F.count("*").cast("double").alias("pagerank"))  # degrees stand for PageRank
    order = [F.desc("score"), "a", "b", "c"]
    first = insights.scored_triads(s, v).orderBy(*order).limit(10)
    found = first.select(F.lit("open_triad").alias("kind"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("place"), F.array("a", "b", "c").alias("concepts"))
    return insights.actionability(written(found, "triads"), degree, v).select("kind", "place", "actionability")


@query("n02b_modularity_redetected")
def n02b(spark, d):
    z = embedding.modularity_z(links(spark, d), 50)
    return z.select(*[F.round(c, 6).alias(c) for c in z.columns])
