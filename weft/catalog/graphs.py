"""Queries: graph operators over the concept graph and the users' small graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.catalog.core import EDGE_SQL, SESSION_SQL, edges, query, sessions, table
from weft.operators import graph, iterative, kernels
from weft.operators.components import connected_components

E = f"WITH {EDGE_SQL}"
S = f"WITH {SESSION_SQL}"
RS = f"WITH RECURSIVE {SESSION_SQL}"
RE = f"WITH RECURSIVE {EDGE_SQL}"
MEMBER = "member AS (SELECT c_custkey AS id, c_nationkey AS module FROM customer)"


def simple(spark, d):
    return graph.fold(edges(spark, d))


def links(spark, d):
    return graph.links(edges(spark, d))


def member(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("module"))


@query("g01_fold_multigraph", f"{E} SELECT src, dst, count(*) AS multiplicity, arg_min(relation, seq) AS relation, string_agg(DISTINCT relation, '; ' ORDER BY relation) AS relations, min(iter) AS iter, min(seq) AS seq FROM edge WHERE src <> dst GROUP BY 1, 2")
def g01(spark, d):
    return simple(spark, d)


@query("g02_degrees", f"{E} SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM simple UNION ALL SELECT dst, 0, 1 FROM simple) GROUP BY id")
def g02(spark, d):
    return graph.degrees(simple(spark, d))


@query("g02b_graph_stats", f"{E}, n AS (SELECT count(*) AS n FROM (SELECT src FROM simple UNION SELECT dst FROM simple)) SELECT (SELECT n FROM n) AS nodes, count(*) AS edges, round(count(*) / ((SELECT n FROM n) * ((SELECT n FROM n) - 1)), 8) AS density, round(2 * count(*) / (SELECT n FROM n), 6) AS avg_degree, (SELECT count(*) FROM edge WHERE src = dst) AS loops, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT src FROM simple UNION SELECT dst FROM simple)) AS isolates FROM simple")
def g02b(spark, d):
    s = simple(spark, d)
    deg = graph.degrees(s)
    sums = deg.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"))
    loops = edges(spark, d).where("src = dst").agg(F.count("*").alias("loops"))
    alone = table(spark, d, "customer").join(deg, F.col("c_custkey") == F.col("id"), "left_anti").agg(F.count("*").alias("isolates"))
    n, m = F.col("nodes"), F.col("edges")
    return sums.crossJoin(F.broadcast(loops)).crossJoin(F.broadcast(alone)).select("nodes", "edges", F.round(m / (n * (n - 1)), 8).alias("density"), F.round(2 * m / n, 6).alias("avg_degree"), "loops", "isolates")


@query("g03_components", f"{RE}, w(id, label) AS (SELECT DISTINCT a, a FROM both_ UNION SELECT b, label FROM w JOIN both_ ON a = id WHERE label <= b) SELECT id, min(label) AS component FROM w GROUP BY 1")
def g03(spark, d):
    e = links(spark, d).select(F.col("u").alias("a"), F.col("v").alias("b"))
    return connected_components(e).select(F.col("node").alias("id"), "component")


@query("g03b_session_components", f"{RS}, w(graph_id, id, label) AS (SELECT graph_id, src, src FROM hop UNION SELECT graph_id, dst, dst FROM hop UNION SELECT w.graph_id, CASE WHEN h.src = w.id THEN h.dst ELSE h.src END, w.label FROM w JOIN hop h ON w.graph_id = h.graph_id AND w.id IN (h.src, h.dst)) SELECT graph_id, count(DISTINCT label) AS components FROM (SELECT graph_id, id, min(label) AS label FROM w GROUP BY 1, 2) GROUP BY 1")
def g03b(spark, d):
    def comps(es):
        near = kernels._adjacency(es, False)
        return [(len({min(kernels.distances(near, x)) for x in near}),)]

    return kernels.per_graph(sessions(spark, d), comps, "components long")


@query("g04_strong_components", f"{RS}, r(graph_id, a, b) AS (SELECT graph_id, src, dst FROM hop UNION SELECT r.graph_id, r.a, h.dst FROM r JOIN hop h ON r.graph_id = h.graph_id AND r.b = h.src), n AS (SELECT graph_id, src AS id FROM hop UNION SELECT graph_id, dst FROM hop) SELECT n.graph_id, n.id, least(n.id, coalesce(min(x.b), n.id)) AS component FROM n LEFT JOIN (SELECT r.graph_id, r.a, r.b FROM r JOIN r q ON r.graph_id = q.graph_id AND r.a = q.b AND r.b = q.a) x ON x.graph_id = n.graph_id AND x.a = n.id GROUP BY n.graph_id, n.id")
def g04(spark, d):
    return kernels.per_graph(sessions(spark, d), kernels.strong_components, "id string, component string")


@query("g05_component_profile", f"{E} SELECT c_nationkey AS module, count(*) AS edges, min(iter) AS first_iter, max(iter) AS last_iter, quantile_cont(iter::DOUBLE, 0.5) AS median_iter, count(DISTINCT relation) AS relations FROM edge JOIN customer ON src = c_custkey GROUP BY 1")
def g05(spark, d):
    e = edges(spark, d).join(member(spark, d).withColumnRenamed("id", "src"), "src")
    return e.groupBy("module").agg(F.count("*").alias("edges"), F.min("iter").alias("first_iter"), F.max("iter").alias("last_iter"), F.percentile("iter", 0.5).alias("median_iter"), F.size(F.collect_set("relation")).cast("long").alias("relations"))


BFS = "w(source, id, dist) AS (SELECT s.id, s.id, 0 FROM src_ s UNION SELECT w.source, b.b, w.dist + 1 FROM w JOIN both_ b ON w.id = b.a WHERE w.dist < {k})"
SEEDS = "src_ AS (SELECT min(c_custkey) AS id FROM customer GROUP BY c_mktsegment)"


@query("g06_k_hop", f"{RE}, {SEEDS}, {BFS.format(k=2)} SELECT source, id, min(dist) AS dist FROM w GROUP BY 1, 2")
def g06(spark, d):
    seeds = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("id"))
    return iterative.bfs(graph.both(links(spark, d)), seeds, 2).select("source", "id", "dist")


@query("g07_shortest_paths", f"{RE}, {SEEDS}, {BFS.format(k=3)}, t AS (SELECT max(c_custkey) AS id FROM customer GROUP BY c_mktsegment) SELECT w.source, w.id AS target, min(dist) AS dist FROM w JOIN t ON t.id = w.id GROUP BY 1, 2")
def g07(spark, d):
    c = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("source"), F.max("c_custkey").alias("target"))
    pairs = c.select("source").crossJoin(F.broadcast(c.select("target")))  # five of each: one per segment
    return iterative.shortest_paths(graph.both(links(spark, d)), pairs, 3).select("source", "target", "dist")


@query("g08_k_simple_paths", f"{RS}, p(graph_id, path, last_) AS (SELECT graph_id, [src, dst], dst FROM hop WHERE src = 'signup' UNION ALL SELECT p.graph_id, list_append(path, dst), dst FROM p JOIN hop h ON p.graph_id = h.graph_id AND p.last_ = h.src WHERE p.last_ <> 'purchase' AND len(path) < 5 AND NOT list_contains(path, dst)), r AS (SELECT graph_id, array_to_string(path, '>') AS path, len(path) - 1 AS hops, row_number() OVER (PARTITION BY graph_id ORDER BY len(path), array_to_string(path, '>')) AS place FROM p WHERE last_ = 'purchase') SELECT * FROM r WHERE place <= 5")
def g08(spark, d):
    p = iterative.simple_paths(sessions(spark, d), "signup", "purchase", 4).select("graph_id", F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy("hops", "path")).cast("long")).where("place <= 5")


@query("g10_reachability", f"{RE}, {SEEDS}, {BFS.format(k=3)} SELECT source, count(DISTINCT id) AS reached FROM w GROUP BY 1")
def g10(spark, d):
    seeds = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("id"))
    return iterative.bfs(graph.both(links(spark, d)), seeds, 3).groupBy("source").agg(F.count("*").alias("reached"))


@query("g11_cycles", f"{RS}, p(graph_id, path, last_) AS (SELECT graph_id, [src, dst], dst FROM hop WHERE src < dst UNION ALL SELECT p.graph_id, list_append(path, dst), dst FROM p JOIN hop h ON p.graph_id = h.graph_id AND p.last_ = h.src WHERE len(path) < 6 AND dst > path[1] AND NOT list_contains(path, dst)) SELECT p.graph_id, array_to_string(path, '>') AS cycle, len(path) AS length FROM p JOIN hop h ON p.graph_id = h.graph_id AND p.last_ = h.src AND h.dst = path[1]")
def g11(spark, d):
    c = iterative.simple_cycles(sessions(spark, d), 6)
    return c.select("graph_id", F.array_join("path", ">").alias("cycle"), F.size("path").cast("long").alias("length"))


@query("g12_cut_points")
def g12(spark, d):
    # the graphs of single months are sparse: they have bridges
    months = simple(spark, d).select(F.col("iter").alias("graph_id"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "relation")
    return kernels.per_graph(months, kernels.cut_points, "kind string, a string, b string, fragments long")


@query("g13_extent")
def g13(spark, d):
    return kernels.per_graph(sessions(spark, d), kernels.extent, "acyclic boolean, longest long, diameter long, mean_distance double")


@query("g14_induced_subgraph", f"{E}, hub AS (SELECT id FROM deg ORDER BY d DESC, id LIMIT 40) SELECT src, dst, relation FROM simple WHERE src IN (SELECT id FROM hub) AND dst IN (SELECT id FROM hub)")
def g14(spark, d):
    s = simple(spark, d)
    deg = graph.both(graph.links(s)).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    return graph.induced(s, deg.orderBy(F.desc("degree"), "id").limit(40)).select("src", "dst", "relation")


@query("g15_graph_payload", f"{E}, i AS (SELECT dst AS id, count(*) AS in_degree FROM simple GROUP BY 1), o AS (SELECT src AS id, count(*) AS out_degree FROM simple GROUP BY 1) SELECT node.id, c_name AS label, node.iter, node.depth, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM node JOIN customer ON node.id = c_custkey LEFT JOIN i ON i.id = node.id LEFT JOIN o ON o.id = node.id")
def g15(spark, d):
    e = edges(spark, d)
    n = e.select(F.col("src").alias("id"), "iter", "depth").union(e.select("dst", "iter", "depth")).groupBy("id").agg(F.min("iter").alias("iter"), F.min("depth").alias("depth"))
    deg = graph.degrees(graph.fold(e))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return n.join(c, "id").join(deg, "id", "left").select("id", "label", "iter", "depth", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


@query("p03_provenance_cap", f"{E} SELECT src, dst, relation, edge.iter, seq FROM edge WHERE edge.iter <= 24 AND src IN (SELECT id FROM node WHERE iter <= 24) AND dst IN (SELECT id FROM node WHERE iter <= 24)")
def p03(spark, d):
    e = edges(spark, d)
    n = e.select(F.col("src").alias("id"), "iter").union(e.select("dst", "iter")).groupBy("id").agg(F.min("iter").alias("iter"))
    return graph.capped_subgraph(n, e, 24).select("src", "dst", "relation", "iter", "seq")


@query("p10_duplicate_labels", "SELECT lower(p_name) AS label, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(*) > 1")
def p10(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_name").alias("label"), "p_brand").agg(F.count("*").alias("c")).groupBy("label").agg(F.sum("c").alias("n"), F.count("*").alias("brands")).where("n > 1")


@query("j08_two_paths", f"{E} SELECT x.relation AS r1, y.relation AS r2, count(*) AS n FROM simple x JOIN simple y ON x.dst = y.src AND x.src <> y.dst GROUP BY 1, 2")
def j08(spark, d):
    return graph.two_paths(simple(spark, d)).groupBy("r1", "r2").agg(F.count("*").alias("n"))


@query("j09_wedges", f"{E}, w AS (SELECT x.b AS u, y.b AS v FROM both_ x JOIN both_ y ON x.a = y.a AND x.b < y.b) SELECT u, v, count(*) AS common FROM w WHERE (u, v) NOT IN (SELECT u, v FROM link) GROUP BY 1, 2")
def j09(spark, d):
    return graph.wedges(links(spark, d)).groupBy("u", "v").agg(F.count("*").alias("common"))


@query("c01_pagerank")
def c01(spark, d):
    return iterative.pagerank(simple(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query("c04_eigenvector")
def c04(spark, d):
    return iterative.eigenvector(links(spark, d)).select("id", F.round("value", 8).alias("value"))


@query("c05_core_numbers")
def c05(spark, d):
    return iterative.core_numbers(links(spark, d))


TRI = "tri AS (SELECT x.u, x.v, y.v AS w FROM link x JOIN link y ON x.u = y.u AND x.v < y.v JOIN link z ON z.u = x.v AND z.v = y.v)"


@query("c06_clustering", f"{E}, {TRI}, t AS (SELECT id, count(*) AS t FROM (SELECT u AS id FROM tri UNION ALL SELECT v FROM tri UNION ALL SELECT w FROM tri) GROUP BY id) SELECT deg.id, d AS degree, coalesce(t, 0) AS triangles, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 8) AS clustering FROM deg LEFT JOIN t ON t.id = deg.id")
def c06(spark, d):
    return graph.clustering(links(spark, d)).select("id", "degree", "triangles", F.round("clustering", 8).alias("clustering"))


@query("c06b_transitivity", f"{E}, {TRI} SELECT round(3 * (SELECT count(*) FROM tri) / sum(d * (d - 1) / 2), 8) AS transitivity FROM deg")
def c06b(spark, d):
    c = graph.clustering(links(spark, d))
    return c.agg(F.round(F.sum("triangles") / F.sum(F.col("degree") * (F.col("degree") - 1) / 2), 8).alias("transitivity"))


@query("c08_reciprocity", f"{E} SELECT round(avg((b.src IS NOT NULL)::INT), 8) AS reciprocity, count(*) AS edges FROM simple a LEFT JOIN simple b ON a.src = b.dst AND a.dst = b.src")
def c08(spark, d):
    return graph.reciprocity(simple(spark, d)).withColumn("reciprocity", F.round("reciprocity", 8))


@query("c08b_assortativity", f"{E} SELECT round(corr(x.d, y.d), 6) AS assortativity FROM both_ JOIN deg x ON x.id = a JOIN deg y ON y.id = b")
def c08b(spark, d):
    return graph.assortativity(links(spark, d)).withColumn("assortativity", F.round("assortativity", 6))


@query("c09_communities")
def c09(spark, d):
    return kernels.per_graph(sessions(spark, d), kernels.communities, "id string, module long")


@query("c09b_modularity", f"{E}, {MEMBER}, m AS (SELECT x.module AS m1, y.module AS m2 FROM link JOIN member x ON x.id = u JOIN member y ON y.id = v), t AS (SELECT m, sum(i) AS inside, count(*) AS ends FROM (SELECT m1 AS m, (m1 = m2)::INT AS i FROM m UNION ALL SELECT m2, 0 FROM m) GROUP BY m), n AS (SELECT sum(ends) / 2 AS l FROM t) SELECT round(sum(inside / l - (ends / (2 * l)) ** 2), 6) AS q FROM t, n")
def c09b(spark, d):
    return graph.modularity(links(spark, d), member(spark, d)).withColumn("q", F.round("q", 6))


@query("c10_module_profiles", f"{E}, {MEMBER}, m AS (SELECT src, dst, x.module AS m1, y.module AS m2 FROM simple JOIN member x ON x.id = src JOIN member y ON y.id = dst), s AS (SELECT module, count(*) AS size FROM member GROUP BY 1), i AS (SELECT m1 AS module, count(*) AS internal FROM m WHERE m1 = m2 GROUP BY 1), x AS (SELECT module, count(*) AS external, count(DISTINCT id) AS boundary FROM (SELECT m1 AS module, src AS id FROM m WHERE m1 <> m2 UNION ALL SELECT m2, dst FROM m WHERE m1 <> m2) GROUP BY 1) SELECT s.module, size, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, coalesce(boundary, 0) AS boundary FROM s LEFT JOIN i USING (module) LEFT JOIN x USING (module)")
def c10(spark, d):
    return graph.module_profiles(simple(spark, d), member(spark, d))


@query("c11_module_links", f"{E}, {MEMBER} SELECT least(x.module, y.module) AS a, greatest(x.module, y.module) AS b, count(*) AS n, arg_min(src, seq) AS src, arg_min(dst, seq) AS dst FROM simple JOIN member x ON x.id = src JOIN member y ON y.id = dst WHERE x.module <> y.module GROUP BY 1, 2")
def c11(spark, d):
    return graph.module_links(simple(spark, d), member(spark, d))


@query("c12_constraint", f"{E}, p AS (SELECT a, b, 1.0::DOUBLE / d AS p FROM both_ JOIN deg ON id = a), t AS (SELECT x.a, y.b AS c, sum(x.p * y.p) AS p FROM p x JOIN p y ON x.b = y.a WHERE x.a <> y.b GROUP BY 1, 2) SELECT p.a AS id, round(sum((p.p + coalesce(t.p, 0)) ** 2), 8) AS constraint_ FROM p LEFT JOIN t ON t.a = p.a AND t.c = p.b GROUP BY p.a")
def c12(spark, d):
    return graph.constraint(links(spark, d)).select("id", F.round("constraint", 8).alias("constraint_"))


@query("c13_hubs", f"{E} SELECT id, d AS degree FROM deg ORDER BY d DESC, id LIMIT (SELECT greatest(10, least(50, ceil(count(*) * 0.01)))::BIGINT FROM deg)")
def c13(spark, d):
    deg = graph.both(links(spark, d)).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    return graph.hubs(deg)


@query("c14_mining_candidates", f"{E}, {MEMBER}, a AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS rn, 0 AS o FROM deg QUALIFY rn <= 20), b AS (SELECT deg.id, row_number() OVER (PARTITION BY module ORDER BY d DESC, deg.id) AS rn, 1 AS o FROM deg JOIN member USING (id) QUALIFY rn <= 5) SELECT id, min(o * 100 + rn) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def c14(spark, d):
    deg = graph.both(links(spark, d)).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    top = deg.orderBy(F.desc("degree"), "id").limit(20)
    top = top.select("id", F.row_number().over(Window.orderBy(F.desc("degree"), "id")).cast("long").alias("place"))
    per = deg.join(member(spark, d), "id").withColumn("rn", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("degree"), "id"))).where("rn <= 5").select("id", (F.col("rn") + 100).cast("long").alias("place"))
    return top.union(per).groupBy("id").agg(F.min("place").alias("place"))


@query("m03_open_triads", f"{E}, p AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, x.seq AS s1, y.seq AS s2 FROM simple x JOIN simple y ON x.dst = y.src AND x.src <> y.dst) SELECT a, arg_min(b, (s1, s2)) AS b, c, count(*) AS paths FROM p WHERE (a, c) NOT IN (SELECT src, dst FROM simple) GROUP BY a, c")
def m03(spark, d):
    return graph.open_triads(simple(spark, d))


@query("m04_analogies", f"{E}, p AS (SELECT x.relation AS r1, y.relation AS r2, x.src AS a, x.dst AS b, y.dst AS c, x.seq * 1000000 + y.seq AS o FROM simple x JOIN simple y ON x.dst = y.src AND x.src <> y.dst), q AS (SELECT *, row_number() OVER (PARTITION BY r1, r2 ORDER BY o) AS rn FROM p QUALIFY rn <= 60) SELECT x.r1, x.r2, count(*) AS pairs FROM q x JOIN q y ON x.r1 = y.r1 AND x.r2 = y.r2 AND x.rn < y.rn AND NOT list_has_any([x.a, x.b, x.c], [y.a, y.b, y.c]) GROUP BY 1, 2")
def m04(spark, d):
    p = graph.two_paths(simple(spark, d)).withColumn("rn", F.row_number().over(Window.partitionBy("r1", "r2").orderBy(F.col("s1") * 1000000 + F.col("s2")))).where("rn <= 60")
    x = p.select("r1", "r2", "rn", F.array("a", "b", "c").alias("n"))
    y = p.select("r1", "r2", F.col("rn").alias("rn2"), F.array("a", "b", "c").alias("n2"))
    return x.join(y, ["r1", "r2"]).where((F.col("rn") < F.col("rn2")) & ~F.arrays_overlap("n", "n2")).groupBy("r1", "r2").agg(F.count("*").alias("pairs"))


def _same(x: str, y: str, no: str) -> str:
    return f"CASE WHEN {x}.module = {y}.module THEN 'same' ELSE '{no}' END"


@query(
    "m11_motifs",
    f"""{E}, {MEMBER}, i AS (SELECT s.* FROM simple s JOIN deg ON deg.id = src QUALIFY row_number() OVER (PARTITION BY dst ORDER BY d DESC, seq) <= 36), o AS (SELECT s.* FROM simple s JOIN deg ON deg.id = dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY d DESC, seq) <= 36),
p AS (SELECT i.relation AS r1, o.relation AS r2, concat('source-middle:', {_same("x", "y", "cross")}, '; middle-target:', {_same("y", "z", "cross")}, '; endpoints:', {_same("x", "z", "different")}) AS role, concat(i.src, '>', i.dst, '>', o.dst) AS t, i.seq AS s1, o.seq AS s2
FROM i JOIN o ON i.dst = o.src AND i.src <> o.dst JOIN member x ON x.id = i.src JOIN member y ON y.id = i.dst JOIN member z ON z.id = o.dst WHERE NOT (x.module = y.module AND y.module = z.module))
SELECT r1, r2, role, count(*) AS n, array_to_string((list(t ORDER BY s1, s2))[1:4], ' ') AS examples FROM p GROUP BY 1, 2, 3""",
)
def m11(spark, d):
    s = simple(spark, d)
    rank = graph.both(graph.links(s)).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("rank"))
    return graph.motifs(s, member(spark, d), rank).withColumn("examples", F.array_join("examples", " "))


@query("m12_structural_analogies", f"{S}, w AS (SELECT graph_id AS id, concat(src, relation) AS k, count(*)::DOUBLE AS w FROM hop GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1) SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w) / any_value(p.n * q.n), 6) AS cosine, count(*) AS shared FROM w x JOIN w y ON x.k = y.k AND x.id < y.id JOIN n p ON p.id = x.id JOIN n q ON q.id = y.id GROUP BY 1, 2 HAVING sum(x.w * y.w) / any_value(p.n * q.n) >= 0.55 AND count(*) >= 2")
def m12(spark, d):
    w = sessions(spark, d).groupBy(F.col("graph_id").alias("id"), F.concat("src", "relation").alias("key")).agg(F.count("*").cast("double").alias("w"))
    return graph.signature_cosine(w, 0.55, 2).withColumn("cosine", F.round("cosine", 6))


_WL = f"{S}, bw AS (SELECT graph_id, src AS id, dst AS o, concat('>', relation) AS r FROM hop UNION ALL SELECT graph_id, dst, src, concat('<', relation) FROM hop), c0 AS (SELECT DISTINCT graph_id, id, sha1('') AS c FROM bw)" + "".join(f", n{i} AS (SELECT bw.graph_id, bw.id, string_agg(concat(r, ':', c), ',' ORDER BY concat(r, ':', c)) AS n FROM bw JOIN c{i - 1} k ON k.graph_id = bw.graph_id AND k.id = bw.o GROUP BY 1, 2), c{i} AS (SELECT k.graph_id, k.id, sha1(concat(c, '|', n)) AS c FROM c{i - 1} k JOIN n{i} USING (graph_id, id))" for i in (1, 2, 3))


@query("m14_colour_classes", f"{_WL} SELECT graph_id, id, c AS colour FROM c3")
def m14(spark, d):
    return iterative.refine_colours(sessions(spark, d), ["graph_id"], 3)


@query("m17_automorphisms")
def m17(spark, d):
    return kernels.per_graph(sessions(spark, d), kernels.automorphisms, "automorphisms long")


@query("e02_graph_merge", f"{E} SELECT id, min(iter) AS iter, min(depth) AS depth FROM node GROUP BY id")
def e02(spark, d):
    e = edges(spark, d)
    return e.select(F.col("src").alias("id"), "iter", "depth").union(e.select("dst", "iter", "depth")).groupBy("id").agg(F.min("iter").alias("iter"), F.min("depth").alias("depth"))


@query("e03_last_relation", f"{E} SELECT src, dst, arg_max(relation, seq) AS relation FROM edge WHERE src <> dst GROUP BY 1, 2")
def e03(spark, d):
    return edges(spark, d).where("src <> dst").groupBy("src", "dst").agg(F.max_by("relation", "seq").alias("relation"))
