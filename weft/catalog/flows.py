"""Queries: retrieval, remaining miners, sources, streams and composite plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.catalog.core import EDGE_SQL, MODES, PRED_SQL, SESSION_SQL, edges, query, sessions, table
from weft.catalog.graphs import MEMBER, links, member, simple
from weft.catalog.scores import LONG_SQL, tasks
from weft.functions import measures
from weft.operators import graph, iterative, kernels, retrieval, sampling, scoring, summarize
from weft.shared import fresh_path, written
from weft.sources import readers
from weft.streaming import incremental

E = f"WITH {EDGE_SQL}"
P = f"WITH {PRED_SQL}"


def nodes(spark, d):
    deg = graph.both(links(spark, d)).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("label"), (F.col("c_acctbal") / 100000).alias("rank"))
    return c.join(deg, "id", "left").na.fill(0, ["degree"])


NODES = "nd AS (SELECT c_custkey AS id, concat(c_name, ' ', c_mktsegment) AS label, c_acctbal / 100000 AS rank, coalesce(d, 0) AS degree FROM customer LEFT JOIN deg ON deg.id = c_custkey)"


@query("q01_keyword_search", f"{E}, {NODES}, h AS (SELECT *, contains(lower(label), 'machinery')::INT + contains(lower(label), '#0000000')::INT AS hits FROM nd) SELECT id, hits, round(hits + ln(1 + degree) + 10 * rank, 6) AS score FROM h WHERE hits > 0 ORDER BY hits + ln(1 + degree) + 10 * rank DESC, id LIMIT 20")
def q01(spark, d):
    return retrieval.search(nodes(spark, d), "MACHINERY #0000000", 20).select("id", "hits", F.round("score", 6).alias("score"))


_SEM = "s AS (SELECT vec_id AS id, 100 + 25 * list_dot_product(embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]) + ln(1 + label) AS score FROM embeddings)"


def semantic(spark, d, k):
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).first()
    return retrieval.semantic_top(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("degree")), [float(x) for x in first.embedding] if first else [], k)


@query("q02_semantic_search", f"WITH {_SEM} SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def q02(spark, d):
    return semantic(spark, d, 10).select("id", F.round("score", 5).alias("score"))


@query("q03_concept_resolution", "SELECT p_name AS text, min(p_partkey) AS id FROM part GROUP BY 1")
def q03(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return retrieval.resolve_concepts(p.select(F.col("label").alias("text")).distinct(), p)


@query("q05_context_ranking", f"{E}, {NODES}, a AS (SELECT id, 500.0 AS s, 'selected' AS src FROM nd WHERE id % 100 = 0 UNION ALL SELECT id, ln(1 + degree), 'centrality' FROM nd WHERE degree > 0 UNION ALL SELECT b, 35.0, 'neighbour' FROM both_ WHERE a % 100 = 0) SELECT id, round(sum(s)::DOUBLE, 6) AS score, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM a GROUP BY id")
def q05(spark, d):
    n = nodes(spark, d)
    picked = F.col("id") % 100 == 0
    near = graph.both(links(spark, d)).where(F.col("a") % 100 == 0).select(F.col("b").alias("id"), F.lit(35.0).alias("score"))
    out = retrieval.rank_context([("selected", n.where(picked).select("id", F.lit(500.0).alias("score"))), ("centrality", n.where("degree > 0").select("id", F.log1p("degree").alias("score"))), ("neighbour", near)])
    return out.withColumn("score", F.round("score", 6))


@query("q06_context_assembly", f"{E}, {NODES}, m AS (SELECT id FROM nd ORDER BY (id % 100 = 0) DESC, degree DESC, id LIMIT 60) SELECT src, dst, relation FROM simple WHERE src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m)")
def q06(spark, d):
    top = retrieval.truncated(nodes(spark, d).withColumn("seed", F.col("id") % 100 == 0), 60)
    return graph.induced(simple(spark, d), top).select("src", "dst", "relation")


@query("l11_context_cap", f"{E}, {NODES} SELECT id, degree FROM nd ORDER BY (id % 100 = 0) DESC, degree DESC, id LIMIT 60")
def l11(spark, d):
    return retrieval.truncated(nodes(spark, d).withColumn("seed", F.col("id") % 100 == 0), 60).select("id", "degree")


@query("l07_greedy_pairs")
def l07(spark, d):
    # the greedy choice goes through all candidates, best first, a block at a time; the report is small
    w = written(graph.adamic_adar(links(spark, d)).select("aa", "u", "v"), "pairs")
    picked = sampling.greedy_blocks(w, "aa", "u", "v", 40, 2)
    return spark.createDataFrame([(int(u), int(v), round(float(s), 6)) for s, u, v, _ in picked], "u long, v long, aa double")


@query("m05_feedback_loops", f"WITH RECURSIVE {SESSION_SQL}, p(graph_id, path, last_, w) AS (SELECT graph_id, [src, dst], dst, n FROM hop WHERE src < dst UNION ALL SELECT p.graph_id, list_append(path, dst), dst, w + n FROM p JOIN hop h ON p.graph_id = h.graph_id AND p.last_ = h.src WHERE len(path) < 4 AND dst > path[1] AND NOT list_contains(path, dst)) SELECT p.graph_id, len(path)::INT AS length, count(*) AS loops FROM p JOIN hop h ON p.graph_id = h.graph_id AND p.last_ = h.src AND h.dst = path[1] GROUP BY 1, 2")
def m05(spark, d):
    return iterative.simple_cycles(sessions(spark, d), 4).groupBy("graph_id", F.size("path").alias("length")).agg(F.count("*").alias("loops"))


@query("m08_module_paths", f"WITH RECURSIVE {EDGE_SQL}, {MEMBER}, r AS (SELECT module, min(id) AS id FROM member JOIN deg USING (id) GROUP BY 1), w(source, id, dist) AS (SELECT id, id, 0 FROM r UNION SELECT source, b, dist + 1 FROM w JOIN both_ ON a = w.id WHERE dist < 2) SELECT source, w.id AS target, min(dist)::INT AS dist FROM w JOIN r ON r.id = w.id WHERE source < w.id GROUP BY 1, 2")
def m08(spark, d):
    linked = graph.both(links(spark, d)).select(F.col("a").alias("id")).distinct()
    r = member(spark, d).join(linked, "id").groupBy("module").agg(F.min("id").alias("id")).select("id")
    found = iterative.bfs(graph.both(links(spark, d)), r, 2)
    return found.join(r, "id", "left_semi").where("source < id").select("source", F.col("id").alias("target"), "dist")


@query("m15_ego_isomorphism")
def m15(spark, d):
    def classes(es):
        und = kernels._adjacency(es, False)
        egos = {x: [e for e in es if {e[0], e[1]} <= {x, *und[x]}] for x in und}
        reps: list = []
        for x in egos:
            k = next((i for i, r in enumerate(reps) if kernels.isomorphic(egos[r], egos[x], (r, x))), None)
            if k is None:
                reps.append(x)
                k = len(reps) - 1
            yield x, k

    return kernels.per_graph(sessions(spark, d), lambda es: list(classes(es)), "id string, orbit long")


@query("m18_module_outliers", "WITH c AS (SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), v AS (SELECT label, list(c ORDER BY i) AS c FROM c GROUP BY 1), s AS (SELECT vec_id, e.label, list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(c, c)) AS s FROM embeddings e JOIN v ON e.label = v.label) SELECT label, vec_id, round(s, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s, vec_id) <= 3")
def m18(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = e.groupBy("label", "i").agg(F.avg("x").alias("c"))
    s = e.join(c, ["label", "i"]).groupBy("label", "vec_id").agg((F.sum(F.col("x") * F.col("c")) / F.sqrt(F.sum(F.col("c") * F.col("c")) * F.sum(F.col("x") * F.col("x")))).alias("similarity"))
    return sampling.take_ordered(s, ["label"], ["similarity", "vec_id"], 3).select("label", "vec_id", F.round("similarity", 5).alias("similarity"))


@query("m21_query_relevance", "SELECT p_partkey, len(list_intersect(string_split(lower(p_name), ' '), ['red', 'ring', 'widget']))::INT AS overlap, round(len(list_intersect(string_split(lower(p_name), ' '), ['red', 'ring', 'widget'])) + p_size / 50.0, 6)::DOUBLE AS score FROM part WHERE len(list_intersect(string_split(lower(p_name), ' '), ['red', 'ring', 'widget'])) > 0")
def m21(spark, d):
    n = F.size(F.array_intersect(F.split(F.lower("p_name"), " "), F.array(*map(F.lit, ["red", "ring", "widget"]))))
    return table(spark, d, "part").withColumn("overlap", n).where("overlap > 0").select("p_partkey", "overlap", F.round(F.col("overlap") + F.col("p_size") / 50.0, 6).alias("score"))


@query("m23_neighbour_blocks", f"{E}, r AS (SELECT src, dst, relation, row_number() OVER (PARTITION BY src ORDER BY multiplicity DESC, seq) AS rn FROM simple) SELECT src, string_agg(concat(relation, ':', dst), '; ' ORDER BY rn) AS block FROM r WHERE rn <= 4 GROUP BY src")
def m23(spark, d):
    s = simple(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("multiplicity"), "seq"))).where("rn <= 4")
    return s.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat("relation", F.lit(":"), F.col("dst").cast("string")).alias("t")))), lambda x: x.t), "; ").alias("block"))


@query("n08_link_homophily", f"{E}, {MEMBER}, s AS (SELECT avg((x.module = y.module)::INT) AS linked FROM link JOIN member x ON x.id = u JOIN member y ON y.id = v), b AS (SELECT sum(n * n)::DOUBLE AS s2, sum(n)::DOUBLE AS n FROM (SELECT count(*) AS n FROM member GROUP BY module)) SELECT round(linked, 8) AS linked, round((s2 - n) / (n * (n - 1)), 8) AS random, round(linked - (s2 - n) / (n * (n - 1)), 8) AS delta FROM s, b")
def n08(spark, d):
    e = graph.modules(links(spark, d).select(F.col("u").alias("src"), F.col("v").alias("dst")), member(spark, d)).agg(F.avg((F.col("m1") == F.col("m2")).cast("int")).alias("linked"))
    b = member(spark, d).groupBy("module").agg(F.count("*").alias("n")).agg(((F.sum(F.col("n") * F.col("n")) - F.sum("n")) / (F.sum("n") * (F.sum("n") - 1))).alias("random"))
    return e.crossJoin(F.broadcast(b)).select(F.round("linked", 8).alias("linked"), F.round("random", 8).alias("random"), F.round(F.col("linked") - F.col("random"), 8).alias("delta"))


@query("f37_lexical_distance", "WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part) SELECT p_partkey, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS distance FROM s")
def f37(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(measures.lexical_distance(F.array_distinct(F.split("p_name", " ")), F.split(F.lower("p_type"), " "), 1.0), 6).alias("distance"))


@query("f39_counter_cosine", "WITH w AS (SELECT l_returnflag AS id, l_linenumber AS k, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1) SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w) / any_value(p.n * q.n), 8) AS cosine, count(*) AS shared FROM w x JOIN w y ON x.k = y.k AND x.id < y.id JOIN n p ON p.id = x.id JOIN n q ON q.id = y.id GROUP BY 1, 2")
def f39(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("id"), F.col("l_linenumber").alias("key")).agg(F.count("*").cast("double").alias("w"))
    return graph.signature_cosine(w, 0.0, 1).withColumn("cosine", F.round("cosine", 8))


@query("s02_jsonl_round_trip", "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def s02(spark, d):
    at = fresh_path(spark, "events")
    table(spark, d, "events").select("event_id", "user_id", "event_type").write.mode("overwrite").json(at)
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())])
    return readers.read_jsonl_strict(spark, at, schema).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("s06_growth_tail", "SELECT iter, count(*) AS n_nodes FROM (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS iter FROM events) GROUP BY 1 ORDER BY iter DESC LIMIT 5")
def s06(spark, d):
    at = fresh_path(spark, "growth")
    g = table(spark, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("iter")).agg(F.count("*").alias("n_nodes"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_edges", "new_nodes", "tokens", "cum_tokens")]
    g.select("iter", F.lit(0).cast("long").alias("depth"), "n_nodes", *zero, F.lit(0.5).alias("diversity")).write.mode("overwrite").option("header", True).csv(at)
    return readers.read_growth(spark, at, 5).select("iter", "n_nodes")


@query("s07_transcript_facts", "SELECT count(*) AS turns, arg_max(text, conv_id * 1000 + turn) AS last_question, arg_max(turn, conv_id * 1000 + turn) AS last_iter FROM conversations")
def s07(spark, d):
    c = table(spark, d, "conversations").select(F.col("text").alias("question"), F.col("turn").alias("iter"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    return readers.transcript_facts(c, "o")


@query("s09_prefix_sample", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 25")
def s09(spark, d):
    return readers.prefix_sample(table(spark, d, "documents"), "text", "doc_id", 25).select("doc_id", "lang")


@query("s10_corpus_build", "SELECT source, id, sha256(concat('42:', id)) AS shuffle_key FROM (SELECT 'doc' AS source, doc_id AS id FROM documents UNION ALL SELECT 'bench', item_id FROM benchmark)")
def s10(spark, d):
    a = table(spark, d, "documents").select(F.lit("doc").alias("source"), F.col("doc_id").alias("id"))
    b = table(spark, d, "benchmark").select(F.lit("bench").alias("source"), F.col("item_id").alias("id"))
    return readers.build_corpus([a, b], "id")


@query("s15_manifest_problems", "SELECT 'repeated step' AS problem, s_nationkey::VARCHAR AS value FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
def s15(spark, d):
    m = table(spark, d, "supplier").select(F.col("s_nationkey").alias("step"), F.col("s_name").alias("label"), F.lit("m").alias("model"), F.col("s_suppkey").alias("id"))
    return readers.checkpoint_problems(m)


@query("s17_paper_corpus", "WITH p AS (SELECT conv_id, string_agg(concat('## ', upper(role), chr(10), text), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1) SELECT conv_id, length(text)::INT AS n, md5(text) AS h FROM p WHERE length(text) >= 200")
def s17(spark, d):
    return readers.paper_corpus(table(spark, d, "conversations"), "conv_id", "role", "text", "turn").select("conv_id", F.length("text").alias("n"), F.md5("text").alias("h"))


@query("s19_training_history", "SELECT (event_id % 50)::DOUBLE AS step, round(avg(value), 6) AS value, round(avg(try_cast(event_type AS DOUBLE)), 6) AS event_type FROM events WHERE event_id % 50 <= 40 GROUP BY 1")
def s19(spark, d):
    e = table(spark, d, "events").withColumn("s", (F.col("event_id") % 50).cast("string")).withColumn("value", F.col("value").cast("string"))
    return readers.training_history(e, "s", ["value", "event_type"], 40).select("step", F.round("value", 6).alias("value"), F.round("event_type", 6).alias("event_type"))


@query("s20_reference_dedup", "WITH k AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE 't:' || regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') END AS k FROM part) SELECT arg_max(p_partkey, (p_retailprice, p_name, p_partkey)) AS p_partkey, count(*) AS copies FROM k GROUP BY k")
def s20(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("doi"), F.struct("p_retailprice", "p_name", "p_partkey").alias("best"))
    return readers.deduplicated_references(p, "doi", "p_name", "best").select("p_partkey", "copies")


@query("t01_stream_concepts")
def t01(spark, d):
    s = incremental.source(spark, f"{d}/embeddings.parquet", 1000)
    return incremental.drained(incremental.concept_upsert(s, "label", "vec_id", "embedding", 0.3))


@query("t05_stream_once", "SELECT DISTINCT user_id, event_type FROM events")
def t05(spark, d):
    s = incremental.source(spark, f"{d}/events.parquet").select("user_id", "event_type")
    return incremental.drained(incremental.once_per_key(s, ["user_id", "event_type"]))


@query("t06_stream_windows")
def t06(spark, d):
    s = incremental.source(spark, f"{d}/events.parquet").select("ts", "event_type")
    return incremental.drained(incremental.windowed_counts(s, "ts", "event_type", "6 hours", "1 hour"))


@query("k01_prepared_splits", f"WITH {LONG_SQL}, s AS (SELECT DISTINCT mode FROM ms), v AS (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY sha256(concat('42:', o_custkey::VARCHAR)) LIMIT 100) SELECT CASE WHEN o_custkey IN (SELECT o_custkey FROM v) THEN 'validation' ELSE 'train' END AS split, ms.mode, count(*) AS n, round(avg(node_recall), 6) AS recall FROM ms JOIN orders ON o_orderkey = o GROUP BY 1, 2")
def k01(spark, d):
    t = scoring.graph_metrics(tasks(spark, d)).select("o", "mode", "node_recall")
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), "o_custkey")
    split = sampling.split_by_source(own, "o_custkey", 100)
    return t.join(split, "o").groupBy("split", "mode").agg(F.count("*").alias("n"), F.round(F.avg("node_recall"), 6).alias("recall"))


@query("k04_benchmark_report", f"WITH {LONG_SQL}, x AS (SELECT ms.*, o_custkey AS src FROM ms JOIN orders ON o_orderkey = o), m AS (SELECT src, mode, avg(edge_f1) AS f, avg(primary_) AS p, count(*) AS c FROM x GROUP BY GROUPING SETS ((src), (src, mode))) SELECT coalesce(mode, 'overall') AS mode, round(avg(f), 6) AS edge_f1, round(avg(p), 6) AS primary_, count(*) AS sources, sum(c)::BIGINT AS rows FROM m GROUP BY mode")
def k04(spark, d):
    m = scoring.graph_metrics(tasks(spark, d)).select("o", "mode", "edge_f1", scoring.primary_score(F.col("mode")).alias("p"))
    x = written(m.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("src")), "o"), "scored")
    a = summarize.overall_and_modes(x, "edge_f1", "src", "mode", MODES).select("mode", F.round("mean", 6).alias("edge_f1"), F.col("n").alias("sources"), "rows")
    b = summarize.overall_and_modes(x, "p", "src", "mode", MODES).select("mode", F.round("mean", 6).alias("primary_"))
    return a.join(b, "mode").select("mode", "edge_f1", "primary_", "sources", "rows")


@query("k05_filter_ladder", "WITH x AS (SELECT doc_id, text, l.toxic, l.quality FROM documents LEFT JOIN labels l USING (doc_id)) SELECT CASE WHEN text IS NULL THEN 'no text' WHEN length(text) < 200 THEN 'short' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' ELSE 'kept' END AS outcome, count(*) AS n FROM x GROUP BY 1")
def k05(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "toxic", "quality"), "doc_id", "left")
    step = F.when(F.col("text").isNull(), "no text").when(F.length("text") < 200, "short").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("kept")
    return x.groupBy(step.alias("outcome")).agg(F.count("*").alias("n"))


@query("k06_growth_replay", f"{E}, n AS (SELECT iter, count(*) AS new_nodes FROM node GROUP BY 1), t AS (SELECT iter, count(*) * 100 AS tokens, max(depth) AS depth FROM edge GROUP BY 1) SELECT t.iter, t.depth, coalesce(new_nodes, 0) AS new_nodes, tokens, (sum(tokens) OVER (ORDER BY t.iter))::BIGINT AS cum_tokens FROM t LEFT JOIN n USING (iter)")
def k06(spark, d):
    e = edges(spark, d)
    n = e.select(F.col("src").alias("id"), "iter").union(e.select("dst", "iter")).groupBy("id").agg(F.min("iter").alias("iter")).groupBy("iter").agg(F.count("*").alias("new_nodes"))
    t = e.groupBy("iter").agg((F.count("*") * 100).alias("tokens"), F.max("depth").alias("depth"))
    return t.join(n, "iter", "left").select("iter", "depth", F.coalesce("new_nodes", F.lit(0)).alias("new_nodes"), "tokens", F.sum("tokens").over(Window.orderBy("iter")).alias("cum_tokens"))  # a row per step


@query("k07_frontier_strategy", f"{E} SELECT id, d AS degree, round(1.0 / (1 + d), 6)::DOUBLE AS priority, concat('Expand on customer ', id) AS question FROM deg ORDER BY d, id LIMIT 10")
def k07(spark, d):
    deg = graph.both(links(spark, d)).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    return deg.orderBy("degree", "id").limit(10).select("id", "degree", F.round(1.0 / (1 + F.col("degree")), 6).alias("priority"), F.concat(F.lit("Expand on customer "), F.col("id").cast("string")).alias("question"))
