"""Queries: aggregations, joins, sampling, projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.catalog.core import MODE_SQL, MODES, PRED_SQL, predictions, query, table
from weft.operators import joins, sampling, summarize

P = f"WITH {PRED_SQL}"


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


@query("a01_macro_mean", f"{P}, s AS (SELECT source_index, avg(value) AS m, count(*) AS c FROM pred GROUP BY 1) SELECT 'source' AS unit, round(avg(m), 6) AS mean, count(*) AS n, sum(c)::BIGINT AS rows FROM s UNION ALL SELECT 'task', round(avg(value), 6), count(*), count(*) FROM pred")
def a01(spark, d):
    p = predictions(spark, d)
    both = [summarize.macro_mean(p, "value", "source_index", unit=u).select(F.lit(u).alias("unit"), r6("mean"), "n", "rows") for u in ("source", "task")]
    return both[0].union(both[1])


@query("a02_overall_and_modes", f"{P}, m AS (SELECT source_index, mode, avg(value) AS m, count(*) AS c FROM pred GROUP BY GROUPING SETS ((source_index), (source_index, mode))) SELECT coalesce(mode, 'overall') AS mode, round(avg(m), 6) AS mean, count(*) AS n, sum(c)::BIGINT AS rows, (1 + coalesce(list_position({MODES}, mode), 0))::INT AS ord FROM m GROUP BY mode")
def a02(spark, d):
    return summarize.overall_and_modes(predictions(spark, d), "value", "source_index", "mode", MODES).select("mode", r6("mean"), "n", "rows", "ord")


@query("a03_bootstrap_ci")
def a03(spark, d):
    return summarize.bootstrap_mean(predictions(spark, d), "value", ["mode"])


_GEN = "count(*) AS n, count(tokens) AS rows_with_tokens, round(avg(tokens), 6) AS mean_tokens, max(tokens) AS max_tokens, count(*) FILTER (WHERE tokens >= 4000) AS at_max, round(count(*) FILTER (WHERE tokens >= 4000) / count(tokens), 6) AS at_max_rate, round(avg(valid::INT), 6) AS valid_rate, count(*) FILTER (WHERE finish = 'stop') AS finish_stop, count(*) FILTER (WHERE finish = 'length') AS finish_length, " + ", ".join(f"round(quantile_cont(tokens::DOUBLE, {q}), 6) AS p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))


@query("a04_generation_summary", f"{P} SELECT mode, {_GEN} FROM pred GROUP BY mode")
def a04(spark, d):
    out = summarize.generation_summary(predictions(spark, d), ["mode"])
    return out.select("mode", "n", "rows_with_tokens", "max_tokens", "at_max", "finish_stop", "finish_length", *[r6(c) for c in ("mean_tokens", "at_max_rate", "valid_rate", "p05", "p25", "p50", "p75", "p95")])


@query("a05_component_metric_means", f"""{P}, n AS (SELECT count(*) AS n FROM pred) SELECT 'component' AS kind, 'format' AS name, round(sum(value) / any_value(n), 6) AS mean, 1.0::DOUBLE AS coverage FROM pred, n
UNION ALL SELECT 'component', 'edge', round(sum(CASE WHEN valid THEN value * 2 END) / any_value(n), 6), 1.0 FROM pred, n
UNION ALL SELECT 'metric', 'tokens', round(avg(tokens), 6), round(count(tokens) / any_value(n), 6) FROM pred, n""")
def a05(spark, d):
    p = predictions(spark, d)
    c = F.map_from_arrays(F.array(F.lit("format"), F.lit("edge")), F.array(F.col("value"), F.when(F.col("valid"), F.col("value") * 2)))
    m = F.when(F.col("tokens").isNotNull(), F.create_map(F.lit("tokens"), F.col("tokens").cast("double")))
    out = summarize.component_and_metric_means(p.select(c.alias("components"), m.alias("metrics")), "components", "metrics")
    return out.select("kind", "name", r6("mean"), r6("coverage"))


@query("a06_integrity", "WITH k AS (SELECT l_orderkey, l_partkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2, 3) SELECT sum(c)::BIGINT AS rows, count(DISTINCT (l_orderkey, l_partkey)) AS tasks, sum(c - 1)::BIGINT AS duplicates FROM k")
def a06(spark, d):
    return summarize.integrity(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber")


@query("a07_invalid_audit", f"{P}, i AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY pos) AS rn FROM pred WHERE NOT valid) SELECT mode, count(*) AS n, string_agg(variant_index, ',' ORDER BY pos) FILTER (WHERE rn <= 3) AS examples FROM i GROUP BY mode")
def a07(spark, d):
    bad = predictions(spark, d).where("NOT valid")
    counts = bad.groupBy("mode").agg(F.count("*").alias("n"))
    shown = sampling.take_ordered(bad, ["mode"], ["pos"], 3).groupBy("mode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "variant_index"))), lambda s: s.variant_index), ",").alias("examples"))
    return counts.join(shown, "mode")


@query("a08_group_summary", "WITH m AS (SELECT c_mktsegment, c_nationkey, count(*) AS c FROM customer GROUP BY 1, 2), t AS (SELECT c_mktsegment, arg_max(c_nationkey, c * 1000 - c_nationkey) AS top FROM m GROUP BY 1) SELECT c_mktsegment, any_value(top) AS top, round(avg(c_acctbal), 4) AS mean, count(*) AS n FROM customer JOIN t USING (c_mktsegment) GROUP BY c_mktsegment")
def a08(spark, d):
    c = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("c"))
    return c.groupBy("c_mktsegment").agg(F.max_by("c_nationkey", F.struct("c", -F.col("c_nationkey"))).alias("top"), F.round(F.sum("s") / F.sum("c"), 4).alias("mean"), F.sum("c").alias("n"))


@query("a09_argmax_layer", "SELECT l_partkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS peak, max(l_extendedprice) FILTER (WHERE l_linenumber BETWEEN 3 AND 5) AS early, round(sum(l_extendedprice), 2) AS total, (arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) BETWEEN 3 AND 5) AS peaks_early FROM lineitem GROUP BY l_partkey")
def a09(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("peak"), F.max(F.when(F.col("l_linenumber").between(3, 5), F.col("l_extendedprice"))).alias("early"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return g.withColumn("peaks_early", F.col("peak").between(3, 5))


@query("a10_argmax_columns", "SELECT l_returnflag, closest, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN l_discount >= l_tax AND l_discount >= l_quantity / 500 THEN 'discount' WHEN l_tax >= l_quantity / 500 THEN 'tax' ELSE 'quantity' END AS closest FROM lineitem) GROUP BY 1, 2")
def a10(spark, d):
    v = F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 500)
    name = F.element_at(F.array(F.lit("discount"), F.lit("tax"), F.lit("quantity")), F.array_position(v, F.array_max(v)).cast("int"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", name.alias("closest")).agg(F.count("*").alias("n"))


@query("a11_mean_std_by_layer", "SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY 1, 2")
def a11(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"))


@query("a12_pivot_diff", "SELECT l_returnflag, l_linenumber, round(coalesce(avg(l_quantity) FILTER (WHERE l_linestatus = 'O') - avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0), 6) AS diff FROM lineitem GROUP BY 1, 2")
def a12(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").pivot("l_linestatus", ["O", "F"]).agg(F.avg("l_quantity"))
    return wide.select("l_returnflag", "l_linenumber", F.round(F.coalesce(F.col("O") - F.col("F"), F.lit(0.0)), 6).alias("diff"))


@query("a13_value_counts", "SELECT event_type, count(*) AS n, min(event_id) AS first_pos FROM events GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 3")
def a13(spark, d):
    return summarize.value_counts(table(spark, d, "events"), "event_type", "event_id", 3)


@query("a14_min_max_median", f"{P} SELECT mode, min(tokens) AS lo, max(tokens) AS hi, quantile_cont(tokens::DOUBLE, 0.5) AS median FROM pred GROUP BY mode")
def a14(spark, d):
    return predictions(spark, d).groupBy("mode").agg(F.min("tokens").alias("lo"), F.max("tokens").alias("hi"), F.percentile("tokens", 0.5).alias("median"))


@query("a15_mean_se", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(o_totalprice) / sqrt(count(*)) ELSE 0 END, 4) AS se, count(*) AS n FROM orders GROUP BY 1")
def a15(spark, d):
    m, s, n = summarize.mean_se(F.col("o_totalprice"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(m, 4).alias("mean"), F.round(s, 4).alias("se"), n.alias("n"))


@query("a16_paired_delta", "WITH x AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1), y AS (SELECT b - a AS d FROM x WHERE a IS NOT NULL AND b IS NOT NULL) SELECT round(avg(d), 4) AS delta, round(stddev_samp(d) / sqrt(count(*)), 4) AS se, count(*) AS n, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d = 0) AS ties, count(*) FILTER (WHERE d < 0) AS losses, CASE WHEN count(*) FILTER (WHERE d > 0) > count(*) FILTER (WHERE d < 0) THEN 'win' WHEN count(*) FILTER (WHERE d > 0) < count(*) FILTER (WHERE d < 0) THEN 'loss' ELSE 'tie' END AS outcome FROM y")
def a16(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("a"), F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("b"))
    out = summarize.paired_delta(x.where("a IS NOT NULL AND b IS NOT NULL"), "a", "b")
    return out.withColumns({"delta": F.round("delta", 4), "se": F.round("se", 4)})


@query("a17_yield", f"{P} SELECT mode, count(*) AS n, count(*) FILTER (WHERE valid) AS passes, round(avg(valid::INT), 6) AS p, round(sqrt(avg(valid::INT) * (1 - avg(valid::INT)) / count(*)), 6) AS se, round(avg(value), 6) AS novelty FROM pred GROUP BY mode")
def a17(spark, d):
    g = predictions(spark, d).groupBy("mode").agg(F.count("*").alias("n"), F.count_if("valid").alias("passes"), F.avg("value").alias("v"))
    p = F.col("passes") / F.col("n")
    return g.select("mode", "n", "passes", F.round(p, 6).alias("p"), F.round(F.sqrt(p * (1 - p) / F.col("n")), 6).alias("se"), F.round("v", 6).alias("novelty"))


@query("a18_benchmark_stats", "WITH g AS (SELECT o_orderstatus AS config, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1) SELECT config, round(mean, 4) AS mean, round(sd, 4) AS sd, lo, hi, round(mean - first_value(mean) OVER (ORDER BY config), 4) AS delta FROM g")
def a18(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("config")).agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    base = g.agg(F.min_by("mean", "config").alias("base"))
    return g.crossJoin(F.broadcast(base)).select("config", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "lo", "hi", F.round(F.col("mean") - F.col("base"), 4).alias("delta"))


@query("a19_judge_means", "SELECT round(avg(nullif(quality, 0)), 6) AS nonzero_mean, round(avg(quality), 6) AS all_mean, round(avg(nullif(toxic, 0)), 6) AS toxic_nonzero, round(avg(toxic), 6) AS toxic_all FROM labels")
def a19(spark, d):
    nz = lambda c: F.round(F.avg(F.nullif(F.col(c), F.lit(0))), 6)
    return table(spark, d, "labels").agg(nz("quality").alias("nonzero_mean"), F.round(F.avg("quality"), 6).alias("all_mean"), nz("toxic").alias("toxic_nonzero"), F.round(F.avg("toxic"), 6).alias("toxic_all"))


@query("a20_checkpoint_table", "SELECT year(o_orderdate)::INT AS step, " + ", ".join(f"round(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 4) AS {s}_mean, count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s}_n" for s in "FOP") + " FROM orders GROUP BY 1")
def a20(spark, d):
    wide = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("step")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))
    return wide.select("step", *[F.coalesce(c, F.lit(0)).alias(c) if c.endswith("_n") else F.col(c) for c in wide.columns if c != "step"])


_TAGGED = "CASE turn % 4 WHEN 0 THEN concat('<think>', text, '</think><answer>', role, '</answer>') WHEN 1 THEN concat('<think>', text) WHEN 2 THEN concat('<answer>', chr(10), text, '</answer>') ELSE text END"


@query("a21_tag_coverage", f"SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(t, '(?s)<think>.*?</think>')) AS with_think, count(*) FILTER (WHERE regexp_matches(t, '(?s)<answer>.*?</answer>')) AS with_answer, round(sum(turn * 0.5), 4)::DOUBLE AS seconds, sum(length(text))::BIGINT AS tokens, count(*) FILTER (WHERE conv_id % 7 = 0) AS errors FROM (SELECT *, {_TAGGED} AS t FROM conversations) GROUP BY role")
def a21(spark, d):
    tagged = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think><answer>"), "role", F.lit("</answer>"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("<think>"), "text")).when(F.col("turn") % 4 == 2, F.concat(F.lit("<answer>\n"), "text", F.lit("</answer>"))).otherwise(F.col("text"))
    c = table(spark, d, "conversations").select("role", tagged.alias("t"), (F.col("turn") * 0.5).alias("seconds"), F.length("text").cast("long").alias("tokens"), F.when(F.col("conv_id") % 7 == 0, "timeout").alias("error"))
    return summarize.tag_coverage(c, ["role"], "t", ["think", "answer"], "seconds", "tokens", "error").withColumn("seconds", F.round("seconds", 4))


@query("a22_births", "WITH o AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, floor(o_totalprice / 100)::BIGINT AS t FROM orders), n AS (SELECT month, count(*) AS nodes FROM (SELECT o_custkey, min(month) AS month FROM o GROUP BY 1) GROUP BY 1), e AS (SELECT month, count(*) AS edges, sum(t)::BIGINT AS tokens FROM o GROUP BY 1) SELECT month, coalesce(nodes, 0) AS nodes, edges, tokens, coalesce(nodes, 0) = 0 AS zero_yield, coalesce(nodes, 0) = 0 AND tokens >= 1000 AS high_token_zero_yield FROM e LEFT JOIN n USING (month)")
def a22(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.floor(F.col("o_totalprice") / 100).alias("t"))
    born = o.groupBy("o_custkey").agg(F.min("month").alias("month"))
    return summarize.births(born, o, o.groupBy("month").agg(F.sum("t").alias("tokens")), "month")


@query("j01_prediction_reference", f"{P} SELECT pred.variant_index, pred.mode, value, count(l_partkey) AS targets FROM pred LEFT JOIN lineitem ON l_orderkey::VARCHAR = variant_index GROUP BY 1, 2, 3")
def j01(spark, d):
    ref = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("variant_index")).agg(F.count("l_partkey").alias("targets"))
    return predictions(spark, d).join(ref, "variant_index", "left").select("variant_index", "mode", "value", F.coalesce("targets", F.lit(0)).alias("targets"))


_REF = "r AS (SELECT o_custkey AS s, o_orderpriority AS v, o_orderstatus AS m, min(o_orderkey) AS payload FROM orders GROUP BY 1, 2, 3), q AS (SELECT o_custkey AS s, o_orderpriority AS v, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS m, o_orderkey AS k FROM orders)"


@query("j02_legacy_fallback", f"WITH {_REF}, u AS (SELECT s, v, count(*) AS n, any_value(payload) AS p FROM r GROUP BY 1, 2) SELECT status, count(*) AS n, sum(payload)::BIGINT AS total FROM (SELECT CASE WHEN r.payload IS NOT NULL THEN 'exact' WHEN q.m IS NULL AND u.n = 1 THEN 'legacy' WHEN q.m IS NULL AND u.n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, coalesce(r.payload, CASE WHEN q.m IS NULL AND u.n = 1 THEN u.p END) AS payload FROM q LEFT JOIN r ON q.s = r.s AND q.v = r.v AND q.m = r.m LEFT JOIN u ON q.s = u.s AND q.v = u.v) GROUP BY status")
def j02(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderpriority").alias("v"), F.col("o_orderstatus").alias("m"), F.col("o_orderkey").alias("payload"))
    ref = o.groupBy("s", "v", "m").agg(F.min("payload").alias("payload"))
    pred = o.select("s", "v", F.when(F.col("payload") % 3 > 0, F.col("m")).alias("m"))
    out = joins.resolve_references(pred, ref, ["s", "v", "m"], ["s", "v"], "payload")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum("payload").alias("total"))


@query("j03_key_differences", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 3) SELECT k, 'missing' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'unexpected' FROM b WHERE k NOT IN (SELECT k FROM a)")
def j03(spark, d):
    x = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "k")
    return joins.key_differences(x.where("l_returnflag = 'R'"), x.where("l_quantity < 3"), ["k"])


@query("j04_leakage", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j04(spark, d):
    o = table(spark, d, "orders")
    return joins.leaked(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), ["o_custkey"])


@query("j05_resume", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j05(spark, d):
    o = table(spark, d, "orders")
    return joins.unfinished(o.select("o_orderkey", "o_custkey"), o.where("o_orderstatus = 'F'"), ["o_orderkey"])


@query("j13_run_difference", "WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) < 1998), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) >= 1998) SELECT 'shared' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'left_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def j13(spark, d):
    x = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    return joins.run_difference(x.where("y < 1998"), x.where("y >= 1998"), ["l_suppkey", "l_partkey"])


@query("j14_cyclic_pairing", "SELECT o_orderkey, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS other FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def j14(spark, d):
    return joins.cyclic_next(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "o_orderkey").select("o_orderkey", "other")


@query("j15_verdict_alignment", "SELECT d.doc_id, coalesce(l.quality, 2) AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j15(spark, d):
    v = table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "documents").select("doc_id").join(v, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(2)).alias("verdict"))


_H = "sha256(concat('42:', {}::VARCHAR))"


@query("l01_hash_order", f"SELECT o_custkey, {_H.format('o_custkey')} AS h FROM (SELECT DISTINCT o_custkey FROM orders)")
def l01(spark, d):
    return table(spark, d, "orders").select("o_custkey").distinct().withColumn("h", sampling.hash_order(F.col("o_custkey")))


@query("l02_source_split", f"WITH v AS (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY {_H.format('o_custkey')} LIMIT 50) SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM v) THEN 'validation' ELSE 'train' END AS split FROM orders")
def l02(spark, d):
    return sampling.split_by_source(table(spark, d, "orders"), "o_custkey", 50).select("o_orderkey", "split")


@query("l03_source_cap", f"SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY {_H.format('o_custkey')} LIMIT 20")
def l03(spark, d):
    return sampling.first_by_hash(table(spark, d, "orders"), "o_custkey", 20)


_KEY = "concat(source_index, ':', variant_index, ':', mode)"


@query("l04_balanced_cap", f"{P}, r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY sha256(concat('42:', {_KEY})), {_KEY}) AS rn FROM pred) SELECT source_index, variant_index, mode FROM r WHERE rn <= 100 + (list_position({MODES}, mode) <= 3)::INT")
def l04(spark, d):
    key = F.concat("source_index", F.lit(":"), "variant_index", F.lit(":"), "mode")
    return sampling.balanced_cap(predictions(spark, d), "mode", key, MODES, 603).select("source_index", "variant_index", "mode")


@query("l05_round_sampling", f"{P}, r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY {_H.format('variant_index')} DESC) AS rn FROM pred) SELECT variant_index, mode, rn AS round FROM r WHERE rn <= 4")
def l05(spark, d):
    w = Window.partitionBy("mode").orderBy(F.desc(sampling.hash_order(F.col("variant_index"))))
    return predictions(spark, d).withColumn("round", F.row_number().over(w).cast("long")).where("round <= 4").select("variant_index", "mode", "round")


@query("l06_top_k", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def l06(spark, d):
    return table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(15).select("c_custkey", "c_name", "c_acctbal")


@query("l09_round_robin_kinds", f"{P}, r AS (SELECT mode, variant_index, row_number() OVER (PARTITION BY mode ORDER BY value DESC, pos) AS rn FROM pred) SELECT mode, variant_index, row_number() OVER (ORDER BY rn, list_position({MODES}, mode)) AS place FROM r QUALIFY place <= 20")
def l09(spark, d):
    own = sampling.take_ordered(predictions(spark, d), ["mode"], [F.desc("value"), "pos"], 20)
    rn = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("value"), "pos"))
    first = own.withColumn("rn", rn).withColumn("o", F.array_position(F.array(*map(F.lit, MODES)), F.col("mode"))).orderBy("rn", "o").limit(20)
    return first.withColumn("place", F.row_number().over(Window.orderBy("rn", "o")).cast("long")).select("mode", "variant_index", "place")


@query("l10_priority_queue", "WITH d AS (SELECT o_custkey AS id, count(*) AS deg, min(o_orderkey) AS seq FROM orders GROUP BY 1) SELECT id, round(1.0 / (1 + deg), 6) AS priority FROM d ORDER BY 1.0 / (1 + deg) DESC, seq LIMIT 10")
def l10(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("deg"), F.min("o_orderkey").alias("seq"))
    return g.orderBy(F.desc(F.lit(1.0) / (1 + F.col("deg"))), "seq").limit(10).select("id", F.round(F.lit(1.0) / (1 + F.col("deg")), 6).alias("priority"))


@query("p01_source_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def p01(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = F.col("o_custkey") == F.col("c_custkey")
    return o.join(c.where("c_mktsegment = 'BUILDING'"), on, "left_semi").join(c.where("c_acctbal < 0"), on, "left_anti").select("o_orderkey")


@query("p02_mode_filter", f"SELECT o_orderkey, {MODE_SQL} AS mode FROM orders WHERE {MODE_SQL} IN ('missing_edges', 'extra_edges')")
def p02(spark, d):
    asked = ["missing_edges", "extra_edges"]
    if unknown := set(asked) - set(MODES):
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    return predictions(spark, d).where(F.col("mode").isin(asked)).select(F.col("pos").alias("o_orderkey"), "mode")


@query("p04_context_gate", "SELECT doc_id, length(left(t, 32000))::BIGINT AS n FROM (SELECT doc_id, regexp_replace(text, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g') AS t FROM documents) WHERE length(t) >= 200".replace("\\\\", "\\"))
def p04(spark, d):
    t = F.regexp_replace("text", r"^[ \t-\r]+|[ \t-\r]+$", "")
    return table(spark, d, "documents").select("doc_id", t.alias("t")).where("length(t) >= 200").select("doc_id", F.length(F.substring("t", 1, 32000)).cast("long").alias("n"))


@query("p12_messages", "SELECT conv_id, count(*) AS n, string_agg(concat(role, ':', length(text)), '|' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id")
def p12(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: F.concat(x.role, F.lit(":"), F.length(x.content).cast("string"))), "|").alias("shape"))


@query("p14_stratified_examples", "WITH b AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'low' WHEN toxic = 1 THEN 'toxic' ELSE 'rest' END AS bucket FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS rn FROM b) SELECT doc_id, bucket FROM r WHERE rn <= CASE bucket WHEN 'rest' THEN 20 ELSE 10 END")
def p14(spark, d):
    b = table(spark, d, "labels").withColumn("bucket", F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("rest"))
    rn = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id"))
    return b.withColumn("rn", rn).where(F.col("rn") <= F.when(F.col("bucket") == "rest", 20).otherwise(10)).select("doc_id", "bucket")


@query("s18_last_by_question", "SELECT l_partkey, arg_max(l_orderkey, l_orderkey * 100 + l_linenumber) AS l_orderkey, max(l_orderkey * 100 + l_linenumber) AS pos FROM lineitem GROUP BY l_partkey")
def s18(spark, d):
    x = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))
    return sampling.last_by_key(x, ["l_partkey"], "pos")


@query("u04_ordered_distinct", "SELECT string_agg(event_type, ',' ORDER BY first_pos) AS types FROM (SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY 1)")
def u04(spark, d):
    v = summarize.value_counts(table(spark, d, "events"), "event_type", "event_id")
    return v.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "event_type"))), lambda s: s.event_type), ",").alias("types"))


@query("u03_union_sources", "SELECT src, count(*) AS n FROM (SELECT 'documents' AS src FROM documents UNION ALL SELECT 'benchmark' FROM benchmark UNION ALL SELECT 'conversations' FROM conversations) GROUP BY 1")
def u03(spark, d):
    parts = [table(spark, d, t).select(F.lit(t).alias("src"), "text") for t in ("documents", "benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("src").agg(F.count("*").alias("n"))
