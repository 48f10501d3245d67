"""Queries: series, embeddings, null models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.catalog.core import EDGE_SQL, SQL, edges, query, table
from weft.functions import measures
from weft.operators import embedding, graph, series

#: Growth series: events a day and type.
DAY_SQL = "day AS (SELECT event_type AS run, (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::INT AS step, count(*) AS n, sum(value) AS v, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2)"
D = f"WITH {DAY_SQL}"


def days(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("step"), "user_id", "value")
    return e.groupBy("run", "step", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v")).groupBy("run", "step").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.count("*").alias("users"))


@query("w01_rolling_mean", f"{D} SELECT run, step, round(avg(n) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS rolling FROM day")
def w01(spark, d):
    return series.rolling_mean(days(spark, d), ["run"], "step", "n", 6).select("run", "step", F.round("rolling", 6).alias("rolling"))


@query("w02_smoothed", f"WITH RECURSIVE {DAY_SQL}, o AS (SELECT run, step, n, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM day), r(run, i, y) AS (SELECT run, 1, n::DOUBLE FROM o WHERE i = 1 UNION ALL SELECT r.run, r.i + 1, 0.8::DOUBLE * y + 0.2::DOUBLE * n FROM r JOIN o ON o.run = r.run AND o.i = r.i + 1) SELECT run, step, round(y, 6) AS ema FROM r JOIN o USING (run, i)")
def w02(spark, d):
    s = series.smoothed(days(spark, d), ["run"], "step", "n", 9)
    return s.select("run", F.explode(F.arrays_zip("steps", "ema")).alias("z")).select("run", F.col("z.steps").alias("step"), F.round("z.ema", 6).alias("ema"))


@query("w03_step_bins", f"{D} SELECT run, floor((greatest(step, 1) - 1) / 7)::BIGINT AS bin, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS std, count(*) AS n, round(coalesce(stddev_samp(n), 0) / sqrt(count(*)), 6) AS sem, ((floor((greatest(step, 1) - 1) / 7) + 1) * 7)::BIGINT AS x FROM day GROUP BY run, floor((greatest(step, 1) - 1) / 7)")
def w03(spark, d):
    return series.step_bins(days(spark, d), ["run"], "step", "n", 7).select("run", "bin", *[F.round(c, 6).alias(c) for c in ("mean", "std", "sem")], "n", "x")


@query("w04_wide_bins", f"{D} SELECT floor((step - 1) / 7)::BIGINT AS bin, " + ", ".join(f"round(avg(n) FILTER (WHERE run = '{r}'), 6) AS {r}" for r in ("click", "error", "view")) + " FROM day GROUP BY 1")
def w04(spark, d):
    b = series.step_bins(days(spark, d), ["run"], "step", "n", 7)
    return b.groupBy("bin").pivot("run", ["click", "error", "view"]).agg(F.round(F.first("mean"), 6))


@query("w05_first_last", f"{D}, e AS (SELECT run, min(step) AS lo, max(step) AS hi FROM day GROUP BY 1), x AS (SELECT run, avg(n) FILTER (WHERE step < lo + 10) AS f, avg(n) FILTER (WHERE step > hi - 10) AS l FROM day JOIN e USING (run) GROUP BY 1) SELECT run, round(f, 6) AS first, round(l, 6) AS last, round(l - f, 6) AS change, round(100 * (l - f) / abs(f), 6) AS percent FROM x")
def w05(spark, d):
    return series.first_last(days(spark, d), ["run"], "step", "n", 10).select("run", *[F.round(c, 6).alias(c) for c in ("first", "last", "change", "percent")])


@query("w06_decomposition", f"{D}, e AS (SELECT run, avg(n) FILTER (WHERE step <= 10) AS f, avg(n) FILTER (WHERE step > 20) AS l FROM day GROUP BY 1), w AS (SELECT run, (l - f) * length(run) / 10.0 AS part FROM e) SELECT run, round(part, 6) AS part, round(part / sum(part) OVER (), 6) AS share FROM w")
def w06(spark, d):
    e = days(spark, d).groupBy("run").agg(F.avg(F.when(F.col("step") <= 10, F.col("n"))).alias("f"), F.avg(F.when(F.col("step") > 20, F.col("n"))).alias("l"))
    w = e.select("run", ((F.col("l") - F.col("f")) * F.length("run") / 10).alias("part"))
    return w.crossJoin(F.broadcast(w.agg(F.sum("part").alias("total")))).select("run", F.round("part", 6).alias("part"), F.round(F.col("part") / F.col("total"), 6).alias("share"))


@query("w07_splice", f"{D}, a AS (SELECT max(step) AS hi FROM day WHERE run = 'click'), b AS (SELECT min(step) AS lo FROM day WHERE run = 'view') SELECT CASE WHEN run = 'view' AND NOT (0 < lo AND lo <= hi + greatest(10, 0.05 * hi)) THEN step + hi ELSE step END::INT AS x, run, n FROM day, a, b WHERE run IN ('click', 'view')")
def w07(spark, d):
    x = days(spark, d).where("run IN ('click', 'view')")
    ends = x.agg(F.max(F.when(F.col("run") == "click", F.col("step"))).alias("hi"), F.min(F.when(F.col("run") == "view", F.col("step"))).alias("lo"))
    absolute = (F.col("lo") > 0) & (F.col("lo") <= F.col("hi") + F.greatest(F.lit(10.0), 0.05 * F.col("hi")))
    return x.crossJoin(F.broadcast(ends)).select(F.when((F.col("run") == "view") & ~absolute, F.col("step") + F.col("hi")).otherwise(F.col("step")).cast("int").alias("x"), "run", "n")


@query("w08_normalized_x", f"{D} SELECT run, step, round((step - min(step) OVER w) / (max(step) OVER w - min(step) OVER w), 6) AS x FROM day WINDOW w AS (PARTITION BY run)")
def w08(spark, d):
    w = Window.partitionBy("run")
    lo, hi = F.min("step").over(w), F.max("step").over(w)
    return days(spark, d).select("run", "step", F.round(F.when(hi > lo, (F.col("step") - lo) / F.nullif(hi - lo, F.lit(0))).otherwise(0.0), 6).alias("x"))


@query("w09_percentile_rank", f"{D} SELECT run, step, round(row_number() OVER (PARTITION BY run ORDER BY n, step) / count(*) OVER (PARTITION BY run), 6) AS rank FROM day")
def w09(spark, d):
    return series.percentile_rank(days(spark, d), ["run"], ["n", "step"]).select("run", "step", F.round("rank", 6).alias("rank"))


@query("w10_actionability", f"{D}, r AS (SELECT run, step, n, users, row_number() OVER (PARTITION BY run ORDER BY n, step) / count(*) OVER (PARTITION BY run) AS nov, row_number() OVER (PARTITION BY run ORDER BY users, step) / count(*) OVER (PARTITION BY run) AS sal, row_number() OVER (PARTITION BY run ORDER BY n DESC, step) AS k, count(*) OVER (PARTITION BY run) AS m FROM day) SELECT run, step, round(0.45 * nov + 0.30 * sal + 0.25 * (1 - k / m), 4) AS score FROM r")
def w10(spark, d):
    w = Window.partitionBy("run")
    m = F.count("*").over(w)
    rank = lambda *o: F.row_number().over(w.orderBy(*o))
    score = 0.45 * rank("n", "step") / m + 0.30 * rank("users", "step") / m + 0.25 * (1 - rank(F.desc("n"), "step") / m)
    return days(spark, d).select("run", "step", F.round(score, 4).alias("score"))


@query("w11_cumulative", f"WITH {EDGE_SQL}, n AS (SELECT iter, count(*) AS c FROM node GROUP BY 1), e AS (SELECT iter, count(*) AS c FROM simple GROUP BY 1), s AS (SELECT unnest(range(1, (SELECT max(iter) FROM edge) + 1)) AS iter) SELECT iter, sum(coalesce(n.c, 0)) OVER w::BIGINT AS nodes, sum(coalesce(e.c, 0)) OVER w::BIGINT AS edges, round(2 * sum(coalesce(e.c, 0)) OVER w / sum(coalesce(n.c, 0)) OVER w, 6) AS avg_degree FROM s LEFT JOIN n USING (iter) LEFT JOIN e USING (iter) WINDOW w AS (ORDER BY iter)".replace("OVER w::BIGINT", "OVER w").replace("sum(coalesce(n.c, 0)) OVER w AS nodes", "(sum(coalesce(n.c, 0)) OVER w)::BIGINT AS nodes").replace("sum(coalesce(e.c, 0)) OVER w AS edges", "(sum(coalesce(e.c, 0)) OVER w)::BIGINT AS edges"))
def w11(spark, d):
    e = edges(spark, d)
    n = e.select(F.col("src").alias("id"), "iter").union(e.select("dst", "iter")).groupBy("id").agg(F.min("iter").alias("iter")).groupBy("iter").agg(F.count("*").alias("nodes"))
    m = graph.fold(e).groupBy("iter").agg(F.count("*").alias("edges"))
    spine = e.agg(F.max("iter").alias("hi")).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("hi"))).alias("iter"))
    return series.cumulative(n.join(m, "iter", "full_outer"), "iter", spine).withColumn("avg_degree", F.round("avg_degree", 6))


@query("w13_trajectory", f"{D} SELECT step, round(avg(n), 6) AS mean, round(stddev_pop(n) / greatest(1, sqrt(count(*))), 6) AS se FROM day GROUP BY 1")
def w13(spark, d):
    return days(spark, d).groupBy("step").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n") / F.greatest(F.lit(1.0), F.sqrt(F.count("*"))), 6).alias("se"))


@query("w14_arrival_novelty", "WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT *, sum(x) OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM e) SELECT label, vec_id, round(1 - sum(x * c) / sqrt(sum(x * x) * sum(c * c)), 5) AS novelty FROM c GROUP BY 1, 2")
def w14(spark, d):
    return embedding.arrival_novelty(table(spark, d, "embeddings"), "label", "vec_id", "embedding").withColumn("novelty", F.round("novelty", 5))


@query("w15_novel_counts", f"WITH a AS ({SQL['w14_arrival_novelty']}), m AS (SELECT quantile_cont(novelty, 0.5) AS med FROM a WHERE novelty IS NOT NULL) SELECT vec_id // 25 AS bin, count(*) FILTER (WHERE novelty >= med) AS novel, count(*) FILTER (WHERE novelty < med) AS consolidating FROM a, m WHERE novelty IS NOT NULL GROUP BY 1")
def w15(spark, d):
    x = w14(spark, d).where("novelty IS NOT NULL")
    # the median of all arrivals, one row
    median = x.agg(F.percentile("novelty", 0.5).alias("med"))
    return x.crossJoin(F.broadcast(median)).groupBy(F.floor(F.col("vec_id") / 25).alias("bin")).agg(F.count_if(F.col("novelty") >= F.col("med")).alias("novel"), F.count_if(F.col("novelty") < F.col("med")).alias("consolidating"))


@query("w16_radius", "WITH s AS (SELECT label, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY 1), r AS (SELECT label, 1 - list_dot_product(embedding::DOUBLE[], c::DOUBLE[]) AS d FROM embeddings JOIN s USING (label)) SELECT label, round(avg(d), 5) AS mean, round(quantile_cont(d, 0.25), 5) AS p25, round(quantile_cont(d, 0.75), 5) AS p75 FROM r GROUP BY 1")
def w16(spark, d):
    e = table(spark, d, "embeddings")
    seed = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    r = e.join(F.broadcast(seed), "label").select("label", (1 - measures.dot(F.col("embedding"), F.col("c"))).alias("d"))  # a row per label
    return r.groupBy("label").agg(F.round(F.avg("d"), 5).alias("mean"), F.round(F.percentile("d", 0.25), 5).alias("p25"), F.round(F.percentile("d", 0.75), 5).alias("p75"))


@query("w18_late_bloomers", f"WITH {EDGE_SQL}, h AS (SELECT max(iter) / 2 AS h FROM edge), x AS (SELECT id, count(*) AS total, count(*) FILTER (WHERE iter > h) AS late FROM (SELECT src AS id, iter FROM simple UNION ALL SELECT dst, iter FROM simple), h GROUP BY id), m AS (SELECT greatest(2, quantile_cont(total::DOUBLE, 0.5)) AS floor_ FROM x) SELECT id, total, round(late / total, 6) AS share FROM x, m WHERE total >= floor_ ORDER BY late / total DESC, id LIMIT 25")
def w18(spark, d):
    s = graph.fold(edges(spark, d))
    mid = edges(spark, d).agg((F.max("iter") / 2).alias("h"))
    ends = s.select(F.col("src").alias("id"), "iter").union(s.select("dst", "iter")).crossJoin(F.broadcast(mid))
    x = ends.groupBy("id").agg(F.count("*").alias("total"), F.count_if(F.col("iter") > F.col("h")).alias("late"))
    m = x.agg(F.greatest(F.lit(2.0), F.percentile("total", 0.5)).alias("floor_"))
    return x.crossJoin(F.broadcast(m)).where("total >= floor_").orderBy(F.desc(F.col("late") / F.col("total")), "id").limit(25).select("id", "total", F.round(F.col("late") / F.col("total"), 6).alias("share"))


@query("w20_interpolation", f"{D}, q AS (SELECT DISTINCT run, step + 0.5 AS step FROM day WHERE step % 3 = 0), b AS (SELECT q.run, q.step, max(d.step) FILTER (WHERE d.step <= q.step) AS lo, min(d.step) FILTER (WHERE d.step >= q.step) AS hi FROM q JOIN day d ON d.run = q.run GROUP BY 1, 2) SELECT b.run, b.step::DOUBLE AS step, round(CASE WHEN hi IS NULL THEN l.n WHEN lo IS NULL THEN h.n ELSE l.n + (h.n - l.n) * (b.step - lo) / (hi - lo) END, 6)::DOUBLE AS n FROM b LEFT JOIN day l ON l.run = b.run AND l.step = lo LEFT JOIN day h ON h.run = b.run AND h.step = hi")
def w20(spark, d):
    x = days(spark, d).select("run", F.col("step").cast("double").alias("step"), F.col("n").cast("double").alias("n"))
    at = x.where(F.col("step") % 3 == 0).select("run", (F.col("step") + 0.5).alias("step"))
    return series.interpolate(x, at, ["run"], "step", "n").withColumn("n", F.round("n", 6))


@query("w21_epochs", f"WITH {EDGE_SQL}, q AS (SELECT quantile_cont(iter::DOUBLE, 0.25) AS a, quantile_cont(iter::DOUBLE, 0.75) AS b FROM edge) SELECT CASE WHEN iter <= a THEN 'early' WHEN iter <= b THEN 'middle' ELSE 'late' END AS epoch, relation, count(*) AS n FROM edge, q GROUP BY 1, 2")
def w21(spark, d):
    e = edges(spark, d)
    q = e.agg(F.percentile("iter", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    epoch = F.when(F.col("iter") <= F.col("q")[0], "early").when(F.col("iter") <= F.col("q")[1], "middle").otherwise("late")
    return e.crossJoin(F.broadcast(q)).groupBy(epoch.alias("epoch"), "relation").agg(F.count("*").alias("n"))


@query("w22_progress", f"{D} SELECT run, round(least(1.0, greatest(sum(n) / 1500.0, count(*) / 40.0, max(users) / 60.0)), 6) AS progress FROM day GROUP BY 1")
def w22(spark, d):
    return days(spark, d).groupBy("run").agg(F.round(F.least(F.lit(1.0), F.greatest(F.sum("n") / 1500, F.count("*") / 40, F.max("users") / 60)), 6).alias("progress"))


@query("t03_early_stop", f"{D}, s AS (SELECT run, step, sum(users) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM day) SELECT run, min(step) FILTER (WHERE i >= 5 AND s < 5 * 45) AS stop_at, count(*) AS steps FROM s GROUP BY 1")
def t03(spark, d):
    return series.stop_index(days(spark, d), ["run"], "step", "users", 5, 45)


@query("t04_budget_stop", f"{D}, c AS (SELECT run, step, sum(n) OVER w AS calls, sum(v) OVER w AS cost FROM day WINDOW w AS (PARTITION BY run ORDER BY step)) SELECT run, min(step) AS step, arg_min(CASE WHEN calls >= 900 THEN 'calls' ELSE 'cost' END, step) AS reason FROM c WHERE calls >= 900 OR cost >= 9000 GROUP BY run")
def t04(spark, d):
    w = Window.partitionBy("run").orderBy("step")
    c = days(spark, d).select("run", "step", F.sum("n").over(w).alias("calls"), F.sum("v").over(w).alias("cost")).where("calls >= 900 OR cost >= 9000")
    return c.groupBy("run").agg(F.min_by(F.when(F.col("calls") >= 900, "calls").otherwise("cost"), "step").alias("reason"), F.min("step").alias("step"))


@query("v01_unit_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) ** 2))) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) ** 2))), 1e-9), 6) AS length FROM embeddings")
def v01(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return table(spark, d, "embeddings").select("vec_id", F.round(measures.norm(measures.unit(scaled)), 6).alias("length"))


_EX = "e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query("v02_spread", f"WITH {_EX}, m AS (SELECT label, i, count(*) AS n, sum(x) AS s, sum(x * x) AS q, var_samp(x) AS vs, var_pop(x) AS vp FROM e GROUP BY 1, 2) SELECT label, max(n) AS n, round(1 - (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 6) AS mean_distance, round(sum(vs), 6) AS spread_sample, round(sum(vp), 6) AS spread_population FROM m GROUP BY label")
def v02(spark, d):
    return embedding.spread(table(spark, d, "embeddings"), ["label"], "embedding").select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean_distance", "spread_sample", "spread_population")])


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("ord"), F.col("embedding").alias("v"))


@query("j10_novelty_at_birth", "SELECT a.vec_id AS id, round(1 - max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS novelty FROM embeddings a JOIN embeddings b ON b.label < a.label GROUP BY 1")
def j10(spark, d):
    v = vectors(spark, d)
    return embedding.best_matches(v, v, lambda a, b: b < a).select("id", F.round(1 - F.col("similarity"), 6).alias("novelty"))


@query("j11_similarity_join", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def j11(spark, d):
    return embedding.pairs_above(vectors(spark, d), 0.3).withColumn("similarity", F.round("similarity", 6))


@query("j12_nearest", "SELECT a.vec_id AS id, arg_max(b.vec_id, (list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), -b.vec_id)) AS best FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1 HAVING max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) >= 0.25")
def j12(spark, d):
    v = vectors(spark, d)
    return embedding.best_matches(v, v, lambda a, b: (a == a) & (b == b)).where("similarity >= 0.25").select("id", "best")


@query("v04_novelty_vs_seed", "WITH s AS (SELECT arg_min(embedding, vec_id) AS c FROM embeddings) SELECT vec_id, round(1 - list_dot_product(embedding::DOUBLE[], c::DOUBLE[]), 6) AS novelty FROM embeddings, s")
def v04(spark, d):
    e = table(spark, d, "embeddings")
    seed = e.agg(F.min_by("embedding", "vec_id").alias("c"))
    return e.crossJoin(F.broadcast(seed)).select("vec_id", F.round(1 - measures.dot(F.col("embedding"), F.col("c")), 6).alias("novelty"))


@query("v05_sequential_dedup")
def v05(spark, d):
    return embedding.sequential_dedup(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.3)


@query("v06_exclusive_fraction", "WITH m AS (SELECT a.vec_id, a.label, max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label <> b.label GROUP BY 1, 2) SELECT label, round(avg((s < 0.3)::INT), 6) AS exclusive FROM m GROUP BY 1")
def v06(spark, d):
    v = vectors(spark, d)
    m = embedding.best_matches(v, v, lambda a, b: a != b)
    return m.join(v, "id").groupBy(F.col("ord").cast("int").alias("label")).agg(F.round(F.avg((F.col("similarity") < 0.3).cast("int")), 6).alias("exclusive"))


@query("v09_principal_variance")
def v09(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(v)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.explainedVariance)], "component int, explained double")


@query("v11_flexibility")
def v11(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    k = max(2, int(v.count() ** 0.5))
    return KMeans(k=k, seed=0).fit(v).transform(v).agg(F.count_distinct("prediction").alias("clusters"))


@query("n05_pair_mean", f"WITH {_EX}, s AS (SELECT i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM e GROUP BY 1) SELECT round((sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 8) AS mean FROM s")
def n05(spark, d):
    m = embedding.moments(table(spark, d, "embeddings"), [], "embedding")
    return m.agg(F.round((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (F.max("n") * (F.max("n") - 1)), 8).alias("mean"))


@query("n03_heterophily")
def n03(spark, d):
    from weft.catalog.extra import vectors_of_nodes

    return heterophily(vectors_of_nodes(spark, d), graph.links(edges(spark, d)).select("u", "v"), 500)


def heterophily(v, e, seeds):
    """Mean cosine of linked pairs ``e`` (u, v) against vectors ``v`` (id, v) permuted over the nodes."""
    own = v.select("id")
    e = e.join(own.withColumnRenamed("id", "u"), "u", "left_semi").join(own.withColumnRenamed("id", "v"), "v", "left_semi").select("u", F.col("v").alias("w"))
    given = v.select("id", F.transform("v", lambda x: x.cast("float")).alias("v")).unionByName(e, allowMissingColumns=True)

    def prepare(table):
        ids, x = [], []
        for part in table.select(["id", "v"]).to_batches():
            part = part.filter(part.column("id").is_valid())
            if len(part):
                ids.append(part.column("id").to_numpy())
                x.append(part.column("v").flatten().to_numpy().reshape(len(part), -1))
        linked = table.select(["u", "w"]).drop_null()
        ids, x = np.concatenate(ids or [[]]), np.concatenate(x or [np.zeros((0, 1), np.float32)])
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        i, j = (np.searchsorted(ids, linked.column(c).to_numpy()).astype(np.int32) for c in ("u", "w"))
        order = np.argsort(i * np.int64(len(ids)) + j)
        return x, i[order], j[order]

    def cosine(given, rng):
        x, i, j = given
        if not len(i):
            return None
        x = x if rng is None else x[rng.permutation(len(x))]
        return sum(float(np.einsum("kd,kd->k", x[i[k : k + 4096]], x[j[k : k + 4096]]).sum(dtype=float)) for k in range(0, len(i), 4096)) / len(i)

    return embedding.permutation_z(given, prepare, cosine, seeds, two_sided=True)


@query("n07_rank_sum", "WITH c AS (SELECT o_totalprice AS v, o_orderstatus = 'F' AS g FROM orders), r AS (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY v) AS t FROM c), s AS (SELECT sum(r) FILTER (WHERE g) AS ranks, count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n2, sum(t * t - 1.0) AS ties FROM r) SELECT n1, n2, (ranks - n1 * (n1 + 1) / 2)::DOUBLE AS u, round((ranks - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s")
def n07(spark, d):
    o = table(spark, d, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").alias("g"))
    return embedding.rank_sum(o, "g", "o_totalprice").withColumn("z", F.round("z", 6))


@query("n01_empirical_p", "WITH o AS (SELECT avg(o_totalprice) AS m FROM orders), g AS (SELECT o_orderpriority, avg(o_totalprice) AS x FROM orders GROUP BY 1) SELECT round((1 + count(*) FILTER (WHERE x >= m)) / (1 + count(*)), 6) AS p FROM g, o")
def n01(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("x"), F.sum("o_totalprice").alias("s"), F.count("*").alias("c"))
    m = g.agg((F.sum("s") / F.sum("c")).alias("m"))
    return g.crossJoin(F.broadcast(m)).agg(F.round((1 + F.count_if(F.col("x") >= F.col("m"))) / (1 + F.count("*")), 6).alias("p"))
