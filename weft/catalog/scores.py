"""Queries: graph metrics, rewards, text functions and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog.core import MODE_SQL, MODES, query, sessions, table
from weft.functions import measures, text
from weft.operators import kernels, scoring

#: Completion tasks in long form: an order's lines give edges part -> supplier; lines are dropped, changed and kept by number.
LONG_SQL = f"""ln AS (SELECT l_orderkey AS o, l_linenumber AS n, l_quantity AS q, 'p' || l_partkey AS p, 's' || l_suppkey AS s, l_returnflag AS g, CASE WHEN l_linenumber % 5 = 0 THEN 'X' ELSE l_returnflag END AS r FROM lineitem),
ev AS (SELECT o, 'n' AS kind, p AS k, 'q' || q AS pl, true AS g, n % 4 <> 0 AS p_, n <= 3 AS x, n = 1 AS f FROM ln UNION ALL SELECT o, 'n', s, 's', true, n % 4 <> 0, n <= 3, false FROM ln
 UNION ALL SELECT o, 'e', concat(p, chr(9), g, chr(9), s), 'q' || q, true, n % 4 <> 0 AND n % 5 <> 0, n <= 2, n = 1 AND g = 'A' FROM ln UNION ALL SELECT o, 'e', concat(p, chr(9), 'X', chr(9), s), 'x', false, n % 5 = 0 AND n % 4 <> 0, n = 3, false FROM ln),
kk AS (SELECT o, kind, k, split_part(k, chr(9), 1) || chr(9) || split_part(k, chr(9), 3) AS ends, max(pl) FILTER (WHERE g) AS g, max(pl) FILTER (WHERE p_) AS p, max(pl) FILTER (WHERE x) AS x, bool_or(f) AS f FROM ev GROUP BY 1, 2, 3 HAVING bool_or(g) OR bool_or(p_) OR bool_or(x)),
ke AS (SELECT *, kind = 'e' AND bool_or(g IS NOT NULL) OVER w AS eg, kind = 'e' AND bool_or(x IS NOT NULL) OVER w AS ex FROM kk WINDOW w AS (PARTITION BY o, kind, ends)),
ct AS (SELECT o, {", ".join(f"count(*) FILTER (WHERE {c})::DOUBLE AS {n}" for n, c in {
    "gn": "kind='n' AND g IS NOT NULL", "pn": "kind='n' AND p IS NOT NULL", "mn": "kind='n' AND g IS NOT NULL AND p IS NOT NULL", "ge": "kind='e' AND g IS NOT NULL", "pe": "kind='e' AND p IS NOT NULL", "me": "kind='e' AND g IS NOT NULL AND p IS NOT NULL",
    "cmp": "p IS NOT NULL AND eg", "an": "kind='n' AND g IS NOT NULL AND x IS NULL", "anp": "kind='n' AND g IS NOT NULL AND x IS NULL AND p IS NOT NULL", "ae": "kind='e' AND g IS NOT NULL AND x IS NULL", "aep": "kind='e' AND g IS NOT NULL AND x IS NULL AND p IS NOT NULL",
    "re": "kind='e' AND x IS NOT NULL AND g IS NULL", "rep": "kind='e' AND x IS NOT NULL AND g IS NULL AND p IS NULL", "rr": "kind='e' AND g IS NOT NULL AND x IS NULL AND ex", "rrp": "kind='e' AND g IS NOT NULL AND x IS NULL AND ex AND p IS NOT NULL", "wr": "kind='e' AND x IS NOT NULL AND g IS NULL AND eg", "wrp": "kind='e' AND x IS NOT NULL AND g IS NULL AND eg AND p IS NULL",
    "fn": "kind='n' AND f", "fnp": "kind='n' AND f AND p IS NOT NULL", "fnx": "kind='n' AND f AND p = x", "fe": "kind='e' AND f", "fep": "kind='e' AND f AND p IS NOT NULL", "fex": "kind='e' AND f AND p = x", "xg": "g = p", "xn": "x IS NOT NULL", "xp": "x = p",
}.items())} FROM ke GROUP BY o),
mt AS (SELECT o, {MODE_SQL.replace("o_orderkey", "o")} AS mode, CASE WHEN pn + gn = 0 THEN 1 WHEN pn = 0 THEN 0 ELSE mn / pn END AS node_precision, CASE WHEN gn = 0 THEN 1 ELSE mn / gn END AS node_recall,
 CASE WHEN pe + ge = 0 THEN 1 WHEN pe = 0 THEN 0 ELSE me / pe END AS edge_precision, CASE WHEN ge = 0 THEN 1 ELSE me / ge END AS edge_recall, CASE WHEN cmp = 0 THEN 0 ELSE me / cmp END AS relation_accuracy,
 CASE WHEN rr = 0 THEN 1 ELSE rrp / rr END AS relation_repair_recall, CASE WHEN wr = 0 THEN 1 ELSE wrp / wr END AS wrong_relation_removal_rate, CASE WHEN an = 0 THEN 1 ELSE anp / an END AS node_add_recall, CASE WHEN ae = 0 THEN 1 ELSE aep / ae END AS edge_add_recall,
 CASE WHEN an + ae = 0 THEN 1 ELSE (anp + aep) / (an + ae) END AS addition_recall, CASE WHEN re = 0 THEN 1 ELSE rep / re END AS removal_rate, CASE WHEN fn = 0 THEN 1 ELSE fnp / fn END AS fixed_node_preservation, CASE WHEN fe = 0 THEN 1 ELSE fep / fe END AS fixed_edge_preservation,
 least(CASE WHEN fn = 0 THEN 1 ELSE fnx / fn END, CASE WHEN fe = 0 THEN 1 ELSE fex / fe END) AS fixed_object_exact, pn - mn AS spurious_nodes, pe - me AS spurious_edges, CASE WHEN pn + pe = 0 THEN 0 ELSE xg / (pn + pe) END AS payload_precision,
 (xg = gn + ge AND pn + pe = gn + ge)::INT::DOUBLE AS same_as_target, (xp = xn AND pn + pe = xn)::INT::DOUBLE AS no_edit_match, gn + ge AS target_size FROM ct),
mf AS (SELECT *, CASE WHEN node_precision + node_recall = 0 THEN 0 ELSE 2 * node_precision * node_recall / (node_precision + node_recall) END AS node_f1, CASE WHEN edge_precision + edge_recall = 0 THEN 0 ELSE 2 * edge_precision * edge_recall / (edge_precision + edge_recall) END AS edge_f1 FROM mt),
ms AS (SELECT *, CASE mode {" ".join(f"WHEN '{m}' THEN {' + '.join(f'{w} * {c}' for c, w in parts.items())}" for m, parts in scoring.PRIMARY.items())} END AS primary_ FROM mf)"""

METRICS = ["node_precision", "node_recall", "node_f1", "edge_precision", "edge_recall", "edge_f1", "relation_accuracy", "relation_repair_recall", "wrong_relation_removal_rate", "node_add_recall", "edge_add_recall", "addition_recall", "removal_rate", "fixed_node_preservation", "fixed_edge_preservation", "fixed_object_exact", "spurious_nodes", "spurious_edges", "payload_precision", "same_as_target", "no_edit_match"]


#: Lines of a partition of ``tasks`` at most, so that they are sorted in memory.
TASK_LINES = 500_000


def tasks(spark, d):
    """One row per order with the maps that LONG_SQL describes in long form.

    Lines travel once, as they are, by their order, and are grouped where they stand: no row is made for what a line gives.
    """
    lines = table(spark, d, "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, lines.count() // TASK_LINES + 1)
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_returnflag").repartition(parts, "l_orderkey")
    ln = lines.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.concat(F.lit("q"), F.col("l_quantity").cast("string")).alias("q"), F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"), F.col("l_returnflag").alias("g"))
    key = lambda r: F.concat("p", F.lit("\t"), r, F.lit("\t"), "s")
    # an order's lines in one list, with the keys that they give; what they give is made and merged inside the row
    line = F.struct("n", "q", "g", "p", "s", key(F.col("g")).alias("own"), key(F.lit("X")).alias("other"))
    e = ln.groupBy("o").agg(F.collect_list(line).alias("e"))
    entry = lambda k, pl: F.struct(k.alias("k"), pl.alias("pl"))
    of = lambda when, k, pl: F.transform(F.filter("e", when) if when else F.col("e"), lambda s: entry(s[k], s.q if pl is None else F.lit(pl)))

    made = lambda *parts: F.sort_array(F.concat(*parts))
    kept, started = lambda s: s.n % 4 != 0, lambda s: s.n <= 3
    nodes = lambda when: made(of(when, "p", None), of(when, "s", "s"))
    e = e.withColumns(
        {
            "gn": nodes(None),
            "ge": made(of(None, "own", None)),
            "pn": nodes(kept),
            "pe": made(of(lambda s: kept(s) & (s.n % 5 != 0), "own", None), of(lambda s: kept(s) & (s.n % 5 == 0), "other", "x")),
            "xn": nodes(started),
            "xe": made(of(lambda s: s.n <= 2, "own", None), of(lambda s: s.n == 3, "other", "x")),
            "fixed_nodes": F.array_distinct(F.transform(F.filter("e", lambda s: s.n == 1), lambda s: s.p)),
            "fixed_edges": F.array_distinct(F.transform(F.filter("e", lambda s: (s.n == 1) & (s.g == "A")), lambda s: s.own)),
        }
    )
    # the highest payload of a key is the last of its entries in order
    merged = lambda c: F.map_from_entries(F.filter(c, lambda s, i: ~F.get(F.col(c), i + 1).k.eqNullSafe(s.k))).alias(c)
    graph = [merged(c) for c in ("gn", "ge", "pn", "pe", "xn", "xe")]
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("o") % 6 + 1).cast("int"))
    return e.select("o", mode.alias("mode"), *graph, "fixed_nodes", "fixed_edges")


@query("r02_graph_metrics", f"WITH {LONG_SQL} SELECT o, {', '.join(f'round({m}, 8) AS {m}' for m in METRICS)} FROM mf")
def r02(spark, d):
    return scoring.graph_metrics(tasks(spark, d)).select("o", *[F.round(m, 8).alias(m) for m in METRICS])


@query("r07_mode_primary", f"WITH {LONG_SQL} SELECT mode, count(*) AS n, round(avg(primary_), 6) AS primary_ FROM ms GROUP BY mode")
def r07(spark, d):
    m = scoring.graph_metrics(tasks(spark, d))
    return m.withColumn("s", scoring.primary_score(F.col("mode"))).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("primary_"))


@query("r08_no_edit_baseline", f"WITH {LONG_SQL.replace('max(pl) FILTER (WHERE p_) AS p', 'max(pl) FILTER (WHERE x) AS p')} SELECT mode, round(avg(primary_), 6) AS baseline, round(avg(same_as_target), 6) AS exact, min(no_edit_match) AS unchanged FROM ms GROUP BY mode")
def r08(spark, d):
    t = tasks(spark, d).withColumn("pn", F.col("xn")).withColumn("pe", F.col("xe"))
    m = scoring.graph_metrics(t).withColumn("s", scoring.primary_score(F.col("mode")))
    return m.groupBy("mode").agg(F.round(F.avg("s"), 6).alias("baseline"), F.round(F.avg("same_as_target"), 6).alias("exact"), F.min("no_edit_match").alias("unchanged"))


_W = scoring.Reward().weights
REWARD_SQL = f"""rw AS (SELECT o, mode, o % 11 <> 0 AS valid, 0.35 + 0.5 * (o % 11 <> 0)::INT + 0.15 AS format, greatest(-1, least(1, (primary_ - 0.4) / greatest(0.1, 0.6))) AS imp, * EXCLUDE (o, mode) FROM ms),
rr AS (SELECT *, {_W['format_parse']} * format + {_W['schema_structure']} + {_W['fixed_contract']} * fixed_object_exact + {_W['node']} * node_f1 + {_W['edge']} * edge_f1 + {_W['mode_primary']} * primary_ + {_W['improvement']} * imp + {_W['exact_match']} * same_as_target
 - 0.35 * (1 - fixed_object_exact) - 0.1 * least(1, (spurious_nodes + spurious_edges) / greatest(1, target_size)) - CASE WHEN no_edit_match = 1 AND same_as_target = 0 THEN 0.15 ELSE 0 END AS total FROM rw)"""


@query("r10_shaped_reward", f"WITH {LONG_SQL}, {REWARD_SQL} SELECT o, round(CASE WHEN valid THEN greatest(-1, least(1, CASE WHEN fixed_object_exact < 1 THEN least(total, 0.25) ELSE total END)) ELSE 0.1 * format END, 8) AS reward FROM rr")
def r10(spark, d):
    m = scoring.graph_metrics(tasks(spark, d))
    valid = F.col("o") % 11 != 0
    m = m.withColumns({"target_size": (F.size("gn") + F.size("ge")).cast("double"), "valid": valid, "primary": scoring.primary_score(F.col("mode")), "baseline": F.lit(0.4), "schema_valid": F.lit(1.0), "structural_validity": F.lit(1.0), "duplicates": F.lit(0.0), "dangling": F.lit(0.0), "answer_ok": valid})
    m = m.withColumn("format", scoring.format_score(F.lit(1), F.lit(1), valid, valid, F.lit(1)))
    return scoring.reward(m, scoring.Reward()).select("o", F.round("reward", 8).alias("reward"))


@query("r11_improvement", f"WITH {LONG_SQL} SELECT o, round(greatest(-1, least(1, (primary_ - node_recall) / greatest(0.1, 1 - node_recall))), 8) AS improvement FROM ms")
def r11(spark, d):
    m = scoring.graph_metrics(tasks(spark, d))
    return m.select("o", F.round(scoring.improvement(scoring.primary_score(F.col("mode")), F.col("node_recall")), 8).alias("improvement"))


@query("r16_diversity_score", "WITH e AS (SELECT label, len(embedding) AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q FROM e GROUP BY 1, 2), t AS (SELECT label, sum(s * s) AS ss, sum(q) AS q FROM s GROUP BY 1), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT label, n, (ss - q) / (n * (n - 1)) AS sim FROM t JOIN c USING (label)) SELECT label, round(greatest(0, least(1, greatest(0, least(1, 1 - (sim - 0.15) / 0.35)) * 0.9 + least(0.1, n / 100))), 6) AS score FROM m")
def r16(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    s = e.groupBy("label", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    t = s.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.max("n").alias("n"))
    return t.select("label", F.round(scoring.diversity_score((F.col("ss") - F.col("q")) / (F.col("n") * (F.col("n") - 1)), F.col("n")), 6).alias("score"))


@query("r17_structure_score")
def r17(spark, d):
    return kernels.per_graph(sessions(spark, d), lambda es: [(scoring.structure_score(len({x for e in es for x in e[:2]}), es),)], "score double")


#: Tagged traces: a conversation's first and last turns between tags; every third one ends without its closing tag.
TRACE_SQL = """tr AS (SELECT conv_id, concat('<think><brainstorm> ', arg_min(text, turn), ' </brainstorm><synthesis>', arg_max(role, turn), '</synthesis></think> ', arg_max(text, turn), '<answer>', count(*), '</answer>', CASE WHEN conv_id % 3 = 0 THEN ' end' ELSE chr(10) END, CASE WHEN conv_id % 4 = 0 THEN '<answer>' ELSE '' END) AS t FROM conversations GROUP BY conv_id)"""


def traces(spark, d):
    """As TRACE_SQL."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("role", "turn").alias("r"), F.max_by("text", "turn").alias("z"), F.count("*").alias("n"))
    end = F.when(F.col("conv_id") % 3 == 0, " end").otherwise("\n")
    return g.select("conv_id", F.concat(F.lit("<think><brainstorm> "), "a", F.lit(" </brainstorm><synthesis>"), "r", F.lit("</synthesis></think> "), "z", F.lit("<answer>"), F.col("n").cast("string"), F.lit("</answer>"), end, F.when(F.col("conv_id") % 4 == 0, "<answer>").otherwise("")).alias("t"))


WS = "'^\\s+|\\s+$'"


@query("f01_first_tag", rf"WITH {TRACE_SQL} SELECT conv_id, regexp_replace(regexp_extract(t, '(?s)<brainstorm>(.*?)</brainstorm>', 1), {WS}, '', 'g') AS tag, regexp_extract(t, '(?s)<none>(.*?)</none>', 1) AS none FROM tr")
def f01(spark, d):
    return traces(spark, d).select("conv_id", text.first_tag(F.col("t"), "brainstorm").alias("tag"), text.regex_tag(F.col("t"), "none").alias("none"))


@query("f03_last_answer", rf"WITH {TRACE_SQL} SELECT conv_id, regexp_extract(t, '(?s)<answer>(.*?)</answer>', 1) AS answer, conv_id % 3 > 0 AND conv_id % 4 > 0 AS ended, CASE WHEN NOT (conv_id % 3 > 0 AND conv_id % 4 > 0) THEN 'trailing' END AS error FROM tr")
def f03(spark, d):
    return traces(spark, d).select("conv_id", text.last_answer(F.col("t")).alias("a")).select("conv_id", "a.*")


@query("f05_after_think", rf"WITH {TRACE_SQL} SELECT conv_id, length(regexp_replace(substr(t, strpos(t, '</think>') + 8), {WS}, '', 'g'))::INT AS first_len, length(regexp_replace(list_last(string_split(t, '</think>')), {WS}, '', 'g'))::INT AS last_len FROM tr")
def f05(spark, d):
    t = F.col("t")
    return traces(spark, d).select("conv_id", F.length(text.after_first(t, "</think>")).alias("first_len"), F.length(text.after_last(t, "</think>")).alias("last_len"))


@query("f07_final_output", f"WITH {TRACE_SQL} SELECT conv_id, regexp_extract(t, '<synthesis>(.*?)</synthesis>', 1) AS final FROM tr")
def f07(spark, d):
    return traces(spark, d).select("conv_id", text.final_output(F.col("t"), ["think"]).alias("final"))


@query("f08_canonical_json", "SELECT event_id, concat('{\"b\":', user_id, ',\"k\":', json_extract_string(props, '$.k'), '}') AS canonical FROM events")
def f08(spark, d):
    e = table(spark, d, "events")
    raw = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "b" : '), F.col("user_id").cast("string"), F.lit("}"))
    return e.select("event_id", F.to_json(F.try_parse_json(raw)).alias("canonical"))


@query("f15_label_tokens", r"SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(trim(regexp_replace(concat(p_name, ' ', p_type, '_ofThe ', p_brand), '[_\W]+', ' ', 'g'))), ' +'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'brand', 'widget')), ',') AS tokens FROM part".replace("'_ofThe '", "'_of The '"))
def f15(spark, d):
    label = F.concat("p_name", F.lit(" "), "p_type", F.lit("_ofThe "), "p_brand")
    words = F.filter(F.split(F.lower(F.trim(F.regexp_replace(F.regexp_replace(label, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\W]+", " "))), " +"), lambda w: F.length(w) >= 3)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(words, lambda w: ~w.isin("the", "brand", "widget")), ",").alias("tokens"))


@query("f16_slug_label", "SELECT p_partkey, regexp_replace(regexp_replace(lower(concat(p_brand, ' / ', p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, concat('big ', p_name) AS display FROM part")
def f16(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat("p_brand", F.lit(" / "), "p_name")).alias("slug"), text.display_label(F.concat(F.lit("big__"), "p_name")).alias("display"))


@query("f17_path_text", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('p', l_partkey, CASE WHEN l_linestatus = 'O' THEN concat(' -', l_returnflag, '-> ') ELSE concat(' <-', l_returnflag, '- ') END, 's', l_suppkey) AS path FROM lineitem")
def f17(spark, d):
    x = table(spark, d, "lineitem")
    p = text.path_text(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")), F.array("l_returnflag"), F.array(F.col("l_linestatus") == "O"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p.alias("path"))


@query("f19_idea_list", r"SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^[ \t]*(?:[-*]|[0-9]+[.)])[ \t]*', ''), ' ')), lambda x: length(x) > 12)[1:5])::INT AS ideas FROM documents")
def f19(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.idea_list(F.col("text"), 5)).alias("ideas"))


@query("f22_extracted_edges", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('part ', l_partkey, '|', lower(l_returnflag), '|supp ', l_suppkey) AS edges FROM lineitem")
def f22(spark, d):
    x = table(spark, d, "lineitem")
    free = F.concat(F.lit("Part "), "l_partkey", F.lit(" -> "), "l_returnflag", F.lit(" -> Supp "), "l_suppkey", F.lit("; none"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(text.extracted_edges(free), ";").alias("edges"))


@query("f23_corruption", "SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(range(0, 3), lambda i: struct_pack(h := sha256(concat('s:', i)), w := [p_brand, p_name, p_type][i + 1]))), lambda s: s.w), '|') AS shuffled FROM part")
def f23(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.shuffled(F.array("p_brand", "p_name", "p_type"), "s"), "|").alias("shuffled"))


PAIR_SQL = "pr AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = (SELECT min(vec_id) FROM embeddings c WHERE c.label = a.label))"


def pairs(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("y"), F.min("vec_id").alias("b"))
    return e.join(first, "label").select(F.col("vec_id").alias("a"), "b", F.col("embedding").alias("x"), "y")


@query("f30_cosine", f"WITH {PAIR_SQL} SELECT a, b, round(list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[])) + 1e-9), 6) AS cosine FROM pr")
def f30(spark, d):
    return pairs(spark, d).select("a", "b", F.round(measures.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


_TOK = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"


@query("f31_token_f1", f"WITH a AS (SELECT conv_id, arg_min(text, turn) AS a, arg_max(text, turn) AS b FROM conversations GROUP BY 1), s AS (SELECT conv_id, {_TOK.format('a')} AS a, {_TOK.format('b')} AS b FROM a), c AS (SELECT conv_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS n FROM s) SELECT conv_id, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE round(2 * (n / na) * (n / nb) / (n / na + n / nb + 1e-9), 4) END AS f1, round(n / (na + nb - n), 6) AS jaccard FROM c")
def f31(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    a, b = (measures.word_set(F.col(c)) for c in "ab")
    return g.select("conv_id", measures.token_f1(a, b).alias("f1"), F.round(measures.jaccard(a, b), 6).alias("jaccard"))


@query("f35_recovery", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_discount - l_tax) < 1e-9 THEN 0 ELSE round(greatest(0, least(1, (l_quantity / 500 - l_tax) / (l_discount - l_tax))), 6) END AS strict, CASE WHEN abs(l_discount - l_tax) < 1e-9 THEN 0 ELSE round(greatest(-0.5, least(1.5, (l_quantity / 500 - l_tax) / (l_discount - l_tax))), 6) END AS loose FROM lineitem")
def f35(spark, d):
    c, k, p = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 500
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(measures.recovery(c, k, p), 6).alias("strict"), F.round(measures.recovery(c, k, p, -0.5, 1.5), 6).alias("loose"))


@query("f36_extractor_pr", "WITH s AS (SELECT l_orderkey, list(DISTINCT l_partkey) FILTER (WHERE l_returnflag <> 'N') AS f, list(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'O') AS r FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN len(coalesce(r, [])) = 0 THEN 1 WHEN len(coalesce(f, [])) = 0 THEN 0 ELSE round(len(list_intersect(f, r)) / len(f), 6) END AS p, CASE WHEN len(coalesce(r, [])) = 0 THEN 1 ELSE round(len(list_intersect(coalesce(f, []), r)) / len(r), 6) END AS r FROM s")
def f36(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))).alias("f"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).alias("r"))
    p, r = measures.set_prf(F.col("f"), F.col("r"))
    return s.select("l_orderkey", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"))


@query("f41_stable_hash", "SELECT o_orderkey, substr(sha1(concat_ws('|', o_custkey, o_orderstatus, o_orderpriority)), 1, 16) AS h FROM orders")
def f41(spark, d):
    return table(spark, d, "orders").select("o_orderkey", measures.stable_hash(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("h"))


@query("f42_score_clamp", "SELECT event_id, greatest(0, least(5, try_cast(json_extract_string(props, '$.k') AS DOUBLE) / 10)) AS score FROM events")
def f42(spark, d):
    return table(spark, d, "events").select("event_id", measures.clamped_score((F.get_json_object("props", "$.k").try_cast("double") / 10).cast("string")).alias("score"))


@query("p13_rebuilt_think", "SELECT p_partkey, concat('<think>', chr(10), p_name, chr(10), p_brand, chr(10), p_type, chr(10), '</think>') AS think FROM part")
def p13(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws("\n", F.lit("<think>"), "p_name", "p_brand", "p_type", F.lit("</think>")).alias("think"))


@query("u01_set_keys", f"WITH {LONG_SQL} SELECT o, mn::BIGINT AS shared, (pn - mn)::BIGINT AS extra, (gn - mn)::BIGINT AS missing FROM ct")
def u01(spark, d):
    t = tasks(spark, d).select("o", F.map_keys("pn").alias("p"), F.map_keys("gn").alias("g"))
    return t.select("o", *[F.size(f).cast("long").alias(n) for n, f in (("shared", F.array_intersect("p", "g")), ("extra", F.array_except("p", "g")), ("missing", F.array_except("g", "p")))])


@query("f13_pair_contract", f"WITH {LONG_SQL}, c AS (SELECT o, count(*) FILTER (WHERE f AND x IS NULL) AS absent_x, count(*) FILTER (WHERE f AND g IS NULL) AS absent_g, count(*) FILTER (WHERE kind = 'e' AND x IS NOT NULL AND g IS NULL) AS outside FROM kk GROUP BY o) SELECT o, absent_x::INT AS absent_x, absent_g::INT AS absent_g, outside = 0 AS subset FROM c")
def f13(spark, d):
    t = tasks(spark, d)
    fixed = F.concat("fixed_nodes", "fixed_edges")
    x, g = F.concat(F.map_keys("xn"), F.map_keys("xe")), F.concat(F.map_keys("gn"), F.map_keys("ge"))
    return t.select("o", F.size(F.array_except(fixed, x)).alias("absent_x"), F.size(F.array_except(fixed, g)).alias("absent_g"), (F.size(F.array_except(F.map_keys("xe"), F.map_keys("ge"))) == 0).alias("subset"))
