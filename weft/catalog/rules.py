"""Queries: the rules for labels, relations and paths, over labels that trigger every rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.catalog.core import query, table
from weft.functions import labels

#: Labels that parts and customers stand for: some of every kind that a rule tells apart.
LABELS = [
    "CatecholCrosslink", "AB", "Abc", "", "DNA", "12/3 x", "node 7", "Idea", "Q", "Q12", "healing", "selfHealing", "calcium_alginate network",
    "quantum entanglement bridge", "novel idea for silk", "Alginate hydrogel matrix", "mechanism", "underlying-mechanisms", "%% 5 ## !!", "hr",
    "film", "Increased material topology map", "redox-active boronate ester", "chitosan nanofibril membrane", "trade offs", "polymer matrix",
    "capillary flow in silica capsules", "thermal noise", "Collagen peptide template under slow mineralization and very long names that go on and on for ever",
    "SelfHealing biopolymer composites", "repair of the self healing biopolymer composites", "ionic diffusion through porosity", "  zinc  ", "enzyme",
    "disulfide exchange kinetics", "benchmark suite", "sacrificial interfacial bonds", "RNA", "x/1/2/3/4", "micelle formation", "protein fibers", "Concept_3",
    "photothermal trigger", "response system process", "supramolecular vesicles", "cosmic rays", "hydrolysis of cellulose", "iron gelatin", "é è ü", "iii",
]
RELATIONS = ["related_to", "is", "", "triggers release of", "formed by", "influences", "binds to", "mediated_by", "contains", "looks like", "Controls", "transports", "is near", "provides", "  ", "enable"]
TOPIC = "Self-healing biopolymer composites"


def quoted(values: list[str]) -> str:
    """Values as a list for IN or a DuckDB list."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def pick(values: list[str], number: Column) -> Column:
    """The value at a number, round and round."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


_WORDS = r"list_transform(regexp_extract_all(translate(regexp_replace(label, '([a-z])([A-Z])', '\1 \2', 'g'), '_-', '  '), '[A-Za-z][A-Za-z0-9]+'), lambda x: lower(x))"
_COUNT = lambda cond: f"len(list_filter(w, lambda x: {cond}))"
#: What every label is, once: lab(i, label, s, norm, w, key, placeholder, spec, anchors, generic, local, middle, ends).
LABEL_SQL = rf"""lab0 AS (SELECT unnest(range({len(LABELS)})) AS i, unnest([{quoted(LABELS)}]) AS label),
lab1 AS (SELECT i, label, trim(label) AS s, regexp_replace(lower(trim(label)), '[^a-z0-9]+', '', 'g') AS norm, {_WORDS} AS w FROM lab0),
lab2 AS (SELECT *, array_to_string(w, ' ') AS key, regexp_full_match(s, '[A-Z][0-9]*') OR regexp_full_match(lower(s), '(node|concept|idea|thing|entity)[ _-]?[0-9]*') AS placeholder FROM lab1),
lab3 AS (SELECT *, key IN ({quoted(labels.GENERIC_KEYS)}) AS generic, key IN ({quoted(labels.GENERIC_KEYS + labels.LOCAL_KEYS)}) AS local, len(list_filter(list_distinct(w), lambda x: x IN ({quoted(labels.ANCHOR_WORDS)}))) AS anchors,
  key = 'self healing biopolymer composites' OR (list_has_all(w, ['self', 'healing', 'biopolymer', 'composites'])) AS hub FROM lab2),
lab4 AS (SELECT *, round(CASE WHEN placeholder THEN -3.0 WHEN generic THEN -1.5 WHEN len(w) = 0 THEN -2.0 ELSE 0.35 * len(w) + 0.25 * {_COUNT("length(x) >= 7")} + 0.35 * {_COUNT(f"x IN ({quoted(labels.SPECIFIC_WORDS)})")} - 0.25 * {_COUNT(f"x IN ({quoted(labels.VAGUE_WORDS)})")} END, 6)::DOUBLE AS spec,
  CASE WHEN placeholder THEN 'placeholder' WHEN regexp_matches(key, '{"|".join(labels.NOISY_PHRASES)}') THEN 'known_noisy_phrase' WHEN regexp_matches(key, '{"|".join(labels.META_PHRASES)}') THEN 'meta_or_method_label'
    WHEN regexp_matches(key, '{"|".join(labels.SPECULATIVE_PHRASES)}') THEN 'speculative_physics_label' WHEN hub THEN 'topic_hub' END AS middle FROM lab3),
lab AS (SELECT *, coalesce(middle, CASE WHEN local THEN 'generic_endpoint' WHEN anchors < 1 THEN 'endpoint_lacks_domain_anchor' END) AS ends FROM lab4)"""
_FLAGS = f"""concat_ws(',', CASE WHEN s = '' THEN 'empty' END, CASE WHEN length(norm) <= 3 AND s NOT IN ('DNA', 'RNA') THEN 'too_short' END, CASE WHEN regexp_full_match(s, '[A-Z][a-z]{{1,3}}') THEN 'short_fragment' END,
  CASE WHEN s IN ({quoted(labels.GENERIC)}) OR norm IN ({quoted(labels.GENERIC)}) THEN 'generic' END, CASE WHEN regexp_full_match(s, '[A-Z]{{1,3}}') AND s NOT IN ('DNA', 'RNA') THEN 'short_acronym' END,
  CASE WHEN regexp_matches(s, '[0-9]/[0-9]|[0-9]{{4,}}|(/[0-9]){{4,}}') THEN 'numeric_artifact' END, CASE WHEN length(s) > 90 THEN 'very_long' END, CASE WHEN length(regexp_replace(s, '[^A-Za-z]', '', 'g')) < greatest(1, length(s) * 0.25) THEN 'low_alpha' END)"""


@query("p05_noise_flags", f"WITH {LABEL_SQL} SELECT p_partkey, lab.label, {_FLAGS} AS flags, {_FLAGS} IN ('', 'very_long') AS minable FROM part JOIN lab ON i = p_partkey % {len(LABELS)}")
def p05(spark, d):
    label = pick(LABELS, F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", label.alias("label")).select("p_partkey", "label", F.array_join(labels.noise_flags(F.col("label")), ",").alias("flags"), labels.minable(F.col("label")).alias("minable"))


@query("p06_bad_labels", f"WITH {LABEL_SQL} SELECT p_partkey, length(norm) < 3 OR norm IN ({quoted(labels.GENERIC_GRAPH + labels.ARTIFACT_GRAPH)}) OR (regexp_full_match(s, '[A-Z]{{1,3}}') AND s NOT IN ('DNA', 'RNA')) AS bad FROM part JOIN lab ON i = p_partkey % {len(LABELS)}")
def p06(spark, d):
    return table(spark, d, "part").select("p_partkey", labels.bad_graph_label(pick(LABELS, F.col("p_partkey"))).alias("bad"))


@query("p07_specificity", f"WITH {LABEL_SQL} SELECT p_partkey, placeholder, anchors::INT AS anchors, spec AS score, spec >= 0.55 AS specific FROM part JOIN lab ON i = p_partkey % {len(LABELS)}")
def p07(spark, d):
    label = pick(LABELS, F.col("p_partkey"))
    s = labels.specificity(label)
    return table(spark, d, "part").select("p_partkey", labels.placeholder(label).alias("placeholder"), labels.anchors(label).alias("anchors"), s.alias("score"), (s >= labels.SPECIFIC_LEAST).alias("specific"))


#: Paths: the labels of an order's lines, by number.
PATH_SQL = f"""{LABEL_SQL}, pl AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, label) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m, 1 AS f, lab.* FROM lineitem JOIN lab ON i = l_partkey % {len(LABELS)})"""
_CLEAN = "count(*) >= 2 AND count(*) FILTER (WHERE placeholder) = 0 AND count(*) FILTER (WHERE generic) <= 1 AND count(*) FILTER (WHERE spec >= 0.55) >= 2"


def label_paths(spark, d):
    """(l_orderkey, path): labels of the lines of every order, by number."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", pick(LABELS, F.col("l_partkey")).alias("label")).alias("x"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x")).select("l_orderkey", F.transform("x", lambda x: x["label"]).alias("path"))


@query("p08_rejection_reason", f"WITH {PATH_SQL} SELECT o AS l_orderkey, CASE WHEN NOT ({_CLEAN}) THEN 'unclean_path' ELSE coalesce(arg_min(CASE WHEN n IN (m, f) THEN ends ELSE middle END, n) FILTER (WHERE CASE WHEN n IN (m, f) THEN ends ELSE middle END IS NOT NULL), CASE WHEN coalesce(sum(anchors) FILTER (WHERE n NOT IN (m, f)), 0) < 1 THEN 'bridge_lacks_domain_anchors' WHEN count(*) FILTER (WHERE local AND n NOT IN (m, f)) > 0 THEN 'too_many_generic_bridge_nodes' END) END AS reason FROM pl GROUP BY o")
def p08(spark, d):
    return label_paths(spark, d).select("l_orderkey", labels.path_rejection(F.col("path"), F.lit(TOPIC), least_anchors=1).alias("reason"))


@query("p09_clean_paths", f"WITH {PATH_SQL} SELECT o AS l_orderkey, {_CLEAN} AS clean FROM pl GROUP BY o")
def p09(spark, d):
    return label_paths(spark, d).select("l_orderkey", labels.clean_path(F.col("path")).alias("clean"))


_REL = f"rel AS (SELECT unnest(range({len(RELATIONS)})) AS i, replace(lower(trim(unnest([{quoted(RELATIONS)}]))), '_', ' ') AS r)"


@query("f40_relation_quality", f"WITH {_REL} SELECT o_orderkey, CASE WHEN r = '' THEN 0.2 WHEN r IN ({quoted(labels.GENERIC_RELATIONS)}) THEN 0.25 WHEN regexp_matches(r, '{'|'.join(labels.MECHANISM_STEMS)}') THEN 1.0 ELSE 0.65 END::DOUBLE AS lead, CASE WHEN r = '' THEN 0.0 WHEN r IN ({quoted(labels.PLAIN_RELATIONS)}) THEN 0.25 ELSE 0.75 END::DOUBLE AS insight FROM orders JOIN rel ON i = o_orderkey % {len(RELATIONS)}")
def f40(spark, d):
    r = pick(RELATIONS, F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", labels.lead_relation_quality(r).alias("lead"), labels.insight_relation_quality(r).alias("insight"))
