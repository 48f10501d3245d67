"""Exact graph metrics and shaped rewards as column arithmetic on one row.

A graph in a row is two maps: node id to canonical payload, and edge key
(source, relation, target joined by tabs) to canonical payload.  All set metrics
stay inside the row (``array_intersect`` and ``size``): no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    """a / b, ``empty`` for a zero denominator."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.when(b != 0, b))


def prf(matched: Column, predicted: Column, target: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; both sides empty: all 1; nothing predicted: precision 0; nothing wanted: recall 1."""
    nothing = (predicted == 0) & (target == 0)
    p = F.when(nothing, 1.0).otherwise(ratio(matched, predicted, 0.0))
    r = F.when(nothing, 1.0).otherwise(ratio(matched, target, 1.0))
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.when(p + r != 0, p + r))


def _ends(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.split_part(k, F.lit("\t"), F.lit(1)), F.lit("\t"), F.split_part(k, F.lit("\t"), F.lit(3))))


def _n(a: Column) -> Column:
    return F.size(a).cast("double")


def graph_metrics(df: DataFrame) -> DataFrame:
    """Add the metrics of prediction (pn, pe), target (gn, ge) and start (xn, xe) maps and fixed_nodes, fixed_edges arrays."""
    none = F.array().cast("array<string>")
    df = df.withColumns({f"k_{c}": F.coalesce(F.map_keys(c), none) for c in ("pn", "pe", "gn", "ge", "xn", "xe")})
    # the ends of every edge, once, beside its key
    df = df.withColumns({f"e_{c}": _ends(F.col(f"k_{c}")) for c in ("pe", "ge", "xe")})
    both, less = F.array_intersect, F.array_except
    held = lambda k, i, ends, of: F.array_contains(of, F.get(ends, i))
    df = df.withColumns(
        {
            "add_n": less("k_gn", "k_xn"),
            "add_e": less("k_ge", "k_xe"),
            "rem_e": less("k_xe", "k_ge"),
            "repair": F.filter("k_ge", lambda k, i: held(k, i, "e_ge", "e_xe") & ~F.array_contains("k_xe", k)),
            "wrong": F.filter("k_xe", lambda k, i: held(k, i, "e_xe", "e_ge") & ~F.array_contains("k_ge", k)),
            "fn": F.array_distinct("fixed_nodes"),
            "fe": F.array_distinct("fixed_edges"),
        }
    )
    alike = lambda keys, one, two: _n(F.filter(keys, lambda k: F.coalesce(F.col(one)[k] == F.col(two)[k], F.lit(False))))
    # every count once, as a column: the ratios below name them many times
    counts = {
        **{f"#{c}": _n(F.col(c)) for c in ("k_pn", "k_pe", "k_gn", "k_ge", "k_xn", "k_xe", "add_n", "add_e", "rem_e", "repair", "wrong", "fn", "fe")},
        "#n": _n(both("k_pn", "k_gn")), "#e": _n(both("k_pe", "k_ge")), "#comparable": _n(F.filter("e_pe", lambda x: F.array_contains("e_ge", x))),
        "#kept_n": alike("fn", "pn", "xn"), "#kept_e": alike("fe", "pe", "xe"), "#exact_n": alike("k_gn", "pn", "gn"), "#exact_e": alike("k_ge", "pe", "ge"), "#start_n": alike("k_xn", "pn", "xn"), "#start_e": alike("k_xe", "pe", "xe"),
        "#fixed_n": _n(both("fn", "k_pn")), "#fixed_e": _n(both("fe", "k_pe")), "#added_n": _n(both("add_n", "k_pn")), "#added_e": _n(both("add_e", "k_pe")), "#removed": _n(less("rem_e", "k_pe")), "#repaired": _n(both("repair", "k_pe")), "#corrected": _n(less("wrong", "k_pe")),
    }
    df = df.withColumns(counts)
    n = lambda c: F.col(f"#{c}")
    df = df.withColumns({f"#{x}_{m}": c for x, cs in (("n", prf(n("n"), n("k_pn"), n("k_gn"))), ("e", prf(n("e"), n("k_pe"), n("k_ge")))) for m, c in zip(("precision", "recall"), cs[:2], strict=True)})
    f1 = lambda x: F.when(n(f"{x}_precision") + n(f"{x}_recall") == 0, 0.0).otherwise(2 * n(f"{x}_precision") * n(f"{x}_recall") / F.when(n(f"{x}_precision") + n(f"{x}_recall") != 0, n(f"{x}_precision") + n(f"{x}_recall")))
    predicted, wanted = n("k_pn") + n("k_pe"), n("k_gn") + n("k_ge")
    fixed_n, fixed_e = ratio(n("kept_n"), n("fn")), ratio(n("kept_e"), n("fe"))
    exact = n("exact_n") + n("exact_e")
    out = {
        **{f"{name}_{m}": n(f"{x}_{m}") for x, name in (("n", "node"), ("e", "edge")) for m in ("precision", "recall")},
        "node_f1": f1("n"),
        "edge_f1": f1("e"),
        "relation_accuracy": ratio(n("e"), n("comparable"), 0.0),
        "relation_recall": ratio(n("e"), n("k_ge")),
        "relation_repair_recall": ratio(n("repaired"), n("repair")),
        "wrong_relation_removal_rate": ratio(n("corrected"), n("wrong")),
        "fixed_node_preservation": ratio(n("fixed_n"), n("fn")),
        "fixed_edge_preservation": ratio(n("fixed_e"), n("fe")),
        "fixed_node_payload_exact": fixed_n,
        "fixed_edge_payload_exact": fixed_e,
        "fixed_object_exact": F.least(fixed_n, fixed_e),
        "node_add_recall": ratio(n("added_n"), n("add_n")),
        "edge_add_recall": ratio(n("added_e"), n("add_e")),
        "addition_recall": ratio(n("added_n") + n("added_e"), n("add_n") + n("add_e")),
        "removal_rate": ratio(n("removed"), n("rem_e")),
        "spurious_nodes": n("k_pn") - n("n"),
        "spurious_edges": n("k_pe") - n("e"),
        "payload_precision": F.when(predicted == 0, F.when(wanted == 0, 1.0).otherwise(0.0)).otherwise(exact / F.when(predicted != 0, predicted)),
        "same_as_target": ((exact == wanted) & (predicted == wanted)).cast("double"),
        "no_edit_match": ((n("start_n") + n("start_e") == n("k_xn") + n("k_xe")) & (predicted == n("k_xn") + n("k_xe"))).cast("double"),
    }
    helpers = [c for c in df.columns if c.startswith(("k_", "e_", "#"))] + ["add_n", "add_e", "rem_e", "repair", "wrong", "fn", "fe"]
    return df.withColumns(out).drop(*helpers)


#: Weights of the primary score by mode.
PRIMARY = {
    "prior_empty": {"node_f1": 0.35, "edge_f1": 0.45, "relation_accuracy": 0.20},
    "fixed_nodes_only": {"node_add_recall": 0.25, "edge_recall": 0.50, "edge_f1": 0.25},
    "missing_edges": {"edge_add_recall": 0.55, "edge_recall": 0.30, "edge_precision": 0.15},
    "partial_subgraph": {"node_add_recall": 0.25, "edge_add_recall": 0.35, "edge_f1": 0.40},
    "wrong_relations": {"relation_repair_recall": 0.45, "wrong_relation_removal_rate": 0.35, "edge_f1": 0.20},
    "extra_edges": {"removal_rate": 0.45, "edge_precision": 0.35, "edge_f1": 0.20},
}


def primary_score(mode: Column) -> Column:
    """The mode's weighted metric; an unknown mode is an error when run."""
    out = None
    for name, parts in PRIMARY.items():
        value = sum((F.col(m) * w for m, w in parts.items()), F.lit(0.0))
        out = F.when(mode == name, value) if out is None else out.when(mode == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported mode: "), mode)).cast("double"))


@dataclass
class Reward:
    """Weights and penalties of the shaped reward (fixed default values)."""

    weights: dict = field(default_factory=lambda: {"format_parse": 0.10, "schema_structure": 0.10, "fixed_contract": 0.15, "node": 0.10, "edge": 0.15, "mode_primary": 0.15, "improvement": 0.10, "exact_match": 0.15})
    forbidden_change: float = 0.35
    duplicate: float = 0.05
    dangling: float = 0.10
    spurious_content: float = 0.10
    no_op: float = 0.15
    truncation: float = 0.15
    excessive_length: float = 0.05
    fixed_failure_cap: float = 0.25
    max_length: int | None = None
    preferred_length: int | None = None

    def validate(self) -> None:
        """Weights are not negative and sum to one."""
        if min(self.weights.values()) < 0 or abs(sum(self.weights.values()) - 1) > 1e-6:
            raise ValueError("reward weights must be non-negative and sum to 1")


def format_score(tags: Column, ended: Column, json: Column, schema: Column, structural: Column) -> Column:
    """Format signal of an answer from its five checks."""
    as_ = lambda c: c.cast("double")
    return 0.20 * as_(tags) + 0.15 * as_(ended) + 0.30 * as_(json) + 0.20 * as_(schema) + 0.15 * as_(structural)


def improvement(primary: Column, baseline: Column) -> Column:
    """Gain over no edit, relative to the room for gain (a tenth at least), within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (primary - baseline) / F.greatest(F.lit(0.10), 1.0 - baseline)))


def reward(df: DataFrame, config: Reward, stage: str = "shaped") -> DataFrame:
    """Add ``reward`` from the metrics, ``primary``, ``baseline``, ``format``, ``valid`` and the audit columns.

    The audit columns are schema_valid, structural_validity, duplicates, dangling,
    target_size, answer_ok (tags and ending), and optionally token_count.
    """
    config.validate()
    if stage == "format":
        return df.withColumn("reward", F.col("format"))
    fixed = F.col("fixed_object_exact")
    exact = F.col("same_as_target") * F.col("structural_validity")
    if stage == "exact":
        total = 0.80 * exact + 0.05 * F.col("answer_ok").cast("double") + 0.05 * F.col("schema_valid") + 0.05 * F.col("structural_validity") + 0.05 * fixed
    elif stage == "shaped":
        part = {
            "format_parse": F.col("format"),
            "schema_structure": (F.col("schema_valid") + F.col("structural_validity")) / 2,
            "fixed_contract": fixed,
            "node": F.col("node_f1"),
            "edge": F.col("edge_f1"),
            "mode_primary": F.col("primary"),
            "improvement": improvement(F.col("primary"), F.col("baseline")),
            "exact_match": exact,
        }
        total = sum((part[k] * w for k, w in config.weights.items()), F.lit(0.0))
    else:
        raise ValueError("stage must be format, shaped or exact")
    one = F.lit(1.0)
    total = total - config.forbidden_change * (1 - fixed) - config.duplicate * F.least(one, F.col("duplicates")) - config.dangling * F.least(one, F.col("dangling"))
    total = total - config.spurious_content * F.least(one, (F.col("spurious_nodes") + F.col("spurious_edges")) / F.greatest(one, F.col("target_size")))
    total = total - F.when((F.col("no_edit_match") == 1) & (exact == 0), config.no_op).otherwise(0.0)
    if config.max_length is not None:
        total = total - F.when((F.col("token_count") >= config.max_length) & ~F.col("answer_ok"), config.truncation).otherwise(0.0)
    if config.preferred_length is not None:
        over = F.col("token_count") / max(1, config.preferred_length) - 1
        total = total - F.when(F.col("token_count") > config.preferred_length, config.excessive_length * F.least(one, over)).otherwise(0.0)
    total = F.when(fixed < 1, F.least(total, F.lit(config.fixed_failure_cap))).otherwise(total)
    return df.withColumn("reward", F.when(F.col("valid"), F.greatest(F.lit(-1.0), F.least(one, total))).otherwise(0.10 * F.col("format")))


def diversity_score(mean_similarity: Column, elements: Column) -> Column:
    """Score of a graph's spread: similarity .15 and below is best, .50 worst; a bonus up to .1 for size; below two elements .3."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (mean_similarity - 0.15) / 0.35))
    return F.when(elements < 2, 0.3).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * 0.9 + F.least(F.lit(0.1), elements / 100))))


def structure_score(nodes: int, edges: list[tuple]) -> float:
    """Topology score of a small digraph: size, density, inner nodes, depth and connection."""
    from weft.operators.kernels import _adjacency, extent

    if not nodes:
        return 0.0
    pairs = sorted({(s, d) for s, d, *_ in edges})
    score = min(0.2, 0.2 * min(nodes, 20) / 20) if nodes >= 5 else 0.1 * nodes / 5
    if nodes > 1:
        score += min(0.2, 2 * len(pairs) / (nodes * (nodes - 1)))
    if nodes > 2:
        score += 0.3 * len({s for s, _ in pairs} & {d for _, d in pairs}) / nodes
    linked = _adjacency(pairs, False)
    acyclic, longest, diameter, _ = extent(pairs)[0] if pairs else (True, 0, 0, 0.0)
    from weft.operators.kernels import distances

    whole = len(linked) == nodes and len(distances(linked, next(iter(linked)))) == nodes if linked else nodes == 1
    deep = longest if acyclic else diameter
    score += 0.1 if not acyclic and not whole else min(0.2, 0.2 * min(deep, 6) / 6)
    return max(0.0, min(1.0, score + (0.1 if nodes == 1 or whole else 0.0)))
