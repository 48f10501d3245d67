"""What travels: how often the rows of large tables are shuffled, and how wide."""

import math
import re

from pyspark.sql import functions as F

from weft.catalog import reports, scores
from weft.operators import benchmark, communities, graph, insights, mining, sampling

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Shuffles by a key in the plan."""
    return plan(df).count("Exchange hashpartitioning")


def test_lines_of_tasks_travel_once(spark):
    assert exchanges(scores.tasks(spark, D)) == 1


def test_integrity_sends_tasks_once(spark):
    row = "source_index string, variant_index string, mode string"
    refs = spark.createDataFrame([("1", "0", "a"), ("1", None, "a"), ("2", "0", "b")], row)
    preds = spark.createDataFrame([("1", "0", "a", 1), ("1", "0", "a", 1), ("1", None, "a", 1), ("3", "0", None, 1)], row + ", generation_index int")
    out = benchmark.integrity(preds, refs, 5)
    r = out.first()
    assert (r.input_prediction_rows, r.missing_mode_rows, r.expected_unique_tasks, r.predicted_unique_tasks, r.duplicate_task_generation_rows) == (4, 1, 3, 2, 1)
    assert (r.missing_expected_tasks, r.unexpected_tasks, r.missing_expected_examples, r.unexpected_examples) == (2, 1, ["1:a", "2:0:b"], ["1:a"])  # a null key meets none
    assert plan(out).count("Exchange hashpartitioning(source_index") <= 2  # for the counts, and again for the examples


def test_prepared_splits_write_what_they_read(spark):
    preds, refs = reports.saved(spark, D, [], [*benchmark.KEYS, "bad"])
    assert preds is None and refs.columns == [*benchmark.KEYS, "bad"]


def test_balanced_cap_passes_on_first_rows_only(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("mode"), "id")
    cut = sampling.balanced_cap(df, "mode", F.col("id"), ["0", "1"], 20)
    assert cut.count() == 20 and "WindowGroupLimit" in plan(cut)


def without_broadcasts(spark, made):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(made())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_round_of_communities_sends_links_twice(spark):
    links = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (2, 3, 1), (3, 2, 1)], "a long, b long, w long")
    known = spark.createDataFrame([(1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 1, 1)], "id long, community long, volume long, all long")
    text = without_broadcasts(spark, lambda: communities._moved(links, known, 4, 0))
    assert text.count("Exchange hashpartitioning") <= 4  # two for the links, two for the nodes that they meet


def test_recombinations_pair_ends_with_vectors_only(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 3, 1), (2, 4, 2), (3, 3, 0)], "src long, dst long, iter long")
    born = spark.createDataFrame([(1, 3), (2, 1), (3, 5), (4, 2)], "id long, iter long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    found = lambda: mining.recombinations(edges, born, vectors, below=0.5)
    assert [(r.u, r.v, r.iter) for r in found().collect()] == [(1, 3, 5)]  # node 4 has no vector, 3 came in round 5
    text = without_broadcasts(spark, found)
    assert text.count("Exchange hashpartitioning(u") + text.count("Exchange hashpartitioning(v") <= 9  # not once for each end's edges and births


def test_triads_pair_ends_with_vectors_only(spark):
    simple = spark.createDataFrame([(1, 2, "r", 1), (2, 3, "r", 2), (2, 4, "r", 3), (5, 2, "r", 4)], "src long, dst long, relation string, seq long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None)], "id long, v array<double>")
    assert [tuple(r) for r in insights.scored_triads(simple, vectors).collect()] == [(1, 2, 3, 1.0)]
    assert {(r.a, r.c) for r in graph.open_triads(simple, vectors.select("id")).collect()} == {(1, 3), (1, 4)}


def test_latent_links_send_pairs_once(spark):
    links = [(1, 2), (1, 3), (1, 4), (2, 5), (3, 5), (4, 5), (5, 6)]
    u = spark.createDataFrame(links, "u long, v long")
    vectors = spark.createDataFrame([(2, [1.0])], "id long, v array<double>")
    text = without_broadcasts(spark, lambda: mining.latent_links(u, vectors))
    assert len(re.findall(r"Exchange hashpartitioning\(u#\d+L?, v#\d+L?", text)) == 4  # opened pairs and links; the same for the highest score
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for hub in (2, 200):
        first = {k: sorted(x)[:hub] for k, x in near.items()}
        opened = {(a, b) for x in first.values() for a in x for b in x if a < b and b not in near[a]}
        want = {(a, b): len(near[a] & near[b]) for a, b in opened}
        assert {(r.u, r.v): r.common for r in mining.latent_links(u, vectors, hub=hub).collect()} == want


def test_adamic_adar_sends_wedges_once(spark):
    u = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "u long, v long")
    text = without_broadcasts(spark, lambda: graph.adamic_adar(u))
    assert len(re.findall(r"Exchange hashpartitioning\(u#\d+L?, v#\d+L?", text)) == 2  # wedges and links
    assert {(r.u, r.v): (r.common, round(r.aa, 9)) for r in graph.adamic_adar(u).collect()} == {(1, 4): (2, round(2 / math.log(2), 9)), (2, 3): (2, round(2 / math.log(2), 9))}
    assert text.count("Exchange hashpartitioning(mid") == 0
