"""Sinks, splits, tails, experiments and the small-world row, against plain Python."""

import itertools
import json
import math
import threading

import pytest

from weft.functions import measures
from weft.operators import centrality, experiments
from weft.sources import readers
from weft.streaming import incremental


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "rows")
    df = spark.createDataFrame([(1, "a"), (2, None)], "i long, t string").coalesce(1)
    readers.append_jsonl(df, at)
    readers.append_jsonl(df.where("i = 2"), at)
    assert sorted(json.loads(line)["i"] for f in (tmp_path / "rows").glob("*.json") for line in f.read_text().splitlines()) == [1, 2, 2]
    assert all("t" in json.loads(line) for f in (tmp_path / "rows").glob("*.json") for line in f.read_text().splitlines())
    for kind in ("json", "csv", "parquet"):
        readers.overwrite(df, at, kind)
        readers.overwrite(df.where("i = 1"), at, kind)
        assert spark.read.format(kind).option("header", True).load(at).count() == 1
    with pytest.raises(ValueError):
        readers.overwrite(df, at, "xml")


def test_split_seeds_and_tail(spark):
    df = spark.createDataFrame([(g, k) for g in range(30) for k in range(3)], "g long, k long")
    parts = {s: readers.prepare_split(df, s, "g", seed=7, limit=5) for s in readers.SPLITS}
    groups = {s: {r.g for r in p.collect()} for s, p in parts.items()}
    assert all(len(g) == 5 for g in groups.values()) and all(p.count() == 15 for p in parts.values()) and len(set(map(frozenset, groups.values()))) == 3
    assert groups["validation"] == {r.g for r in readers.prepare_split(df, "train", "g", seed=8, limit=5).collect()}
    assert readers.prepare_split(df, "test", "g").count() == 90
    with pytest.raises(ValueError):
        readers.prepare_split(df, "dev", "g")
    assert [r.g for r in readers.tail(df.select("g").distinct(), "g", 3).collect()] == [27, 28, 29]


def test_reads_a_file_that_is_being_rewritten(spark, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text("<graphml><graph><node id=")
    whole = readers.graphml_text([("a", "A", 1, 1), ("b", "B", 1, 2)], [("a", "b", "r", 1, 1)])
    threading.Timer(1.0, lambda: path.write_text(whole)).start()

    def reader(p):
        nodes, edges = readers.read_graphml(spark, p)
        if not nodes.limit(1).count():
            raise ValueError("half a file")
        return nodes, edges

    nodes, edges = readers.read_while_written(spark, str(path), reader, tries=20, wait=0.5)
    assert nodes.count() == 2 and edges.count() == 1
    with pytest.raises(Exception):  # noqa: B017  whatever the reader raised
        readers.read_while_written(spark, str(tmp_path / "none"), reader, tries=2, wait=0.01)


def test_steps_are_emitted_once_and_tailed(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "iter long, nodes long"
    for part in ([(1, 5), (2, 6)], [(3, 9)]):
        readers.append_jsonl(spark.createDataFrame(part, schema).coalesce(1), source)
        incremental.emit_steps(incremental.tailed(spark, source, schema), out, state).awaitTermination()
    incremental.emit_steps(incremental.tailed(spark, source, schema), out, state).awaitTermination()
    assert sorted(map(tuple, spark.read.schema(schema).json(out).collect())) == [(1, 5), (2, 6), (3, 9)]


def test_measures_of_answers(spark):
    df = spark.createDataFrame([("heat causes flow", "Flow causes, due to x", "A→causes→B"), ("none", "cause", ""), ("", "", "x")], "a string, b string, g string")
    got = [tuple(r) for r in df.select(measures.mechanism_f1(df.a, df.b), measures.graph_support(df.a, df.g)).collect()]
    assert got == [(round(2 * 1 * 0.5 / (1.5 + 1e-9), 4), 1.0), (0.0, 0.0), (0.0, 0.0)]
    edges = spark.createDataFrame([(["a|r|b", "b|s|c"], ["b|r|a", "x|s|y"])], "c array<string>, k array<string>")
    assert edges.select(measures.entity_overlap(edges.c, edges.k), measures.set_f1(edges.c, edges.k)).first()[:] == (round(2 / (3 + 1e-9), 4), 0.0)


def test_stages_layers_and_distinct(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0], [2.0, 0.0]), (2, [1.0, 1.0], [1.0, 1.0], [3.0, 3.0])], "i long, a array<double>, s array<double>, t array<double>")
    assert [(r.i, r.closest) for r in experiments.closest_stage(df, "a", ["s", "t"]).orderBy("i").collect()] == [(1, "t"), (2, "s")]
    layers = spark.createDataFrame([("x", 0, 0.2), ("x", 1, 0.9), ("x", 2, 0.9), ("y", 2, 0.1)], "k string, l long, v double")
    got = {r.k: (r.peak_layer, r.early_peak, r.last_value) for r in experiments.layer_summary(layers, "k", "l", "v", (1, 1), 2).collect()}
    assert got == {"x": (1, True, 0.9), "y": (2, False, 0.1)}
    sims = spark.createDataFrame([("x", 0.25), ("z", 0.5)], "k string, s double")
    out = {r.k: (r.peak_layer, r.s_gap) for r in experiments.with_layer_summary(sims, experiments.layer_summary(layers, "k", "l", "v", (1, 1), 2), "k", ["s"]).collect()}
    assert out == {"x": (1, 0.75), "z": (None, 0.5)}
    v = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.99, 0.01]), (0, 3, [0.0, 1.0]), (1, 4, [1.0, 0.0])], "g long, id long, v array<double>")
    assert sorted(map(tuple, experiments.distinct_count(v, "g", "id", "v").select("g", "distinct", "n").collect())) == [(0, 2, 3), (1, 1, 1)]
    used = {r.g: r.incorporation for r in experiments.incorporation(v, spark.createDataFrame([(1, [0.0, 1.0])], "id long, v array<double>"), "g").collect()}
    assert used == pytest.approx({0: (0 + 0.01 + 1) / 3, 1: 0.0})


def test_small_world(spark):
    links = [(k, (k + s) % 12) for k in range(12) for s in (1, 2)] + [(3, 9), (50, 51)]
    near = {}
    for a, b in links[:-1]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    c = sum(sum(y in near[x] for x, y in itertools.combinations(near[n], 2)) / (len(near[n]) * (len(near[n]) - 1) / 2) for n in near) / 12
    total = 0
    for s in near:
        dist, todo = {s: 0}, [s]
        for x in todo:
            for y in near[x] - set(dist):
                dist[y] = dist[x] + 1
                todo.append(y)
        total += sum(dist.values())
    length, k = total / (12 * 11), 2 * 25 / 12
    df = spark.createDataFrame([(min(p), max(p)) for p in links], "u long, v long")
    for room in (10**6, 0):
        r = centrality.small_world(df, room).first()
        assert (r.nodes, r.links) == (12, 25) and r.clustering == pytest.approx(c) and r.distance == pytest.approx(length)
        assert r.sigma == pytest.approx(c / (k / 11) / (length / (math.log(12) / math.log(k)))) and r.omega == pytest.approx(math.log(12) / math.log(k) / length - c / (3 * (k - 2) / (4 * (k - 1))))
    assert centrality.small_world(df.where("u = 50")).count() == 0


def test_stream_of_concepts_ends_like_the_batch(spark):
    import os

    from weft.operators.embedding import sequential_dedup

    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    stream = incremental.concept_upsert(incremental.source(spark, path, 1), "label", "vec_id", "embedding", 0.3)
    batch = sequential_dedup(spark.read.parquet(path), "label", "vec_id", "embedding", 0.3)
    got = sorted((r.graph_id, r.id, r.merged_into) for r in incremental.drained(stream).collect())
    assert got == sorted((r.label, r.id, r.merged_into) for r in batch.collect()) and any(a != b for _, a, b in got)


def test_principal_variance_like_numpy(spark):
    import os

    import numpy as np

    from weft.catalog import all_queries

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    x = np.array([r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = [r.explained for r in all_queries()["v09_principal_variance"](spark, data).orderBy("component").collect()]
    assert got == pytest.approx((values[:2] / values.sum()).tolist(), rel=1e-4)
