"""The pipeline's stages on a small folder: decisions take effect, clean rows and columns stay."""

import corpus_pipeline
from tests.llm.test_classifiers import texts


def test_stages(spark, tmp_path):
    rows = [(i, t, lang, toxic) for i, t, lang, toxic, good in texts(400, 5) if good]
    shared = "A shared line of words that many documents have."
    docs = [(i, t + ("\n" + shared if i % 5 == 0 else ""), lang, f"s{i % 3}", len(t)) for i, t, lang, _ in rows]
    base = " ".join(f"own{k}" for k in range(60))
    item = " ".join(f"bench{k}" for k in range(15))
    docs += [(1000, base, "en", "s", 5), (1001, base, "en", "s", 5), (1002, base + " more", "en", "s", 5), (1003, f"before {item} after", "en", "s", 5), (1004, None, None, None, None), (None, "a text without an id", "en", "s", 1), (1005, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, x) for i, _, _, x in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: r for r in out.collect()}
    assert {k: k in got for k in (None, 1000, 1001, 1003, 1004)} == {None: True, 1000: True, 1001: False, 1003: False, 1004: True}
    assert all(shared not in (r.text or "") for r in got.values())
    assert all(r.exact and r.n_tokens == len(r.ids) for r in got.values())
    clean = [i for i, _, _, x in rows if not x]
    assert sum(i in got for i in clean) > 0.9 * len(clean)
    assert sum(i in got for i, _, _, x in rows if x) < 0.2 * sum(x for *_, x in rows)
    assert got[1000].n_chars == len(base)


def test_repeated_ids_are_judged_by_row(spark):
    one, two, three = (" ".join(f"{w}{k}" for k in range(60)) for w in ("one", "two", "three"))
    docs = [(5, one), (5, two), (5, two), (3, three), (7, three), (7, "alone " + " ".join(f"x{k}" for k in range(60))), (None, one)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(5, one), (5, two), (3, three), docs[5], (None, one)], key=str)


def clashing(spark, rows):
    """Documents whose other columns are named as those that stages make."""
    names = ["n_lines", "n_dropped", "kept_text", "__score", "score", "fp", "component", "__kept", "__rank", "n_hit", "items", "__text", "c1", "t"]
    return spark.createDataFrame([(*r, *[f"{n} of {r[0]}" for n in names]) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))


def folder(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    labelled = [(i, 1, int(i % 3 == 0)) for i in range(60)]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of its own words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_columns_of_any_name_pass_every_stage(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + ("\nshared line" if i < 20 else "")) for i in range(40)] + [(50, None), (51, ""), (52, "long " * 30_000)]
    docs = clashing(spark, rows)
    at = folder(spark, tmp_path, docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == f"{n} of {r.doc_id}" for n in docs.columns[2:])
    gone = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, at).collect()}
    assert gone[0] == rows[0][1].split("\n")[0] and gone[50] is None and gone[30] == rows[30][1]
    last = corpus_pipeline.tokens(spark, docs, at)
    assert last.columns == [*docs.columns, "n_tokens", "ids", "ids_sha256", "decoded_sha256", "exact"] and all(r.exact for r in last.collect())


def test_an_empty_table_stays_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, docs)).collect() == []


def test_intermediate_tables_are_removed(spark, tmp_path):
    import os

    from weft import shared

    rows = [(100 + i, f"text number {i} of some words", "en", "s", 5) for i in range(12)]  # none has a label
    at = folder(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    before = set(os.listdir(shared.shared_dir(spark)))
    out = corpus_pipeline.run(spark, at)
    assert [n.split("-")[0] for n in set(os.listdir(shared.shared_dir(spark))) - before] == ["decontamination"]
    assert out.count() == 12
