"""Registered queries on the smallest tables: names and types of the contract, SQL where there is some, the guard of the entry module."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from weft.llm import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_html_text": "page_id bigint, text string",
    "op7_embedding_links": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op13_lattice_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = registry.queries()[name](spark, DATA)
    kinds = dict(df.dtypes)
    assert {f: kinds.get(f) for f in (c.split()[0] for c in COLUMNS[name].split(", "))} == dict(c.split() for c in COLUMNS[name].split(", "))
    if name == "op11_hard_negatives":
        return  # as many rows as there are negatives: its SQL tells
    if name == "op12_conversation_repair":
        assert df.count() == spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().count()
        return
    source = {"op6_html_text": "pages", "op7_embedding_links": "embeddings"}.get(name, "documents")
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/{source}.parquet").count()
    if "score" in kinds and name != "op13_lattice_lm":
        assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[n] for n in names)) for r in registry.queries()[name](spark, DATA).collect()) == want


def test_nothing_else_imports_this_subpackage(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    block = "import sys; sys.modules['weft.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", block], cwd=repo, check=True)


def test_the_rest_works_where_these_files_are_gone(tmp_path):
    import shutil

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    bare = str(tmp_path / "bare")
    shutil.copytree(repo, bare, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache"))
    check = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", check], cwd=bare, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=bare, check=True, stdout=subprocess.DEVNULL)


def test_errors_within_the_subpackage_are_not_hidden(tmp_path):
    import shutil

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    broken = str(tmp_path / "broken")
    shutil.copytree(repo, broken, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "tests"))
    with open(f"{broken}/weft/llm/bpe.py", "a") as f:
        f.write("\nimport a_module_that_nobody_has\n")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=broken, stderr=subprocess.DEVNULL).returncode
