"""Queries of the corpus operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, conversation_repair, decontam, hard_negatives, html_text, langid, lattice_lm, license_scan, line_dedup, quality, sampling, simhash, toxicity, vector_links


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_docs=10, digest=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of fold 0 of 5 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), modulus=5, held=0)
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", sampling.in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and the components of their links."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licence notices of every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of fold 2 of 4 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), modulus=4, held=2)
    found = quality.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", sampling.in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page in its layout."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return vector_links.link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.9)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 2 of 4 is held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs, modulus=4, held=2))
    return found.select("doc_id", sampling.in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector; every 7th vector has a wrong label first."""
    rows = table(spark, sf_dir, "embeddings")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", wrong.alias("label")), F.col("vec_id") % 50 == 0)


def damage_key() -> Column:
    """``conv_id:turn``, a null as one space."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after damage by a checksum."""
    given = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(conversation_repair.cleaned(given), damage_key()), given)


def op13_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document by all its segmentations; fold 2 of 7 is held out."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice_lm.score(docs, sampling.in_fold(F.col("doc_id"), 7, 2), lattice_lm.file_pieces(public_tokenizers.path("piece_bpe_32k.model")))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT r, i, line, key IN (SELECT key FROM hot) AS gone FROM k)
SELECT any_value(d.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m JOIN d USING (r) GROUP BY r
"""


OP8_SQL = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, up),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up),
iw AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
t AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM iw),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n),
h AS (SELECT r, p, dp.n, item FROM dp JOIN t ON dp.n = t.n AND array_to_string(dp.w[p:p + dp.n - 1], ' ') = t.k),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""


OP11_SQL = r"""
WITH g AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS v FROM embeddings),
r AS (SELECT row_number() OVER () AS r, vec_id, label, len(v) AS d, list_transform(v, lambda x: floor(256 * x)) AS q FROM g
      WHERE label IS NOT NULL AND vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, b.label = a.label AS same, list_dot_product(a.q, b.q)::BIGINT AS s
      FROM r AS a JOIN r AS b ON a.d = b.d AND a.r <> b.r WHERE a.vec_id % 50 = 0 AND a.d > 0),
p AS (SELECT a, anchor_id, b AS p, vec_id AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id, b) <= 5),
n AS (SELECT p.a, p.p, anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.s AS negative_score, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.vec_id, s.b) AS k
      FROM p JOIN s USING (a, anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.s AND 100 * s.s <= 95 * positive_score)
SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_simhash": op3_simhash,
        "op4_license_scan": op4_license_scan,
        "op5_quality": op5_quality,
        "op6_html_text": op6_html_text,
        "op7_embedding_links": op7_embedding_links,
        "op8_decontamination": op8_decontamination,
        "op9_language_id": op9_language_id,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_lattice_lm": op13_lattice_lm,
    }


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {"op1_line_dedup": OP1_SQL, "op8_decontamination": OP8_SQL, "op11_hard_negatives": OP11_SQL}
