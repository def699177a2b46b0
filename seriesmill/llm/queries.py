"""The corpus operators as queries over the given tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import ann, bpe, exact_dedup, fill_middle, html_pages, html_text, line_dedup, near_dedup, packing, quality, spelling, suffix_dedup, toxicity, warc
from seriesmill.llm.common import shared_dir, table


def vocabulary() -> str:
    """The vocabulary file: SERIESMILL_VOCABULARY, or the word-end BPE file of the public tokenizers."""
    if "SERIESMILL_VOCABULARY" in os.environ:
        return os.environ["SERIESMILL_VOCABULARY"]
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_array_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"], keep_text=False)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False).withColumnRenamed("id", "doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("row.doc_id", "posterior", "score", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write_archives(warc.plan_captures(table(spark, sf_dir, "pages")), path)
    return warc.captures_of(warc.read_archives(spark, path), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last > page_id THEN last END AS refers_to FROM q
"""

def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), keep_text=False).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), train_on=~toxicity.held_out("id"))
    out = toxicity.score(docs, machine, carry=["doc_id"])
    return out.select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = html_text.train(html_pages.labelled_pages(spark))
    return html_text.extract(table(spark, sf_dir, "pages"), field, carry=["page_id", "url"]).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), carry=["doc_id"])
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256")]
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup, "op2_packing": op2_packing, "op3_near_dedup": op3_near_dedup, "op4_exact_dedup": op4_exact_dedup, "op5_bpe": op5_bpe,
    "op6_quality": op6_quality, "op7_warc": op7_warc, "op8_ann": op8_ann, "op9_line_dedup": op9_line_dedup, "op10_toxicity": op10_toxicity,
    "op11_spelling": op11_spelling, "op12_html": op12_html, "op13_fill_middle": op13_fill_middle,
}
ORACLES = {"op4_exact_dedup": OP4_SQL, "op7_warc": OP7_SQL, "op13_fill_middle": OP13_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
