"""Registered queries: each operator over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.llm.ann import search
from pallium.llm.boosted_quality import classify
from pallium.llm.bpe import encode_and_decode
from pallium.llm.collocations import ORACLE as COLLOCATIONS_ORACLE
from pallium.llm.collocations import collocations
from pallium.llm.html_text import extract
from pallium.llm.line_dedup import ORACLE as LINE_DEDUP_ORACLE
from pallium.llm.line_dedup import line_dedup
from pallium.llm.lm import score
from pallium.llm.packing import pack
from pallium.llm.quality import judge
from pallium.llm.resampling import ORACLE as RESAMPLING_ORACLE
from pallium.llm.resampling import resample
from pallium.llm.simhash import near_duplicates
from pallium.llm.substring_dedup import substring_dedup
from pallium.llm.urls import filter_urls

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(_table(spark, sf_dir, "documents"), TOKENIZER)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(_table(spark, sf_dir, "documents"), TOKENIZER)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "utf-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(_table(spark, sf_dir, "documents"), held_out, TOKENIZER)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"), neighbours=10)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_url_filters,
        op3_simhash_near_dedup,
        op4_packing,
        op5_bpe,
        op6_line_dedup,
        op7_lm_scoring,
        op8_quality_rules,
        op9_nearest_neighbours,
        op10_html_extraction,
        op11_importance_resampling,
        op12_collocations,
        op13_quality_classifier,
    )
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1
), marked AS (
  SELECT words.doc_id, words.i, word, max(r.i) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN repeated r ON words.doc_id = r.doc_id AND words.i = r.i
), kept AS (
  SELECT doc_id, count(*) AS n_words, count_if(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS t
  FROM marked GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op6_line_dedup": LINE_DEDUP_ORACLE,
    "op11_importance_resampling": RESAMPLING_ORACLE,
    "op12_collocations": COLLOCATIONS_ORACLE,
}
