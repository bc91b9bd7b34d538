"""The training-corpus pipeline: quality rules, line dedup, near-duplicate removal, substring dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.llm.line_dedup import line_dedup
from pallium.llm.near_dedup import near_duplicate_groups
from pallium.llm.packing import pack
from pallium.llm.quality import apply_cutoffs, fit_cutoffs, text_signals
from pallium.llm.session import release, stored
from pallium.llm.substring_dedup import substring_dedup

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ["row_id", "doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row, written once; ids may be null or repeat, so the stages join on it."""
    return docs if "row_id" in docs.columns else stored(docs.withColumn("row_id", F.monotonically_increasing_id()), "numbered")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep, with a row number.

    Cutoffs are fitted first; then each document is judged where it is read, so no text is shuffled or written beside the result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    cutoffs = fit_cutoffs(stored(text_signals(docs), "signals"), labels)
    whole = docs.withColumn("_row", F.struct(*[c for c in COLUMNS if c != "row_id"]))
    kept = apply_cutoffs(text_signals(whole, "_row"), cutoffs).filter("kept").select("_row.*")
    return kept.withColumn("row_id", F.monotonically_increasing_id()).select(*COLUMNS)


def _with_words(docs: DataFrame) -> DataFrame:
    """docs with new texts, unless that leaves no word of a document."""
    return docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; documents that were such copies throughout go."""
    release(spark)
    docs = _numbered(docs)
    return _with_words(line_dedup(docs, "row_id", also=("doc_id", "lang", "source")).withColumnRenamed("kept_text", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least row number, of each group at a similarity of 0.8 of five-word shingles."""
    release(spark)
    docs = _numbered(docs)
    # written, so that Spark knows its size when it plans: a few rows need no shuffle of all texts
    gone = stored(near_duplicate_groups(docs, "row_id").filter("row_id <> component_id").select("row_id"), "near-copies", keep=True)
    return docs.join(gone, "row_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without all but the first copy of each repeated passage of 35 words or more."""
    release(spark)
    docs = _numbered(docs)
    new = substring_dedup(docs, "row_id", keep_first=True, spaced=False).select("row_id", F.col("kept_text").alias("text"))
    return _with_words(docs.select("row_id", "doc_id", "lang", "source").join(new, "row_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    release(spark)
    out = pack(docs, TOKENIZER)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_runs),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", packed),
]

#: SQL can express neither the binomial cutoffs nor SimHash, so the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again by the next. A stage begins by removing what those before it had stored for themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"), keep=True)
    return docs
