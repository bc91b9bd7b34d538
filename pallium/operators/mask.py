"""Tokens, masking, and the summary of a masked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.functions.spans import BLOCK_BITS, bind

REDACTED = "[REDACTED]"


def normalize_type(raw: Column) -> Column:
    """Canonical form of an entity type: trimmed, runs of white space and dashes as one underscore, upper case."""
    return F.upper(F.regexp_replace(F.trim(F.regexp_replace(raw, r"^\s+|\s+$", "")), r"[\s\-]+", "_"))


def token(session: Column, entity_type: Column, value: Column, hex_len: int = 12) -> Column:
    """{{SG_TYPE_hex}}: the same for equal (session, type, value), so a retried task makes the same tokens.

    Six to twelve hex digits can be restored. Eight suffice for small sessions; twelve for a corpus.
    """
    if not 6 <= hex_len <= 12:
        raise ValueError("hex_len must be between 6 and 12")
    name = F.upper(F.regexp_replace(entity_type, r"[ \-]", "_"))
    return F.concat(F.lit("{{SG_"), name, F.lit("_"), F.substring(F.sha2(F.concat_ws(":", session, entity_type, value), 256), 1, hex_len), F.lit("}}"))


def value_hash(entity_type: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", entity_type, value), 256)


def _cut(blocks: Column, begin: Column, end: Column) -> Column:
    """Characters [begin, end) of a text from its blocks."""
    first = F.shiftright(begin, BLOCK_BITS)
    whole = F.array_join(F.slice(blocks, first + 1, F.greatest(F.shiftright(end - 1, BLOCK_BITS) - first + 1, F.lit(0))), "")
    return F.substring(whole, begin % (1 << BLOCK_BITS) + 1, end - begin)


def replace_spans(text: Column, spans: Column, replacement) -> Column:
    """The text with the value of every span replaced, left to right. Blanks that a span holds behind its value stay.

    What lies between two values is cut from the blocks of the text it lies in, and all pieces are joined once, so the
    work grows with the text and the number of spans. A null replacement makes the text null, so no value stays.
    """

    def built(x: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            return F.concat(_cut(x["blocks"], F.when(i == 0, 0).otherwise(ending(F.get(x["spans"], i - 1))), s["start"]), replacement(s))

        tail = _cut(x["blocks"], ending(F.element_at(x["spans"], -1)), F.length(text))
        joined = lambda p: F.when(~F.exists(p, lambda y: y.isNull()), F.concat(F.array_join(p, ""), tail))
        return bind(F.transform(x["spans"], piece), joined)

    ending = lambda s: s["start"] + F.length(s["text"])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(bind(F.struct(blocks.alias("blocks"), spans.alias("spans")), built))


def mask(df: DataFrame, text_col: str = "text", session_col: str = "session_id", spans_col: str = "spans", hex_len: int = 12, bypass: bool = False) -> DataFrame:
    """`df` (with spans) plus masked_text, entity_count, entity_types and had_pii.

    A span whose field `entity_type` starts with REDACTED_ becomes [REDACTED], without a token. A null text
    stays null. With `bypass` the text is unchanged and the counts are zero.
    """
    spans = F.array().cast(df.schema[spans_col].dataType) if bypass else F.col(spans_col)

    def replacement(s: Column) -> Column:
        return F.when(s["entity_type"].startswith("REDACTED_"), F.lit(REDACTED)).otherwise(token(F.col(session_col), s["entity_type"], s["text"], hex_len))

    return df.withColumns(
        {
            "masked_text": F.col(text_col) if bypass else replace_spans(F.col(text_col), spans, replacement),
            "entity_count": F.size(spans),
            "entity_types": F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity_type"]))),
            "had_pii": F.size(spans) > 0,
        }
    )


def split_failed(masked: DataFrame, keys: list[str], text_col: str = "text", masked_col: str = "masked_text") -> tuple[DataFrame, DataFrame]:
    """(rows safe to pass on, quarantine of keys and reason): no text ever goes on unmasked after a failure.

    The reason is generated, then filtered: a plain filter would move before the masked text is made, and Spark would
    run the recognizers in it once for each time that the masking names the spans.
    """
    failed = F.col(masked_col).isNull() & F.col(text_col).isNotNull()
    if "errors" in masked.columns:
        failed = failed | (F.size("errors") > 0)
    reason = F.when(F.col(masked_col).isNull(), "masking failed").otherwise("recognizer failed")
    judged = masked.select("*", F.explode_outer(F.array(F.when(F.coalesce(failed, F.lit(True)), reason))).alias("_reason"))
    return judged.filter("_reason is null").drop("_reason"), judged.filter("_reason is not null").select(*keys, F.col("_reason").alias("reason"))
