"""Audit logs as JSON lines. They hold counts and types, never values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "timestamp variant, event string, session_id string, entity_count long, entity_types array<string>, tokens_restored long, tokens_not_found long, status string, role string, duration double"


def unix_time(v: Column) -> Column:
    """Seconds from a number or an ISO string (Z allowed, zone UTC if none); 0 for anything else."""
    text = F.try_variant_get(v, "$", "string")
    kind = F.schema_of_variant(v)
    iso = F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))) / 1e6
    return F.coalesce(F.when(kind == "STRING", iso).otherwise(F.try_variant_get(v, "$", "double")), F.lit(0.0))


def parse_audit(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Events of JSON lines; blank and malformed lines go. `ts` is in Unix seconds."""
    v = F.try_parse_json(F.trim(line_col))
    get = lambda name, kind: F.try_variant_get(F.col("v"), f"$.{name}", kind).alias(name)
    fields = [f.split(" ", 1) for f in FIELDS.split(", ") if not f.startswith("timestamp")]
    ts = F.when(F.try_variant_get("v", "$.timestamp", "variant").isNull(), 0.0).otherwise(unix_time(F.try_variant_get("v", "$.timestamp", "variant")))
    return lines.select(v.alias("v")).filter("v is not null").select(ts.alias("ts"), *[get(n, k) for n, k in fields])


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return parse_audit(spark.read.text(path))


def write_audit(events: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines of audit rows. Columns that may hold texts are refused."""
    refused = {"text", "value", "masked_text", "restored_text", "spans"} & set(events.columns)
    if refused:
        raise ValueError(f"audit rows must not have {sorted(refused)}")
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode(mode).text(path)
