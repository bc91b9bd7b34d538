"""Texts in chat requests, provider responses and stream chunks, kept as JSON strings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, key_cols: list[str], text_col: str, fmt: str = "parquet") -> DataFrame:
    """Keys and text of a table of documents, pages or turns."""
    return spark.read.format(fmt).load(path).select(*key_cols, text_col)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is_list(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(v, path, "variant")).startswith("ARRAY"), F.lit(False))


def _entry(path: Column, text: Column) -> Column:
    return F.struct(path.alias("path"), text.alias("text"))


def _rows(df: DataFrame, id_col: str, parts: list[Column]) -> DataFrame:
    listed = F.filter(F.flatten(F.array(*parts)), lambda e: e["text"].isNotNull())
    return df.select(F.col(id_col), F.explode(listed).alias("e")).select(id_col, "e.path", "e.text")


_NONE = "array<struct<path:string,text:string>>"


def _strings(v: Column, name: str) -> Column:
    """A top-level string, or a list of strings."""
    many = F.transform(_get(v, f"$.{name}", "array<variant>"), lambda x, i: _entry(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")), _get(x, "$", "string")))
    return F.when(_is_list(v, f"$.{name}"), many).otherwise(F.array(_entry(F.lit(name), _get(v, f"$.{name}", "string"))))


def request_texts(df: DataFrame, body_col: str = "body", id_col: str = "request_id") -> DataFrame:
    """(id, path, text): message contents (strings, or the text parts of lists), system, prompt and input.

    Bodies that aren't JSON have no texts.
    """
    v = F.try_parse_json(body_col)

    def message(m: Column, i: Column) -> Column:
        at = F.concat(F.lit("messages["), i.cast("string"), F.lit("].content"))
        part = lambda p, j: _entry(F.concat(at, F.lit("["), j.cast("string"), F.lit("].text")), F.when(_get(p, "$.type", "string") == "text", _get(p, "$.text", "string")))
        return F.when(_is_list(m, "$.content"), F.transform(_get(m, "$.content", "array<variant>"), part)).otherwise(F.array(_entry(at, _get(m, "$.content", "string"))))

    messages = F.flatten(F.transform(F.coalesce(_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>")), message))
    return _rows(df, id_col, [messages, *[_strings(v, n) for n in ("system", "prompt", "input")]])


def response_texts(df: DataFrame, provider: str = "openai", body_col: str = "body", id_col: str = "response_id") -> DataFrame:
    """(id, path, text) of responses: openai, mistral and custom hold choices, anthropic content blocks."""
    v = F.try_parse_json(body_col)
    listed = lambda name: F.coalesce(_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    if provider == "anthropic":
        at = lambda i: F.concat(F.lit("content["), i.cast("string"), F.lit("].text"))
        parts = F.transform(listed("content"), lambda b, i: _entry(at(i), F.when(_get(b, "$.type", "string") == "text", _get(b, "$.text", "string"))))
        return _rows(df, id_col, [parts])
    at = lambda i, tail: F.concat(F.lit("choices["), i.cast("string"), F.lit(f"].{tail}"))
    chat = F.transform(listed("choices"), lambda c, i: _entry(at(i, "message.content"), _get(c, "$.message.content", "string")))
    legacy = F.transform(listed("choices"), lambda c, i: _entry(at(i, "text"), _get(c, "$.text", "string")))
    return _rows(df, id_col, [chat, legacy])


def stream_deltas(df: DataFrame, provider: str = "openai", chunk_col: str = "chunk") -> DataFrame:
    """`df` with `delta`, the text a chunk adds, or null."""
    v = F.try_parse_json(chunk_col)
    if provider == "anthropic":
        text = F.when((_get(v, "$.type", "string") == "content_block_delta") & (_get(v, "$.delta.type", "string") == "text_delta"), _get(v, "$.delta.text", "string"))
    else:
        text = _get(v, "$.choices[0].delta.content", "string")
    return df.withColumn("delta", text)


#: A step of a path: a quoted key in brackets, an index in brackets, or a plain key.
_STEP = re.compile(r"\['((?:[^'\\]|\\.)*)'\]|\[(\d+)\]|\.?([^.\[\]]+)")
_BLANK = re.compile(r"[ \t\n\r]*")
_skip = json.JSONDecoder().raw_decode


def _steps(path: str) -> list[str | int]:
    """Keys and indexes of a path like messages[0].content or ['a.b'].text."""
    return [int(m[2]) if m[2] is not None else m[3] if m[3] is not None else re.sub(r"\\(.)", r"\1", m[1]) for m in _STEP.finditer(path)]


def _after(body: str, at: int) -> int:
    return _BLANK.match(body, at).end()


def _place(body: str, steps: list[str | int]) -> tuple[int, int]:
    """Where the value at a path stands in a JSON text: [begin, end). KeyError if there is none. Of equal keys the last one counts."""
    at = _after(body, 0)
    for step in steps:
        if body[at] != ("[" if isinstance(step, int) else "{"):
            raise KeyError(step)
        found, n, at = None, 0, _after(body, at + 1)
        while body[at] not in "]}":
            key: str | int = n
            if not isinstance(step, int):
                key, at = json.decoder.scanstring(body, at + 1)
                at = _after(body, _after(body, at) + 1)
            if key == step:
                found = at
            at = _after(body, _skip(body, at)[1])
            if body[at] == ",":
                at = _after(body, at + 1)
            n += 1
        if found is None:
            raise KeyError(step)
        at = found
    return at, _skip(body, at)[1]


def _put(bodies: pd.Series, changes: pd.Series) -> pd.Series:
    def one(body, new):
        if body is None or new is None or not len(new):
            return body
        # from the back, so that places in front stay
        for (begin, end), text in sorted(((_place(body, _steps(c["path"])), c["text"]) for c in new), reverse=True):
            body = body[:begin] + json.dumps(text, ensure_ascii=False) + body[end:]
        return body

    return pd.Series([one(b, n) for b, n in zip(bodies, changes, strict=True)])


def set_texts(df: DataFrame, replacements: DataFrame, body_col: str = "body", id_col: str = "request_id") -> DataFrame:
    """`df` with the texts of `replacements` (id, path, text) put at their paths.

    Only the characters of these values change: numbers, blanks, escapes and unknown fields stay as they are written. A
    key with dots, brackets or quotes is written as ['key'] in a path. A path that a body doesn't have is an error. A null
    text becomes JSON's null.
    """
    changes = replacements.groupBy(id_col).agg(F.collect_list(F.struct("path", "text")).alias("_changes"))
    return df.join(changes, id_col, "left").withColumn(body_col, F.pandas_udf(_put, "string")(F.col(body_col), F.col("_changes"))).drop("_changes")
