"""Detection of personal data in a text column."""

from __future__ import annotations

import functools
import logging

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.functions import patterns as P
from pallium.functions.recognizers import PythonRecognizer, Recognizer, ranked, select_recognizers
from pallium.functions.spans import EMPTY, FIELDS, bound, fold_overlaps

log = logging.getLogger(__name__)


def above_threshold(spans: Column, threshold: float = P.CONFIDENCE) -> Column:
    return F.filter(spans, lambda s: s["score"] >= threshold)


def boost_locale(spans: Column, boost: float = P.LOCALE_BOOST) -> Column:
    """Spans of a certain locale score `boost` more, at most 1."""

    def more(s: Column) -> Column:
        score = F.least(s["score"] + boost, F.lit(1.0))
        changed = {"minus_score": -score, "score": score}
        return F.when(s["locale"] == "universal", s).otherwise(F.struct(*[changed.get(c, s[c]).alias(c) for c in FIELDS]))

    return F.transform(spans, more)


def resolve_overlaps(spans: Column) -> Column:
    return fold_overlaps(spans)


def all_spans(text: Column, recognizers: list[Recognizer], threshold: float = P.CONFIDENCE) -> list[Column]:
    """Per recognizer, its deduplicated spans above the threshold."""
    return [above_threshold(r.recognize(text, rank), threshold) for rank, r in ranked(recognizers)]


@functools.lru_cache(512)
def _recognized(application: str, text_col: str, recognizer: Recognizer, rank: int, threshold: float) -> Column:
    """The spans' expression. An application parses it once."""
    return bound(F.coalesce(F.col(text_col), F.lit("")), "t", f"filter({recognizer.sql(rank)}, s -> s.score >= {float(threshold)}D)")


def detect(df: DataFrame, text_col: str = "text", locales: list[str] = P.LOCALES, threshold: float = P.CONFIDENCE, extra: list[Recognizer] = (), python: list[PythonRecognizer] = ()) -> DataFrame:
    """`df` with `spans`, the resolved spans of its text; null texts have none.

    Every recognizer gets a column of its own, then one array joins them: no shuffle and no Python. Write or
    persist the result if several steps read the spans, as Spark would run the expressions for each.
    With `python` recognizers there is a column `errors` too: the names of those that failed on a row. Their
    ranks lie behind all others of the same priority.
    """
    for name in sorted(set(locales) - set(P.LOCALES)):
        log.warning("no recognizers for locale %s", name)
    text, application = F.coalesce(F.col(text_col), F.lit("")), SparkContext.getOrCreate().applicationId
    chosen = [*select_recognizers(locales, extra), *python]
    parts, run = {}, {}
    for rank, r in ranked(chosen):
        if isinstance(r, PythonRecognizer):
            run[f"_python_{rank}"] = (r, r.apply(text, rank))
        else:
            parts[f"_spans_{rank}"] = _recognized(application, text_col, r, rank, threshold)
    found = df.withColumns(parts | {n: c for n, (_, c) in run.items()}) if parts or run else df
    arrays = [F.col(n) for n in parts] + [above_threshold(fold_overlaps(F.col(f"{n}.spans")), threshold) for n in run]
    out = found.withColumn("spans", resolve_overlaps(boost_locale(F.concat(*arrays) if arrays else F.array().cast(EMPTY))))
    if run:
        failed = F.array(*[F.when(F.col(f"{n}.error"), F.lit(r.name)) for n, (r, _) in run.items()])
        out = out.withColumn("errors", F.filter(failed, lambda e: e.isNotNull()))
    return out.drop(*parts, *run)


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as the session has cores: a table of few files or row groups would be detected by few tasks.

    Texts are small beside the work on them. Larger tables have more partitions anyway, and stay as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def detections(df: DataFrame, keys: list[str], spans_col: str = "spans") -> DataFrame:
    """Long form: a row per span with keys, entity_type, start, end, score, text, locale.

    Outer, then filtered: for a plain explode, Spark would run the recognizers once more to skip empty arrays.
    """
    return df.select(*keys, F.explode_outer(spans_col).alias("s")).filter("s is not null").select(*keys, *[F.col(f"s.{c}").alias(c) for c in ("entity_type", "start", "end", "score", "text", "locale")])
