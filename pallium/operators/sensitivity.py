"""Sensitivity of texts from the types found in them, and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pallium.functions import patterns as P


def base_score(types: Column) -> Column:
    """Sum of the weights of an array of types, repeats included."""
    weights = F.create_map(*[F.lit(x) for p in P.WEIGHTS.items() for x in p])
    return F.aggregate(types, F.lit(0.0), lambda a, t: a + F.coalesce(F.element_at(weights, t), F.lit(P.OTHER_WEIGHT)))


def _holds(types: Column, group: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, group)), types)) == 0


def correlate(score: Column, types: Column) -> Column:
    for group, factor in P.CORRELATED:
        score = score * F.when(_holds(types, group), factor).otherwise(1.0)
    return score


def sensitivity(types: Column, threshold: float = P.SENSITIVE) -> Column:
    """Struct (score in 0..1, reasons) of an array of types, one for each span; a score from `threshold` on is a reason."""
    distinct = F.array_distinct(types)
    n = F.size(distinct)
    score = F.least(correlate(base_score(types), distinct) * F.when(n >= 4, 1.2).otherwise(1.0), F.lit(1.0))
    reasons = [F.when(_holds(distinct, g), F.lit(f"{' + '.join(g)}: {f}x")) for g, f in P.CORRELATED]
    reasons.append(F.when(n >= 4, F.concat(n.cast("string"), F.lit(" types: 1.2x"))))
    reasons.append(F.when(score >= threshold, F.concat(F.lit("score "), F.format_number(score, 2), F.lit(f" >= {threshold}"))))
    return F.struct(score.alias("score"), F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"))


def route(score: Column, threshold: float = P.SENSITIVE, local_available: bool = False) -> Column:
    """local for sensitive texts if there is a local model, else external."""
    return F.when((score >= threshold) & F.lit(local_available), "local").otherwise("external")


def most_sensitive(df: DataFrame, k: int, score_col: str = "score", by: list[str] | None = None, ties: str = "doc_id") -> DataFrame:
    """The k rows of highest score, overall or for each `by`; ties go to the smaller `ties`."""
    order = [F.desc(score_col), F.asc(ties)]
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
