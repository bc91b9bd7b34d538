"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Every rule rejects a text whose signal exceeds a cutoff. Cutoffs are chosen on labelled rows: for each
stratum and rule, the candidates are tested on the stratum's good rows, and a cutoff is allowed only if the
exact binomial (Clopper-Pearson) upper bound of its false rejection rate is at most `alpha / rules`. So all
rules together reject at most `alpha` of the good texts of a stratum. The confidence `1 - delta` is shared by
all rules of all strata (Bonferroni); the cutoffs of one rule are tested from the laxest on until one fails, and as
a stricter one rejects whatever a laxer one does, that sequence needs no further share. Of the allowed cutoffs the one that rejects most labelled bad rows is
taken, provided it rejects over twice the share of the bad that it rejects of the good; without one, the rule is off in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.llm.session import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Rules: signals of the base columns, each of which grows as texts get worse, and their candidate cutoffs.
CUTOFFS = {
    "symbol_ratio": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2],
    "repeat_word_ratio": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25],
    "upper_ratio": [0.2, 0.3, 0.5, 0.7],
    "exclaim_ratio": [0.05, 0.1, 0.2, 0.4],
    "word_length": [8.0, 10.0, 12.0, 15.0],
}


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Number of words in windows of eight words that occur twice or more in the text."""

    def tail(h: Column, by: int) -> Column:
        return F.slice(h, F.lit(by + 1), F.greatest(F.size(h) - by, F.lit(0)))

    def pair(h: Column, by: int) -> Column:
        # hashes of runs of `by` words make those of 2 * by; zip_with pads the shorter side with nulls
        return _bind(h, lambda x: F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - by, F.lit(0))), tail(x, by), lambda a, b: F.xxhash64(a, b)))

    def covered(h: Column) -> Column:
        spots = _bind(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.array_sort(
                F.filter(
                    F.transform(
                        s,
                        lambda x, k: F.when(
                            ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
                            x["i"],
                        ),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
        )
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(spots, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    eight = pair(pair(pair(hashed, 1), 2), 4)
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(_bind(eight, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def text_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: str | None = "lang") -> DataFrame:
    """One row per row of `docs`: id, stratum, the base columns n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (long), base_failed, and the rules' signals (double).

    Null text: no words, zero counts, base_failed. A null stratum, or a table without that column, is the stratum ''.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stratum = F.coalesce(F.col(strata).cast("string"), F.lit("")) if strata in docs.columns else F.lit("")
    base = docs.select(F.col(id_col).alias("id"), stratum.alias("stratum"), text.alias("text"))
    measured = base.select(
        "id",
        "stratum",
        _bind(
            F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
        ).alias("w"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _bind(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("exclaim"),
    )
    n, chars = F.greatest(F.col("w.n_words"), F.lit(1)), F.greatest("word_chars", F.lit(1))
    return measured.select(
        F.col("id").alias(id_col),
        "stratum",
        F.col("w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        ((F.col("w.n_words") < 20) | (100 * F.col("w.n_repeat_words") > 30 * F.col("w.n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_ratio"),
        (F.col("w.n_repeat_words") / n).alias("repeat_word_ratio"),
        (F.col("upper") / chars).alias("upper_ratio"),
        (F.col("exclaim") / n).alias("exclaim_ratio"),
        (F.col("word_chars") / n).alias("word_length"),
    )


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method; it converges fast for x < (a + 1) / (a + b + 2)."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p). The upper bound of k of n is at most p where this is at most delta.

    It is the regularised incomplete beta function of (n - k, k + 1) at 1 - p: work and memory don't grow with k.
    """
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def allowed_rejections(n: int, p: float, delta: float) -> int:
    """The most false rejections among n good rows that still prove a rate of at most p; -1 if none do."""
    if n == 0 or n * math.log1p(-p) > math.log(delta):
        return -1
    low, high = 0, math.ceil(n * p)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if binomial_tail(mid, n, p) <= delta else (low, mid - 1)
    return low


def _choose(counts: dict[str, int], limit: int) -> dict[str, float]:
    """Per rule, the allowed cutoff that rejects most bad rows, if it rejects over twice the share of the good."""
    good, bad, chosen = max(counts["n_1"], 1), max(counts["n_0"], 1), {}
    for rule, cuts in CUTOFFS.items():
        fit = [(b, -g, c) for i, c in enumerate(cuts) if (g := counts[f"{rule}_{i}_1"]) <= limit and (b := counts[f"{rule}_{i}_0"]) * good > 2 * g * bad]
        if fit:
            chosen[rule] = max(fit)[2]
    return chosen


def fit_cutoffs(signals: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = 0.05, delta: float = 0.05) -> dict[str, dict[str, float]]:
    """{stratum: {rule: cutoff}} from all labelled rows; rows that fail the base rules take no part.

    Labels: 1 good, 0 bad; null labels are ignored, and repeated ids count once, as good if any label says so.
    A stratum that has too few good labels to prove any cutoff has none. Such a proof takes a number of good labels
    that is known beforehand, so the driver holds a row of counts for each of at most (labels / that number) strata.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_good"))
    rows = signals.filter(~F.col("base_failed")).join(known, id_col)
    counts = [F.count_if(F.col("_good") == g).alias(f"n_{g}") for g in (0, 1)]
    for rule, cuts in CUTOFFS.items():
        counts += [F.count_if((F.col("_good") == g) & (F.col(rule) > c)).alias(f"{rule}_{i}_{g}") for i, c in enumerate(cuts) for g in (0, 1)]
    by_stratum = stored(rows.groupBy("stratum").agg(*counts), "labelled-counts")
    # all strata and rules share delta, whether they can prove anything or not
    share = delta / (max(by_stratum.count(), 1) * len(CUTOFFS))
    least, out = math.log(share) / math.log1p(-alpha / len(CUTOFFS)), {}
    for s in by_stratum.filter(F.col("n_1") >= least).toLocalIterator():
        limit = allowed_rejections(s["n_1"], alpha / len(CUTOFFS), share)
        if limit >= 0:
            out[s["stratum"]] = _choose(s.asDict(), limit)
    return out


def apply_cutoffs(signals: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """`signals` with `failed_rules` (array of strings) and `kept`: no base failure and no failed rule."""
    failed = []
    for rule in CUTOFFS:
        cut = F.lit(None).cast("double")
        for value in sorted({c[rule] for c in cutoffs.values() if rule in c}):
            cut = F.when(F.col("stratum").isin([s for s, c in cutoffs.items() if c.get(rule) == value]), F.lit(value)).otherwise(cut)
        failed.append(F.when(F.col(rule) > cut, F.lit(rule)))
    out = signals.withColumn("failed_rules", F.filter(F.array(*failed), lambda x: x.isNotNull()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: str | None = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per row of `docs`: id, the base columns, base_failed, failed_rules and kept.

    Signals are computed once for all texts and written; cutoffs come from the labelled rows among them.
    Strata with too few labels to prove anything, and all if there are no labels, have the base rules alone. An empty `docs` gives an empty result.
    """
    signals = stored(text_signals(docs, id_col, text_col, strata), "signals")
    judged = apply_cutoffs(signals, fit_cutoffs(signals, labels, id_col, "quality", alpha, delta))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept")
