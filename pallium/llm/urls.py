"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions and Spark ML's tree learner; no Python runs on executors.

A suffix is one to three last labels of a host, never the whole host, and its statistic is the rate of bad labels
among hosts of the other fold: hosts are dealt into two folds, so neither a row's label nor its host's ever enters
its own features, in training as in scoring. The trees thus learn what carries over to hosts that no label knows.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.llm.session import join_by_hot_key, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most labelled rows that the trees are fitted on.
LABELLED_ROWS = 200_000
#: Weight of the overall rate in a suffix's rate of bad labels, in rows.
PRIOR_ROWS = 5.0

# Host words of the categories that public block lists share (gambling, pharmacy, adult, spam, tracking).
BAD_HOST_WORDS = ["ads", "adult", "bet", "bets", "casino", "cheap", "click", "escort", "farm", "loan", "loans", "pills", "poker", "porn", "pharma", "sex", "slots", "spam", "track", "tracker", "viagra", "win", "xxx"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both '' for a null url or one without ://."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(text)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Rules: ('block', 'net/'), ...

    The rule list is part of the plan: meant for up to some hundred rules.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + tail)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1))
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n))
    return -F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "length": F.length(text),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")),
        "labels": F.regexp_count(host, F.lit(r"[^.]+")),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "digit_ratio": _share(text, "[0-9]"),
        "host_digit_ratio": _share(host, "[0-9]"),
        "entropy": _entropy(host),
        "parameters": F.regexp_count(query, F.lit("[^&]+")),
        "has_fragment": text.contains("#").cast("int"),
        "is_https": text.startswith("https:").cast("int"),
    }


SUFFIXES = (1, 2, 3)
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "host_digit_ratio", "entropy", "parameters", "has_fragment", "is_https", *[f"suffix_{k}" for k in SUFFIXES]]


def _suffixes(host: Column, fold: Column) -> Column:
    """Structs (k, key): the last k labels of a host that has more than k, with a fold in front."""
    listed = [F.when(F.regexp_count(host, F.lit(r"[.]")) >= k, F.struct(F.lit(k).alias("k"), F.concat_ws("|", fold.cast("string"), F.substring_index(host, ".", -k)).alias("key"))) for k in SUFFIXES]
    return F.filter(F.array(*listed), lambda s: s.isNotNull())


def _fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host, F.lit("fold")), F.lit(2))


def features(urls: DataFrame) -> DataFrame:
    """`urls` (columns id, url, host, path) with lexical features; suffix statistics are joined later."""
    return urls.select("*", *[c.cast("double").alias(n) for n, c in lexical_features(F.col("url"), F.col("host"), F.col("path")).items()])


def _with_suffix_rates(rows: DataFrame, rates: DataFrame, prior: float) -> DataFrame:
    """`rows` with suffix_1, ...: rates are joined to the distinct hosts' suffixes, and these to the rows."""
    hosts = stored(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    listed = stored(hosts.select("host", F.explode(_suffixes(F.col("host"), _fold(F.col("host")))).alias("s")).select("host", "s.k", "s.key"), "suffixes")
    weights = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rated = join_by_hot_key(listed, weights.join(rates, "key"), "key", "n")
    by_host = rated.groupBy("host").agg(*[F.max(F.when(F.col("k") == k, F.col("rate"))).alias(f"suffix_{k}") for k in SUFFIXES])
    return join_by_hot_key(rows, hosts.join(by_host, "host", "left"), "host", "n").fillna(prior, [f"suffix_{k}" for k in SUFFIXES])


class UrlModel:
    """Rates of bad labels by suffix and fold, and trees."""

    def __init__(self, rates: DataFrame | None, prior: float, trees: Model | None):
        self.rates, self.prior, self.trees = rates, prior, trees

    def scored(self, rows: DataFrame) -> DataFrame:
        """`rows` (from features(), stored) with `score`, the probability of being bad; without trees it is null."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(None).cast("double"))
        full = _with_suffix_rates(rows, self.rates, self.prior)
        out = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full))
        return out.withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def fit(rows: DataFrame, label: Column, most_rows: int = LABELLED_ROWS, iterations: int = 20, depth: int = 4) -> UrlModel:
    """Fit on `rows` (from features()); label: 1 bad, 0 good, null unlabelled.

    If there are more labelled rows than `most_rows`, a sample by hash of about that size is used for the
    trees; suffix rates count all labelled rows. With labels of one kind only, or none, there are no trees.
    """
    known = stored(rows.withColumn("label", label.cast("double")).filter("label is not null"), "labelled-urls")
    total = known.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).first()
    if not total["rate"] or total["rate"] == 1:
        return UrlModel(None, total["rate"] or 0.0, None)
    # a host looks up the rates under its own fold, so they are counted under the other one
    keys = F.explode(_suffixes(F.col("host"), 1 - _fold(F.col("host")))).alias("s")
    rates = known.select("label", keys).groupBy("s.key").agg(((F.sum("label") + PRIOR_ROWS * total["rate"]) / (F.count(F.lit(1)) + PRIOR_ROWS)).alias("rate"))
    rates, share = stored(rates, "suffix-rates"), most_rows / total["n"]
    some = known.filter(F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known
    train = stored(_with_suffix_rates(some, rates, total["rate"]), "training-urls")
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=iterations, maxDepth=depth, seed=7, maxBins=32)
    return UrlModel(rates, total["rate"], trees.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train)))


def seed_labels(host: Column) -> Column:
    """Labels without a labelled table: 1 if the host has one of BAD_HOST_WORDS as a word, else 0; no host: null."""
    return F.when(host == "", None).otherwise(F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, BAD_HOST_WORDS))).cast("int"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", labels: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of `pages`: (id, host, path, rule, verdict, score).

    verdict: that of the longest rule that fits, else block if the trees' score is at least `threshold`, else
    allow. `labels` is an expression over url, host and path (1 bad, 0 good, null none); by default
    seed_labels(host), an assumption that stands in for labelled urls where there are none. Null urls and urls without :// have an empty host and path, no rule, and are judged by
    the trees. Without trees (an empty table, or labels of one kind) the verdict is allow. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = stored(features(rows.withColumns({"host": host, "path": path})), "url-features")
    model = fit(rows, seed_labels(F.col("host")) if labels is None else labels)
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    out = model.scored(rows).withColumn("r", rule)
    verdict = F.coalesce("r.verdict", F.when(F.col("score") >= threshold, "block"), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")
