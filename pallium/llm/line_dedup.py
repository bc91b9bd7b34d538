"""Line dedup by a suffix array over sequences of line ids, in DataFrame expressions only.

A document is the sequence of its lines that hold a word. Lines that occur once end every repeat, so the suffixes
are those that begin with a repeated line, and each reaches to the end of its stretch of repeated lines. Prefix
doubling ranks them by their first 1, 2, 4, ... lines, until no rank is divided any more; suffixes that end before are
settled and leave the doubling. Then ranks are classes of equal stretches in the order of the suffix array. The longest
common prefix of two neighbouring classes follows from
the ranks of all levels, the longest first. Neighbours with a prefix of at least m lines form an interval, which is a
repeated run; in each interval, the suffix that comes first (by document, then line) is the original, and the m
lines of all others go. Overlapping and adjacent such stretches together are the later copies of the maximal runs.

Ranks are given to distinct keys, counted before they are sorted, and joined by join_by_hot_key: a line or run that a
third of all documents hold is one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pallium.llm.session import in_order, join_by_hot_key, numbered_in_order, stored, temporary_tables

WORD, BLANK = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: Neighbouring classes that one task numbers.
CHUNK = 1 << 16


def _has_words(text: Column, n: int) -> Column:
    """Whether there are at least n words. Looks no further than the n-th, and at no character twice."""
    return text.rlike(rf"\A{BLANK}*+(?:{WORD}++{BLANK}++){{{n - 1}}}{WORD}") if n > 0 else F.lit(True)


def document_lines(docs: DataFrame, most_words: int = 8) -> DataFrame:
    """(at, line, place, words, id) of `docs` (at, text): place counts all lines of the text, line those with a word.
    words is `most_words` for lines of so many words or more, and 0 for all others."""
    split = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("place"), x.alias("text")))
    held = docs.select("at", F.posexplode(F.filter(split, lambda x: F.ltrim(x["text"], F.lit(" \t\n\x0b\f\r")) != "")).alias("line", "l"))
    # two hashes make ids of distinct lines distinct; the second one's seed is the text in front
    id_ = F.struct(F.xxhash64("l.text").alias("a"), F.xxhash64(F.lit("line"), "l.text").alias("b"))
    return held.select("at", "line", "l.place", F.when(_has_words(F.col("l.text"), most_words), most_words).otherwise(0).alias("words"), id_.alias("id"))


def _ranked(rows: DataFrame, keys: list[str], least: int = 1) -> tuple[DataFrame, bool]:
    """(`rows` with `rank` instead of the keys, whether a rank was divided). Rows whose keys fewer than `least` rows share go.

    A rank is the number of rows with smaller keys. If the keys are head and tail, rows that share a head take the ranks from
    head on, so ranks of rows that aren't among these stay in order with them. Distinct keys are sorted by range and counted
    as they lie, which needs no single task; where a head begins that lies in several ranges is told by a row for each range.
    `rows` are stored.
    """
    shared = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    order = in_order(shared, *[F.col(k) for k in keys], name="keys-in-order")
    sizes = order.groupBy("chunk").agg(F.sum("n").alias("rows"))
    begin = sizes.select("chunk", F.coalesce(F.sum("rows").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("chunk").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = order.withColumn("inside", inside).join(F.broadcast(begin), "chunk").withColumn("rank", F.col("begin") + F.col("inside"))
    if "head" in keys:
        begun = ranks.withColumn("start", F.min("rank").over(W.partitionBy("chunk", "head")))
        last = begun.groupBy("chunk").agg(F.max(F.struct("head", "start")).alias("last"))
        earlier = last.groupBy(F.col("last.head").alias("head")).agg(F.min("last.start").alias("earlier"))
        ranks = begun.join(F.broadcast(earlier), "head", "left").withColumn("rank", F.col("head") + F.col("rank") - F.least("start", "earlier"))
    ranks = stored(ranks.select(F.struct(*keys).alias("key"), "rank", "n"), "ranks")
    divided = F.max(F.col("rank") > F.col("key.head")) if "head" in keys else F.lit(True)
    found = ranks.agg(divided.alias("divided"), F.sum("n").alias("n")).first()
    keyed = rows.withColumn("key", F.struct(*keys)).drop(*keys)
    return join_by_hot_key(keyed, ranks, "key", "n", found["n"] or 0).filter("rank is not null").drop("key"), bool(found["divided"])


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """Level k: (at, line, words, first, reach, span, rank) of suffixes that begin with a repeated line, by their first 2^k lines.

    `lines` (stored) has at, line, words and id. `first` is the rank of the first line, `reach` the number of lines
    up to the next line that occurs once, `span` that of the first suffix of its stretch. Suffixes of equal rank share
    min(2^k, reach) lines. Level k holds the stretches of 2^k lines or more: a suffix that reaches less far is settled, and its
    rank stays. Behind the levels comes a table of all suffixes with the ranks of whole suffixes.
    """
    shared, _ = _ranked(lines.select("at", "line", "words", "id"), ["id"], 2)
    by_line = W.partitionBy("at").orderBy("line")
    islands = stored(shared, "repeated-lines").withColumn("island", F.col("line") - F.row_number().over(by_line))
    stretch = W.partitionBy("at", "island")
    reach, span = F.max("line").over(stretch) - F.col("line") + 1, F.count(F.lit(1)).over(stretch)
    here, step = stored(islands.select("at", "line", "words", F.col("rank").alias("first"), reach.alias("reach"), span.alias("span"), "rank"), "level"), 1
    levels, left = [here], []
    most = here.agg(F.max("reach").alias("n")).first()["n"] or 0
    while step < most:
        tails = here.filter(F.col("span") > step).select("at", (F.col("line") - step).alias("line"), F.col("rank").alias("tail"))
        both = here.filter(F.col("reach") >= step).withColumnRenamed("rank", "head").join(tails, ["at", "line"], "left")
        both = both.withColumn("tail", F.when(F.col("reach") > step, F.col("tail")).otherwise(-1))
        ranked, divided = _ranked(stored(both, "pairs-of-ranks"), ["head", "tail"])
        if not divided:
            break
        every, step = stored(ranked.unionByName(here.filter(F.col("reach") < step)), "level"), 2 * step
        left.append(every.filter(F.col("span") < step))
        here = every.filter(F.col("span") >= step)
        if step <= most:
            levels.append(here)
    whole = here
    for x in left:
        whole = whole.unionByName(x)
    return [*levels, stored(whole, "whole-suffixes") if left else whole]


def suffix_classes(levels: list[DataFrame]) -> DataFrame:
    """(rank, i, n, reach, first, origin, common): the suffix array by classes of equal suffixes.

    `i` is a class' place in the array, `n` its number of suffixes, `origin` the first of them (at, line), and
    `common` the longest common prefix with the class before, in lines.
    """
    classes = levels[-1].groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.first("reach").alias("reach"), F.first("first").alias("first"), F.min(F.struct("at", "line")).alias("origin"))
    classes = stored(numbered_in_order(classes, F.col("rank")).withColumnRenamed("place", "i"), "classes")
    before = classes.select((F.col("i") + 1).alias("i"), F.col("origin").alias("other"), F.col("first").alias("other_first"), F.col("reach").alias("other_reach"))
    alike = classes.join(before, "i").filter("first = other_first").select("i", F.col("origin.at").alias("a"), F.col("origin.line").alias("p"), F.col("other.at").alias("b"), F.col("other.line").alias("q"), F.least("reach", "other_reach").alias("left"), F.lit(0).alias("common"))
    alike, pairs = stored(alike, "neighbours"), None
    # different classes that share 2^k more lines both reach so far, so each level meets the pairs and suffixes that do
    for k in reversed(range(len(levels) - 1)):
        size = 1 << k
        entering = alike.filter(F.col("left") >= size) if pairs is None else alike.filter((F.col("left") >= size) & (F.col("left") < 2 * size))
        pairs = entering if pairs is None else pairs.unionByName(entering)
        there = levels[k].filter(F.col("reach") >= size)
        x = there.select(F.col("at").alias("a"), F.col("line").alias("x"), F.col("rank").alias("rx"))
        y = there.select(F.col("at").alias("b"), F.col("line").alias("y"), F.col("rank").alias("ry"))
        ready = pairs.filter(F.col("left") >= size).withColumns({"x": F.col("p") + F.col("common"), "y": F.col("q") + F.col("common")})
        more = F.when(F.col("rx") == F.col("ry"), size).otherwise(0)
        met = ready.join(x, ["a", "x"]).join(y, ["b", "y"]).withColumns({"left": F.col("left") - more, "common": F.col("common") + more})
        pairs = stored(met.select(*alike.columns).union(pairs.filter(F.col("left") < size)), "common-prefixes")
    return stored(classes.join(pairs.select("i", "common"), "i", "left").fillna({"common": 0}), "suffix-array")


def _intervals(classes: DataFrame, length: int) -> DataFrame:
    """(rank, n, original): for each class of at least `length` lines, the first suffix of its interval."""
    chunk = F.floor(F.col("i") / CHUNK)
    inside = W.partitionBy("chunk").orderBy("i")
    counted = classes.filter(F.col("reach") >= length).withColumn("chunk", chunk).withColumn("interval", F.sum((F.col("common") < length).cast("long")).over(inside))
    ends = counted.groupBy("chunk").agg(F.max("interval").alias("n")).select("chunk", F.coalesce(F.sum("n").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = stored(counted.join(ends, "chunk").select("rank", "n", "origin", (F.col("before") + F.col("interval")).alias("interval")), "intervals")
    originals = stored(placed.groupBy("interval").agg(F.min("origin").alias("original"), F.count(F.lit(1)).alias("classes")), "originals")
    return stored(join_by_hot_key(placed, originals, "interval", "classes").select("rank", "n", "original"), "originals-of-classes")


def repeated_runs(levels: list[DataFrame], classes: DataFrame) -> DataFrame:
    """(at, line, length) of the longest repeated run that begins at each suffix: that of the longer of its two common
    prefixes, or all of it if there is an equal one. A run that begins within a longer one isn't left out."""
    behind = classes.select((F.col("i") - 1).alias("i"), F.col("common").alias("next"))
    longest = classes.join(behind, "i", "left").select("rank", "n", F.greatest("common", F.coalesce("next", F.lit(0)), F.when(F.col("n") > 1, F.col("reach")).otherwise(0)).alias("length"))
    return join_by_hot_key(levels[-1].select("at", "line", "rank"), stored(longest, "longest-runs"), "rank", "n").select("at", "line", "length")


def repeated_lines(levels: list[DataFrame], classes: DataFrame, min_lines: int = 2, alone_words: int = 8) -> DataFrame:
    """(at, line) of all lines in later copies of runs of `min_lines` lines, or of one line of `alone_words` words."""
    gone = None
    for length, words in dict.fromkeys([(1, alone_words if min_lines > 1 else 0), (min_lines, 0)]):
        rows = levels[-1].filter((F.col("reach") >= length) & (F.col("words") >= words)).select("at", "line", "rank")
        later = join_by_hot_key(rows, _intervals(classes, length), "rank", "n").filter(F.struct("at", "line") > F.col("original"))
        later = later.select("at", F.explode(F.sequence("line", F.col("line") + (length - 1))).alias("line"))
        gone = later if gone is None else gone.union(later)
    return stored(gone.distinct(), "later-copies")


def _kept_runs(places: Column) -> Column:
    """Runs (from, length) of lines between the sorted places that go; the last one is open-ended."""
    ends = F.concat(F.array(F.lit(-1)), places)
    return F.filter(
        F.transform(ends, lambda p, i: F.struct((p + 2).alias("from"), (F.coalesce(F.get(places, i), F.lit(2_000_000_000)) - p - 1).alias("length"))),
        lambda r: r["length"] > 0,
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` (doc, text) with `at`, which differs for all rows and follows the order of doc: doc itself, if that does."""
    if docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc is null").isEmpty():
        return docs.withColumn("at", F.col("doc"))
    return stored(docs.orderBy("doc", F.xxhash64("text"), F.rand(3)).withColumn("at", F.monotonically_increasing_id()), "numbered-documents")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, alone_words: int = 8, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: (id, n_lines, n_removed, longest_run, kept_text), then the columns `also` of it.

    Lines end at a line feed and compare byte by byte. A line goes if it lies in a later copy of a repeated
    run of at least `min_lines` lines with a word, or is itself a later copy of a line of `alone_words` words
    or more. Lines without a word belong to no run and stay. Copies are ordered by (id, line), null ids first. n_lines
    counts all lines; longest_run is the length of the longest run in the document, in lines with a word, that occurs
    elsewhere or again, wherever it is the original too. Null texts are empty: one line, nothing removed. Rows with
    equal or null ids are documents of their own, in the order of their texts' hashes. An empty table gives an empty
    result; other columns are ignored. Texts are shuffled once, at every size: what goes is as large a table as the documents are many.
    """
    carried = F.struct(*also) if also else F.lit(0)
    docs = _numbered(docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), carried.alias("also")))
    with temporary_tables(docs.sparkSession):
        lines = stored(document_lines(docs, alone_words), "lines")
        levels = suffix_levels(lines)
        classes = suffix_classes(levels)
        gone = lines.select("at", "line", "place").join(repeated_lines(levels, classes, min_lines, alone_words), ["at", "line"])
        runs = repeated_runs(levels, classes).select("at", F.lit(None).cast("int").alias("place"), "length")
        found = gone.select("at", "place", F.lit(0).alias("length")).union(runs).groupBy("at").agg(F.array_sort(F.collect_set("place")).alias("places"), F.max("length").alias("longest"))
        found = stored(found, "lines-that-go", keep=True)
    joined = docs.join(found.hint("merge"), "at", "left")
    split, places = F.split("text", "\n", -1), F.coalesce(F.col("places"), F.array().cast("array<int>"))
    kept = F.transform(F.array(split), lambda x: F.array_join(F.flatten(F.transform(_kept_runs(F.col("places")), lambda r: F.slice(x, r["from"], r["length"]))), "\n"))[0]
    return joined.select(
        F.col("doc").alias(id_col),
        F.size(split).cast("long").alias("n_lines"),
        F.size(places).cast("long").alias("n_removed"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
        F.when(F.size(places) == 0, F.col("text")).otherwise(kept).alias("kept_text"),
        *[F.col("also")[c].alias(c) for c in also],
    )


ORACLE = """
WITH RECURSIVE every AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), lines AS (
  SELECT doc_id, place, t, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS line
  FROM every WHERE regexp_matches(t, '[^\\x20\\x09-\\x0D]')
), pairs AS (
  SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY place) AS t2 FROM lines
), later AS (
  SELECT doc_id, line, words >= 8 AND row_number() OVER (PARTITION BY t ORDER BY doc_id, line) > 1 AS alone,
    t2 IS NOT NULL AND row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, line) > 1 AS paired
  FROM pairs
), gone AS (
  SELECT doc_id, line FROM later WHERE alone OR paired
  UNION SELECT doc_id, line + 1 FROM later WHERE paired
), hashed AS (
  SELECT doc_id, line, md5(t) AS h FROM lines
), runs AS (
  SELECT doc_id, line, 1 AS n, h FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM hashed) WHERE c > 1
  UNION ALL
  SELECT doc_id, line, n, h FROM (
    SELECT r.doc_id, r.line, r.n + 1 AS n, md5(concat(r.h, l.h)) AS h, count(*) OVER (PARTITION BY md5(concat(r.h, l.h))) AS c
    FROM runs r JOIN hashed l ON l.doc_id = r.doc_id AND l.line = r.line + r.n) WHERE c > 1
), longest AS (
  SELECT doc_id, max(n) AS longest FROM runs GROUP BY doc_id
), marked AS (
  SELECT e.doc_id, e.place, e.t, g.line IS NOT NULL AS removed
  FROM every e LEFT JOIN lines l ON e.doc_id = l.doc_id AND e.place = l.place
  LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line
)
SELECT m.doc_id, count(*) AS n_lines, count_if(removed)::BIGINT AS n_removed, coalesce(any_value(longest), 0)::BIGINT AS longest_run,
  sha256(coalesce(string_agg(t, chr(10) ORDER BY place) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM marked m LEFT JOIN longest g ON m.doc_id = g.doc_id GROUP BY m.doc_id
"""
