"""Importance resampling of documents towards a target distribution, by hashed runs of words.

An untrained Split of the tokenizers library cuts ASCII-lowered texts into words with offsets. Windows of
neighbouring offset pairs are the features: runs of 1 to `longest` words, joined by one space, each dealt to a bucket
by its CRC-32. Texts are read once: the buckets of each document are written and then read twice, for the histogram
of all documents and for the sums of gains. The gain of a bucket compares its share of the target's features with its
share of the documents' features; a document's weight is the mean gain of its features. Gumbel noise from a hash of
the id turns taking the highest scores into drawing without replacement by weight.

What reaches the driver, and the tasks from there, is one number for each bucket.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from pallium.llm.session import numbered_in_order, stored
from pallium.llm.words import pieces

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Characters that are split at a time; a longer text is cut at the next character outside words.
BLOCK = 1 << 16


def _blocks(text: str):
    """Stretches of `text` that cut no word."""
    begin = 0
    while begin < len(text):
        gap = _GAP.search(text, begin + BLOCK) if begin + BLOCK < len(text) else None
        end = gap.end() if gap else len(text)
        yield text[begin:end]
        begin = end


class Features:
    """Buckets of the runs of 1 to `longest` words of a text."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.split = Split(Regex(WORD), "removed", invert=True)

    def words(self, text: str):
        """Words as UTF-8 of each block, by their offsets."""
        for block in _blocks(text.encode().lower().decode()):
            yield [block[begin:end].encode() for _, (begin, end) in self.split.pre_tokenize_str(block)]

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """(number of words, bucket of each run)."""
        n, out, before = 0, [], []
        for fresh in self.words(text or ""):
            n += len(fresh)
            words = before + fresh
            runs = [crc32(w) for w in words]
            for size in range(1, self.longest + 1):
                # runs within the words of the block before were counted there
                out.append(np.array(runs[max(len(before) - size + 1, 0) :], dtype=np.uint32))
                runs = [crc32(b" " + w, c) for c, w in zip(runs, words[size:])]
            before = words[len(words) - self.longest + 1 :] if len(words) >= self.longest else words
        return n, (np.concatenate(out) % self.buckets).astype(np.int32) if out else np.zeros(0, dtype=np.int32)


def bucketed(docs: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(id, row, n_words, buckets) of each row, written; `row` differs for all rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches):
        features = Features(longest, buckets)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                found = [features.of(t) for t in part.column("text").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(b) for _, b in found])])
                lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([b for _, b in found])))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([n for n, _ in found], pa.int64()), lists.cast(pa.list_(pa.int32()))], ["id", "n_words", "buckets"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(apply, f"id {kind}, n_words long, buckets array<int>").withColumn("row", F.monotonically_increasing_id()), "buckets")


def histogram(rows: DataFrame) -> DataFrame:
    """(bucket, n): features in each bucket. Counted before they are shuffled."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket; s and t are its counts, S and T their sums."""
    spark = documents.sparkSession
    counts = [histogram(x).withColumnRenamed("n", n) for x, n in ((documents, "s"), (target, "t"))]
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(counts[0], "bucket", "left").join(counts[1], "bucket", "left").fillna(0, ["s", "t"]).toArrow()
    order = np.argsort(both["bucket"].to_numpy())
    s, t = (both[n].to_numpy()[order].astype(np.float64) for n in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, row, n_words, n_features, weight): the floored mean gain of the features, 0 without any."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def apply(batches):
        for batch in batches:
            lists = batch.column("buckets")
            ends = lists.offsets.to_numpy()
            total = np.concatenate([[0], np.cumsum(shared.value[lists.values.to_numpy()[: ends[-1]]])])[ends]
            n, total = np.diff(ends).astype(np.int64), np.diff(total)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "row", "n_words")], pa.array(n), pa.array(total // np.maximum(n, 1))], ["id", "row", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "row", "n_words", "buckets").mapInArrow(apply, f"id {kind}, row long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """One row per row of `docs`: (id, n_features, weight, score, rank), all long but the id.

    `rank` numbers the drawn documents by falling score: `share` percent, rounded down, of those with `least_words`
    words or more. Other documents have a weight and a score and no rank. Equal scores go by id, null ids last, then as
    the rows lie. A null id is hashed as an empty string; rows with equal ids are drawn independently of each other, with
    equal noise. Null texts have no words: weight 0. Without target texts, or without documents, all buckets count as
    empty there. An empty table gives an empty result. Other columns are ignored.
    """
    rows, aims = (bucketed(d, i, t, longest, buckets) for d, i, t in ((docs, id_col, text_col), (target.withColumn("_no", F.lit(0)), "_no", target_col)))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = stored(_weighed(rows, gains(rows, aims, buckets)).withColumn("score", F.col("weight") + gumbel), "scores")
    ranked = numbered_in_order(scored.filter(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    drawn = share * ranked.count() // 100
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    out = ranked.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return out.unionByName(scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


ORACLE = r"""
WITH crcs AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), texts AS (
  SELECT 's' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), words AS (
  SELECT side, id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts
), runs AS (
  SELECT side, id, word, lead(word) OVER (PARTITION BY side, id ORDER BY i) AS after FROM words
), features AS (
  SELECT side, id, word AS f FROM runs UNION ALL SELECT side, id, concat(word, ' ', after) FROM runs WHERE after IS NOT NULL
), distinct_features AS (
  SELECT DISTINCT f, hex(encode(f)) AS h FROM features
), dealt AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM distinct_features, crcs
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM features JOIN dealt USING (f) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g FROM counts, totals
), weights AS (
  SELECT id, count(*) AS n, sum(g)::BIGINT AS total FROM features JOIN dealt USING (f) JOIN gain USING (bucket) WHERE side = 's' GROUP BY id
), scored AS (
  SELECT texts.id AS doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 ELSE floor(total::DOUBLE / n)::BIGINT END AS weight,
    ('0x' || substr(sha256(concat('7:', texts.id)), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN weights ON texts.id = weights.id WHERE side = 's'
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM noisy WHERE n_words >= 20
)
SELECT noisy.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END::BIGINT AS rank
FROM noisy LEFT JOIN ranked ON noisy.doc_id = ranked.doc_id
"""
