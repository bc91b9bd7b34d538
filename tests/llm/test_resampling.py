"""Importance resampling against plain loops."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from pallium.llm import resampling as R
from pallium.llm.session import numbered_in_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
rng = np.random.default_rng(5)
VOCAB = ["the", "Of", "là", "día", "Haus", "🎉", "x1", "don't", "a-b", "ÀB", *[f"w{i}" for i in range(60)]]
words = lambda n: " ".join(VOCAB[i] for i in rng.integers(0, len(VOCAB), n))
TEXTS = [None, "", " \t.\x00", "one", "two, words", "ab" * 90_000, "x" * 70_000 + " " + words(200), words(40_000), *[words(int(n)) for n in rng.integers(10, 80, 60)]]
TARGET = [None, "", *[words(30) for _ in range(5)], "the of the of the of w1 w2"]


def _features(text, buckets):
    w = WORD.findall((text or "").encode().lower().decode())
    return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:]))]]


def _plain(rows, target, buckets=10_000, share=25, least=20):
    found = [_features(t, buckets) for _, t in rows]
    s, t = (collections.Counter(b for _, f in x for b in f) for x in (found, [_features(t, buckets) for t in target]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (i, _), (n, f) in zip(rows, found):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, [r[0] for r in order[: share * len(order) // 100]]


def test_against_plain_loops(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, row string, weight int").repartition(5)
    target = spark.createDataFrame([(t, 3) for t in TARGET], "text string, buckets int")
    got = {r.doc_id: r for r in R.resample(docs, target).collect()}
    want, drawn = _plain(rows, TARGET)
    assert len(got) == len(rows) and {i: (r.n_features, r.weight, r.score) for i, r in got.items()} == {r[0]: r[2:] for r in want}
    assert [r.doc_id for r in sorted((r for r in got.values() if r.rank), key=lambda r: r.rank)] == drawn and len(drawn) > 10


def test_ties_nulls_and_empty_tables(spark):
    text = words(25)
    docs = spark.createDataFrame([(i, text) for i in [7, 7, 7, 3, None, None, 9, 9]], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    got = R.resample(docs, target, share=100).collect()
    assert sorted(r.rank for r in got) == list(range(1, 9)) and len({r.weight for r in got}) == 1
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.rank)]
    score = {r.doc_id: r.score for r in got}
    assert ordered == sorted(ordered, key=lambda i: -score[i])
    empty = R.resample(docs.limit(0), docs)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_longer_runs_and_block_borders(monkeypatch):
    text = " ".join(VOCAB[i] for i in rng.integers(0, 60, 300))
    w = WORD.findall(text.encode().lower().decode())
    want = collections.Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 97 for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for block in (1, 2, 5, 40, 10_000):
        monkeypatch.setattr(R, "BLOCK", block)
        n, found = R.Features(3, 97).of(text)
        assert n == len(w) and collections.Counter(found.tolist()) == want


def test_texts_like_the_target_are_drawn_more_often(spark):
    near, far = [" ".join(f"{k}{i}" for i in rng.integers(0, 50, 60)) for k in ["near"] * 300], [" ".join(f"far{i}" for i in rng.integers(0, 50, 60)) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(near + far)), "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(f"near{i}" for i in rng.integers(0, 50, 400)),)], "text string")
    drawn = R.resample(docs, target).filter("rank is not null")
    assert drawn.count() == 250 and drawn.filter("doc_id < 300").count() > 2 * 0.3 * 250, "an even draw would take three in ten"


def test_numbers_in_order(spark):
    df = spark.range(1000).repartition(7).withColumn("k", F.col("id") % 10)
    out = numbered_in_order(df, F.desc("k"), F.asc("id")).collect()
    assert [r.id for r in sorted(out, key=lambda r: r.place)] == sorted(range(1000), key=lambda i: (-(i % 10), i))
    assert sorted(r.place for r in out) == list(range(1000))
