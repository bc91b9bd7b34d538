"""The quality classifier: statistics and traversal against plain loops, accuracy on held-out labels."""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pallium.llm import boosted_quality as B
from pallium.llm.queries import op13_quality_classifier

SF = "/root/testdata/sf0.01"
rng = np.random.default_rng(12)
TEXTS = [None, "", " \n\t", "one", "a b a b a b a b\nA b!\nA b!\n", "É日 ## x9 ABC Abc, d. (e) don't\n\nlast", "same\n" * 50, "x" * 300_000, " ".join(f"w{i}" for i in rng.integers(0, 50, 3000))]


def test_statistics_against_plain_loops():
    got = B.statistics(pa.array(TEXTS, pa.string()))
    assert got.shape == (len(TEXTS), len(B.STATISTICS)) and np.isfinite(got).all()
    at = {n: i for i, n in enumerate(B.STATISTICS)}
    for text, row in zip(TEXTS, got):
        data = (text or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", data)
        if not w:
            assert not row.any()
            continue
        lines = [tuple(x) for x in (re.findall(rb"[^\x20\x09-\x0D]+", line) for line in data.split(b"\n")) if x]
        four = [tuple(w[i : i + 4]) for i in range(len(w) - 3)]
        want = {
            "share_upper": len(re.findall(b"[A-Z]", data)) / len(data), "share_digit": len(re.findall(b"[0-9]", data)) / len(data), "share_line": data.count(b"\n") / len(data),
            "share_other": sum(c > 127 or c < 9 for c in data) / len(data), "words": np.log1p(len(w)), "word_length": sum(map(len, w)) / len(w), "longest_word": np.log1p(max(map(len, w))),
            "distinct_words": len(set(w)) / len(w), "commonest_word": max(w.count(x) for x in set(w)) / len(w), "repeats_before": sum(a == b for a, b in zip(w, w[1:])) / len(w),
            "repeated_runs": sum(four.count(x) > 1 for x in four) / max(len(four), 1) if len(four) < 500 else None, "lines": np.log1p(len(lines)), "line_words": len(w) / len(lines),
            "repeated_lines": 1 - len(set(lines)) / len(lines), "longest_line": np.log1p(max(map(len, lines))), "no_letter": sum(not re.search(b"[A-Za-z]", x) for x in w) / len(w),
            "upper_words": sum(len(re.findall(b"[A-Z]", x)) > 1 and not re.search(b"[a-z]", x) for x in w) / len(w),
        }
        for name, value in want.items():
            assert value is None or row[at[name]] == pytest.approx(value), (name, text[:30])


def test_traversal_against_plain_recursion():
    x = rng.standard_normal((400, 6)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = B.fit(x, y, trees=25, depth=3)
    for row, score in zip(x, trees.margins(x)):
        total = trees.base
        for t in range(25):
            node = 0
            for level in range(3):
                at = 2**level - 1 + node
                node = 2 * node + int(row[trees.feature[t, at]] > trees.threshold[t, at])
            total += trees.leaf[t, node]
        assert score == pytest.approx(total)
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.98


def test_first_tree_is_the_best_by_brute_force():
    """The root of the first tree against all cuts of all features."""
    x = rng.standard_normal((300, 4))
    y = (x[:, 2] + 0.3 * rng.standard_normal(300) > 0.4).astype(float)
    trees = B.fit(x, y, trees=1, depth=1, bins=16)
    p = 1 / (1 + np.exp(-trees.base))
    g, w = p - y, np.full(300, p * (1 - p))
    gain = lambda s: g[s].sum() ** 2 / (w[s].sum() + B.RIDGE)
    best = max((gain(x[:, j] <= c) + gain(x[:, j] > c), j, c) for j in range(4) for c in np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1]) if 10 <= (x[:, j] <= c).sum() <= 290)
    assert (trees.feature[0, 0], trees.threshold[0, 0]) == best[1:]


def test_nulls_copies_and_missing_labels(spark):
    rows = [(i, t, f"l{i}", 0.5) for i, t in enumerate([*TEXTS, TEXTS[4], *[" ".join(f"w{k}" for k in rng.integers(0, 90, 60)) + (" ##$$ %%" * 9 if i % 2 else "") for i in range(120)]])]
    rows += [(None, TEXTS[4], None, None), (3, "other text of this id", "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, score double").repartition(4)
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in range(10, 130)] + [(11, 0), (None, 1)], "doc_id long, quality int")
    got = B.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    same = {r.score for r in got if r.doc_id in (4, len(TEXTS), None)}
    assert len(same) == 1, "equal texts have equal scores"
    # the labels of held-out rows don't matter
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    assert sorted(map(key, B.classify(docs, flipped).collect()), key=str) == sorted(map(key, got), key=str)
    assert {r.score for r in B.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert B.classify(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    got = op13_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    bad, good = ([r.predicted for r in got if r.quality == q] for q in (0, 1))
    assert len(bad) > 5 and sum(bad) <= 0.2 * len(bad) and sum(good) >= 0.98 * len(good)
