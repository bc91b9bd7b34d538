"""Phrase collocations against plain counting."""

import collections
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pallium.llm.collocations import _counted, _grouped, _word_hashes, collocations, frequent_phrases, lockstep

rng = np.random.default_rng(9)
WORDS = ["the", "The", "of", "new", "york", "día", "日本", "a\x01b", "a", "b", "\x00", "x-y"]


def _text(n):
    out = "".join(WORDS[i] + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", ": \r"]) for i in np.minimum(rng.geometric(0.2, n) - 1, len(WORDS) - 1))
    return out


ROWS = [(None, "en"), ("", "en"), (" \t..", None), ("new york " * 40, None), ("one", "xx"), (_text(6000), "en"), *[(_text(int(n)), lang) for n, lang in zip(rng.integers(1, 60, 80), rng.choice(["en", "fr", ""], 80))], ("rare pair", "fr"), ("rare pair", "fr")]


def _plain(rows, longest, least, absorbed, top, scale):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").encode().lower().decode()):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    good = {k: v for k, v in f.items() if v >= least and len(k) > 2}
    gone = {(k[0], *k[i:j]) for k, v in good.items() for i in range(1, len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) - 1 and 100 * v >= absorbed * f[(k[0], *k[i:j])]}
    out = collections.defaultdict(list)
    for k, a in good.items():
        if k not in gone:
            score, _, left, right = min((scale * a // (f[k[:c]] + f[(k[0], *k[c:])]), c, f[k[:c]], f[(k[0], *k[c:])]) for c in range(2, len(k)))
            out[k[0]].append((-score, -a, " ".join(k[1:]).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])}


def test_against_plain_counting(spark):
    docs = spark.createDataFrame([(t, k, 1, 2) for t, k in ROWS], "text string, lang string, n int, size int").repartition(4)
    for args in (dict(longest=4, least=30, absorbed=80, top=2000), dict(longest=4, least=5, absorbed=40, top=7), dict(longest=2, least=3, absorbed=80, top=50), dict(longest=5, least=4, absorbed=60, top=500)):
        want = _plain(ROWS, scale=2_000_000, **args)
        assert {tuple(r) for r in collocations(docs, **args).collect()} == want and want


def test_small_blocks_and_a_full_bitmap_change_nothing(spark):
    docs = spark.createDataFrame([(t or "", k or "und") for t, k in ROWS], "text string, lang string").repartition(3)
    whole, totals = frequent_phrases(docs, 4, 5)
    want = {tuple(r) for r in whole.collect()}
    for bits, block in ((8, 64), (1 << 15, 1000), (1 << 20, 1 << 22)):
        again, n = frequent_phrases(docs, 4, 5, bits, block)
        assert {tuple(r) for r in again.collect()} == want and {tuple(r) for r in n.collect()} == {tuple(r) for r in totals.collect()}


def test_empty_tables_and_tables_without_languages(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations(none).count() == 0 and collocations(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    one = collocations(spark.createDataFrame([("new york. " * 30,)], "text string"))
    assert [tuple(r) for r in one.collect()] == [("und", 1, "new york", 30, 30, 30, 60, 1_000_000)]


def test_lockstep_hands_counts_from_range_to_range(spark):
    """One key is asked for by most rows, in many ranges; some keys are not in the stream."""
    stream = spark.createDataFrame([("a", 1), ("c", 3), ("d", 4)], "k string, v long")
    questions = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "c").when(F.col("id") % 10 == 7, "b").when(F.col("id") % 10 == 8, "d").otherwise("z").alias("k"), "id").repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = lockstep(stream, questions, ["k"], "v").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 5000 and all(r.v == {"c": 3, "d": 4}.get(r.k) for r in got)


def test_products_beyond_64_bits(spark):
    """A score of counts that no table here reaches, by the same expression."""
    df = spark.createDataFrame([(9 * 10**18, 5 * 10**18, 4 * 10**18)], "a long, l long, r long")
    assert df.select(F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").alias("s")).first().s == 2_000_000


def test_keys_are_grouped_as_np_unique_does():
    """Keys that fit beside their places into one number, keys that don't, and none; the packed sort is at hand for blocks."""
    rng = np.random.default_rng(8)
    for key in (rng.integers(0, 50, 1000), rng.integers(0, 1 << 50, 1000), rng.integers(0, 1 << 62, 1000) // 7 * 7, np.full(5, (1 << 62) + 1), np.zeros(0, dtype=np.int64)):
        for got, want in zip(_grouped(key), np.unique(key, return_index=True, return_inverse=True, return_counts=True)[1:], strict=True):
            assert np.array_equal(got, want)


def test_counts_are_shuffled_without_sizes(spark):
    """A phrase tells its size, so n-grams of several sizes are merged by language and phrase alone."""
    docs = spark.createDataFrame([("en", "a b c a b c")] * 3, "lang string, text string")
    counted = _counted(docs, (1,), [], 1 << 20)
    assert counted.columns == ["lang", "phrase", "n"]
    found, _ = frequent_phrases(docs, 3, 3)
    assert {(r.size, r.phrase, r.f) for r in found.collect()} == {(1, "a", 6), (1, "b", 6), (1, "c", 6), (2, "a b", 6), (2, "b c", 6), (2, "c a", 3), (3, "a b c", 6), (3, "b c a", 3), (3, "c a b", 3)}


def test_word_hashes_depend_on_language_and_word_alone():
    """The bitmap's rows and the blocks' words meet by these hashes, whatever lies around them; they are arrays, not Python lists."""
    words, langs = ["a", "b", "ab", "ba", "día", "\x00", "\x00\x00", "a" * 70_000, "a"], ["en", "en", "en", "en", "fr", "", "", "fr", "fr"]
    array = pa.array([w.encode() for w in words], pa.large_binary())
    whole = _word_hashes(pa.array(langs), array)
    assert len(set(whole.tolist())) == len(words) and whole.dtype == np.uint64
    for i in range(len(words)):
        for part in (array.slice(i, 1), array.take(pa.array([i]))):
            assert _word_hashes(pa.array(langs[i : i + 1]), part)[0] == whole[i]
    assert len(_word_hashes(pa.array([], pa.string()), array.slice(0, 0))) == 0
