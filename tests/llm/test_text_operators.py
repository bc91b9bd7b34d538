"""Operators on documents against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import os
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pallium.llm import line_dedup as LD
from pallium.llm import near_dedup
from pallium.llm import quality as Q
from pallium.llm import simhash as S
from pallium.llm.bpe import Encoder, decode, encode, encode_and_decode, read_tokenizer
from pallium.llm.components import connected_components
from pallium.llm import lm
from pallium.llm.lm import score
from pallium.llm.near_dedup import near_duplicate_groups
from pallium.llm.packing import best_fit, pack
from pallium.llm.session import join_by_hot_key
from pallium.llm.substring_dedup import substring_dedup

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(3)
VOCAB = ["the", "of", "a", "là", "día", "Haus", "🎉", "x1", *[f"w{i}" for i in range(60)]]
PASSAGE = " ".join(VOCAB[i] for i in rng.integers(0, 60, 50))


def _words(n):
    return " ".join(VOCAB[i] for i in rng.integers(0, len(VOCAB), n))


TEXTS = [
    None, "", "  \t\n ", "one", "two  words\n", *[_words(int(n)) for n in rng.integers(3, 120, 24)],
    _words(30) + "\n" + PASSAGE + "\n" + _words(20), PASSAGE + "\n" + _words(9) + "\n" + PASSAGE, PASSAGE, PASSAGE, "a" * 5000 + " <|endoftext|> don't", "a b " * 60,
    "line one of some eight words or even more\nshort\nline two\n\nline three\nend", "other start\nshort\nline two\nline three\nend\nline one of some eight words or even more", "same\nsame\nsame\nsame",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i % 3, "en", i, True) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, lang string, token int, fp boolean").repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_substring_dedup(docs, empty):
    words = {i: WORD.findall(t or "") for i, t in enumerate(TEXTS)}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    first = {r.doc_id: r for r in substring_dedup(docs, keep_first=True, spaced=False).collect()}
    assert len(got) == len(TEXTS)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    kept = sum((r.kept_text + " ").count(PASSAGE + " ") + (r.kept_text + "\n").count(PASSAGE + "\n") for r in first.values())
    assert kept == 1 and all(first[i].kept_text == (TEXTS[i] or "") for i in range(20) if not got[i].n_removed)
    assert substring_dedup(empty).count() == 0


def _brute_groups(fps, distance):
    parent = {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def test_simhash(docs, empty):
    fps = {}
    for i, t in enumerate(TEXTS):
        w = WORD.findall((t or "").encode().lower().decode())
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    groups = _brute_groups(fps, 2)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], groups[i]) for i in fps}
    assert S.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowded", [4096, 3])
def test_links_of_dense_fingerprints(spark, monkeypatch, crowded):
    monkeypatch.setattr(S, "CROWDED", crowded)
    base = int(rng.integers(0, 1 << 62))
    values = sorted({base ^ sum(1 << int(b) for b in rng.integers(0, 12, 3)) ^ (int(rng.integers(0, 4)) << 60) for _ in range(120)})
    got = {(r.a, r.b) for r in S.links_within_two(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_near_duplicates_at_a_similarity(spark, empty):
    base = [[f"t{k}_{i}" for i in rng.integers(0, 5000, 400)] for k in range(6)]
    rows, truth = [], {}
    for k, w in enumerate(base):
        for c in range(6):
            v = list(w)
            for at in rng.choice(400, 6, replace=False)[: c and 6]:
                v[at] = f"edit{c}"
            truth[len(rows)] = 6 * k
            rows.append((len(rows), " ".join(v)))
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(spark.createDataFrame(rows + [(90, None), (91, "")], "doc_id long, text string")).collect()}
    assert got[90] == got[91] == 90
    assert sum(got[i] == truth[i] for i in truth) >= 0.9 * len(truth) and all(got[i] >= truth[i] for i in truth)
    assert near_duplicate_groups(empty).count() == 0


def test_line_dedup(docs, empty, spark):
    got = {r.doc_id: r for r in LD.line_dedup(docs).collect()}
    lines, seen = {}, {1: set(), 2: set()}
    for i, t in enumerate(TEXTS):
        every = (t or "").split("\n")
        held = [k for k, x in enumerate(every) if WORD.search(x)]
        gone = set()
        for j, k in enumerate(held):
            for n in (1, 2):
                run = tuple(every[x] for x in held[j : j + n])
                if len(run) == n and (n == 2 or len(WORD.findall(every[k])) >= 8):
                    gone |= set(held[j : j + n]) if run in seen[n] else set()
                    seen[n].add(run)
        lines[i] = (len(every), len(gone), "\n".join(x for k, x in enumerate(every) if k not in gone))
    assert {i: (r.n_lines, r.n_removed, r.kept_text) for i, r in got.items()} == lines
    assert LD.line_dedup(empty).count() == 0


def _lines(spark, texts):
    return LD.document_lines(spark.createDataFrame(list(enumerate(texts)), "at long, text string")).persist()


def test_suffix_array_and_longest_runs(spark):
    texts = ["\n".join("abcde"[i] for i in rng.integers(0, 5, n)) for n in rng.integers(1, 30, 14)]
    texts += [texts[0], texts[1] + "\nz1\n" + texts[2], "x\n" * 40 + "q", "", "only\nonce", "a\nu1\nb", "a\nu2\nb"]
    levels = LD.suffix_levels(_lines(spark, texts))
    classes = LD.suffix_classes(levels)
    held = [[x for x in t.split("\n") if x] for t in texts]
    suffixes = {(i, j): tuple(x[j:]) for i, x in enumerate(held) for j in range(len(x))}

    def common(x, y):
        return next((n for n, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))

    want = {k: max(common(x, y) for q, y in suffixes.items() if q != k) for k, x in suffixes.items()}
    got = {(r.at, r.line): r.length for r in LD.repeated_runs(levels, classes).collect()}
    assert got == {k: n for k, n in want.items() if n}
    rank = {(r.at, r.line): r["rank"] for r in levels[-1].collect()}
    array = sorted(classes.collect(), key=lambda r: r.i)
    assert [r.i for r in array] == list(range(len(array))) and [r["rank"] for r in array] == sorted(set(rank.values()))
    for x, y in zip(array[:-1], array[1:]):
        assert y.common == common(suffixes[tuple(x.origin)], suffixes[tuple(y.origin)])


def test_line_dedup_of_null_and_equal_ids(spark):
    line = "a line of eight words or even some more"
    rows = [(None, line), (None, line + "\nb"), (1, line), (1, line), (2, "b\n" + line), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash"))
    got = LD.line_dedup(df).collect()
    assert len(got) == 6 and sum(r.kept_text.count(line) for r in got) == 1 and sum(r.n_removed for r in got) == 4
    assert next(r.doc_id for r in got if line in r.kept_text) is None, "null ids come first"
    assert sorted(r.longest_run for r in got) == [0, 1, 1, 1, 1, 1]


def test_hot_keys_are_spread(spark):
    left = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(3000)], "key long, i long")
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("twice", F.col("key") * 2)
    out = join_by_hot_key(left, right, "key", "n", hot_share=0.05)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan and plan.count("strategy=broadcast") == 2
    assert sorted((r.i, r.key, r.twice) for r in out.collect()) == [(i, 7 if i % 3 else i, 2 * (7 if i % 3 else i)) for i in range(3000)]


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5, 30)] + [(None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        w, t = WORD.findall(t or ""), t or ""
        runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        held = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(held) - len(set(held)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and (not r.kept or not r.base_failed)
    assert Q.judge(empty, labels).count() == 0


def test_binomial_bounds():
    for n, p, delta in ((300, 0.05, 0.01), (2000, 0.01, 0.001), (10, 0.05, 0.05)):
        k = Q.allowed_rejections(n, p, delta)
        assert k < 0 or Q.binomial_tail(k, n, p) <= delta
        assert k + 1 > n or Q.binomial_tail(k + 1, n, p) > delta


def test_cutoffs_hold_their_risk(spark):
    n = 4000
    good = [(i, "en", False, float(x)) for i, x in enumerate(rng.beta(1, 60, n))]
    bad = [(n + i, "en", False, float(x)) for i, x in enumerate(rng.beta(6, 20, n // 4))]
    rest = [F.lit(0.0).alias(c) for c in Q.CUTOFFS if c != "symbol_ratio"]
    rows = spark.createDataFrame(good + bad, "doc_id long, stratum string, base_failed boolean, symbol_ratio double").select("*", *rest)
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(n + n // 4)], "doc_id long, quality int")
    cut = Q.fit_cutoffs(rows, labels)["en"]["symbol_ratio"]
    assert sum(x[3] > cut for x in good) / n <= 0.05 / len(Q.CUTOFFS) and sum(x[3] > cut for x in bad) > 0.5 * len(bad)


def test_bpe(docs, empty):
    reference = Tokenizer.from_file(TOKENIZER)
    texts = [t or "" for t in TEXTS] + ["<|endoftext|>", " x<|endoftext|> y", "日本語 é\u0301", "\x1c a\x1f", "  a\n\n b ", "we'll 'tis ½² 123456", "zzzqqq" * 50]
    ids, ends = Encoder(read_tokenizer(TOKENIZER)).encode(texts)
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and np.diff([0, *ends]).tolist() == [len(w) for w in want]
    for r in decode(encode(docs, TOKENIZER), TOKENIZER).collect():
        assert list(r.ids) == want[r.doc_id] and r.text == (TEXTS[r.doc_id] or "") == reference.decode(want[r.doc_id], skip_special_tokens=False)
    assert decode(encode(empty, TOKENIZER), TOKENIZER).count() == 0


def test_bpe_memory_is_bounded(monkeypatch):
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, n)) for _ in range(3000)) for n in (80, 9, 80, 9)]
    e = Encoder(read_tokenizer(TOKENIZER))
    want = [x.ids for x in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    for budget in (96 << 20, 100_000):
        monkeypatch.setattr("pallium.llm.bpe.REMEMBERED", budget)
        e.forget()
        for text, ids in zip(texts, want, strict=True):
            assert e.encode([text])[0].tolist() == ids
            assert e.used <= budget + 1000 and len(e.begin) <= len(e.known) + 1 <= budget // 150 + 2
    assert all(len(u) <= 64 for u in e.known)


def test_equal_and_null_ids_are_own_documents(spark):
    rows = [(None, "a b"), (None, "c"), (1, "d"), (1, "d"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in encode_and_decode(df, TOKENIZER).collect()) == ["", "a b", "c", "d", "d"]
    assert sorted(r.n_words for r in substring_dedup(df).collect()) == [0, 1, 1, 1, 2]
    assert pack(df, TOKENIZER).filter("start = 0").count() == 5
    assert sorted(r.n_tokens for r in score(df, F.lit(False), TOKENIZER).collect()) == [1, 2, 2, 2, 3]


def test_very_long_texts(spark):
    long_ = " " * 400_000 + "x" + "y" * 300_000 + "\u3000" * 20_000 + "z " * 100_000
    df = spark.createDataFrame([(1, long_), (2, "short")], "doc_id long, text string")
    want = Tokenizer.from_file(TOKENIZER).encode(long_, add_special_tokens=False).ids
    pieces = sorted((r.start, np.frombuffer(r.ids, dtype="<u4")) for r in pack(df, TOKENIZER).filter("doc_id = 1").collect())
    assert np.concatenate([p for _, p in pieces]).tolist() == [*want, 1]
    row = encode_and_decode(df, TOKENIZER).filter("doc_id = 1").first()
    assert list(row.ids) == want and row.text == long_
    assert substring_dedup(df).filter("doc_id = 1").first().n_removed == 99_999
    assert score(df, F.col("doc_id") == 2, TOKENIZER).filter("doc_id = 1").first().n_tokens == 100_001
    assert Q.judge(df, spark.createDataFrame([], "doc_id long, quality int")).filter("doc_id = 1").first().n_words == 100_000
    assert {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()} == {1: 1, 2: 2}


def test_packing(docs, empty):
    reference = Tokenizer.from_file(TOKENIZER)
    want = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    rows = pack(docs, TOKENIZER, window=256).collect()
    back, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(bytes(r.ids)) >= 0
        back[r.doc_id].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in back.items()} == want
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == np.cumsum([0, *[n for _, n in sorted(s)]])[:-1].tolist() and sum(n for _, n in s) <= 256
    assert pack(empty, TOKENIZER).count() == 0


def test_best_fit_wastes_little():
    lengths = rng.integers(1, 5000, 3000).tolist()
    sums = [sum(n for _, _, n in s) for s in best_fit(lengths, 2048, 32)]
    assert sum(sums) == sum(lengths) and max(sums) <= 2048
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in sums) < 0.005 * sum(lengths)


def test_scores(docs, empty):
    held = F.col("doc_id") % 5 == 2
    got = {r.doc_id: r for r in score(docs, held, TOKENIZER).collect()}
    words = {i: (t or "").encode().lower().split() + [b" "] for i, t in enumerate(TEXTS)}
    counts = collections.Counter(x for i, w in words.items() if i % 5 != 2 for x in w)
    n, v = sum(counts.values()), len(counts)
    for i, w in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 2, len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0
    assert score(empty, held, TOKENIZER).count() == 0


def _plain_scores(scorer, counts, encode, texts):
    """log10 probabilities, token by token and without windows' arrays."""
    from pallium.llm import attention as net

    p = {k: v.astype(np.float64) for k, v in scorer.weights.items()}
    table = np.clip(p["embed"] @ p["qkv"], -4, 4)
    of, share = scorer.classes.of, scorer.classes.log_share
    out = []
    for t in texts:
        words = [encode(" " + w.decode()) for w in (t or "").encode().lower().split()]
        ids = [i for w in words for i in w] + [len(of) - 1]
        seen = [net.EDGE, *of[ids[:-1]]]
        logs = []
        for i, target in enumerate(of[ids]):
            first = i - i % net.STRIDE  # of the window
            keys = [j for j in range(first - net.CONTEXT, i + 1) if j >= 0]
            q = table[seen[i], : net.WIDTH] / np.sqrt(net.WIDTH)
            w = np.exp([q @ table[seen[j], net.WIDTH : 2 * net.WIDTH] + p["place"][i - first, j - first + net.CONTEXT] for j in keys])
            mean = sum(x * table[seen[j], 2 * net.WIDTH :] for x, j in zip(w, keys)) / w.sum()
            x = np.tanh(mean @ p["mix"] + p["embed"][seen[i]])
            group = x @ p["group"] + scorer.bigram.group[seen[i]]
            inner = x @ p["inner"][target // net.SIZE] + scorer.bigram.inner[target // net.SIZE][seen[i]]
            logs.append(group[target // net.SIZE] - np.log(np.exp(group).sum()) + inner[target % net.SIZE] - np.log(np.exp(inner).sum()) + share[ids[i]])
        total, at, n = 0.0, 0, scorer.tokens + scorer.distinct + 1
        for size, c in [(len(w), counts[x]) for w, x in zip(words, (t or "").encode().lower().split())] + [(1, counts[b" "])]:
            total += np.log10(lm.MIX * np.exp(sum(logs[at : at + size])) + (1 - lm.MIX) * (c + 1) / n)
            at += size
        out.append(total)
    return out


@pytest.mark.parametrize("head", [200_000, 3])
def test_scores_against_plain_loops(docs, monkeypatch, head):
    """With few words at hand, all others meet their counts in the join, and scores stay the same."""
    monkeypatch.setattr(lm, "HEAD", head)
    held = F.col("doc_id") % 5 == 2
    kept = {}
    real = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: kept.setdefault("out", real(*a)))
    got = {r.doc_id: r for r in score(docs, held, TOKENIZER).collect()}
    scorer = kept["out"][0]
    words = {i: (t or "").encode().lower().split() + [b" "] for i, t in enumerate(TEXTS)}
    counts = collections.Counter(x for i, w in words.items() if i % 5 != 2 for x in w)
    encoder = lm.fast_encoder_of(read_tokenizer(TOKENIZER))
    want = _plain_scores(scorer, counts, encoder.encode_ordinary, TEXTS)
    for i, w in enumerate(want):
        assert got[i].score == pytest.approx(w, rel=2e-4)
        assert got[i].n_known == sum(x in counts for x in words[i])
        assert got[i].base_score == pytest.approx(sum(np.log10((counts[x] + 1) / (sum(counts.values()) + len(counts) + 1)) for x in words[i]))


def test_every_training_text_trains_once(docs, monkeypatch):
    rows = docs.select(F.col("doc_id").alias("row"))
    first = F.pmod(F.xxhash64("row", F.lit("round")), F.lit(lm.FIRST_ROUND)) == 0
    assert rows.filter(first).count() + rows.filter(~first).count() == rows.count()


def test_every_training_token_is_trained_once_from_small_batches(spark, docs, monkeypatch):
    """All ids of all training texts, counted by the encoder alone, are targets of the gradients, in several blocks; tasks get rows by bounded batches."""
    from pallium.llm.session import BATCH_BYTES

    before, kept, sizes = spark.conf.get(BATCH_BYTES), {}, []
    real, real_stored = lm.learn, lm.stored
    monkeypatch.setattr(lm, "BLOCK", 100)
    monkeypatch.setattr(lm, "learn", lambda *a: kept.setdefault("out", real(*a)))
    monkeypatch.setattr(lm, "stored", lambda df, name: (sizes.append(int(spark.conf.get(BATCH_BYTES).rstrip("b"))), real_stored(df, name))[1])
    assert score(docs, F.col("doc_id") % 5 == 2, TOKENIZER).count() == len(TEXTS)
    encoder = lm.fast_encoder_of(read_tokenizer(TOKENIZER))
    train = [(t or "").encode().lower().split() for i, t in enumerate(TEXTS) if i % 5 != 2]
    assert kept["out"][0].trained == sum(1 + sum(len(encoder.encode_ordinary(" " + w.decode())) for w in words) for words in train)
    assert len(sizes) == 3 and max(sizes) <= 8 << 20 and spark.conf.get(BATCH_BYTES) == before


def test_spark_hands_python_batches_of_that_size(spark):
    from pallium.llm.session import batches_of

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = spark.range(0, 4000, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    with batches_of(spark, 100_000):
        assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 200
    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] == 4000


def test_attention_gradients_and_mass():
    from pallium.llm import attention as net

    p, tokens = net.initial(), rng.integers(0, net.CLASSES, 90)
    p["group"] = rng.standard_normal(p["group"].shape).astype(np.float32)
    bigram = net.Bigrams(rng.random((net.CLASSES, net.CLASSES)) + 0.1)
    inputs, there, targets, scored = net.gather(tokens, np.array([0, 30]), np.array([30, 90]))
    assert scored.sum() == 90 and targets[scored].tolist() == tokens.tolist()
    total = sum(np.exp(net.log_probabilities(p, bigram, inputs, there, np.full_like(targets, c), scored)) for c in range(net.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)
    g = net.gradients(p, bigram, inputs, there, targets, scored)
    loss = lambda q: -net.log_probabilities(q, bigram, inputs, there, targets, scored).mean()
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), p[k].shape)
        up, down = ({a: b.astype(np.float64) for a, b in p.items()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(g[k][at], rel=2e-2)


def test_kept_against_a_plain_choice_of_cutoffs(spark):
    n = 3000
    rows = [(i, "en" if i % 4 else "de", i % 97 == 0, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.beta(1, 40, n), rng.beta(1, 9, n)))]
    good = {r[0]: int(r[3] < 0.04 or rng.random() < 0.2) for r in rows if r[0] % 10}
    rest = [F.lit(0.0).alias(c) for c in Q.CUTOFFS if c not in ("symbol_ratio", "upper_ratio")]
    signals = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, symbol_ratio double, upper_ratio double").select("*", *rest)
    cutoffs = Q.fit_cutoffs(signals, spark.createDataFrame(list(good.items()), "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in Q.apply_cutoffs(signals, cutoffs).collect()}

    def bound_holds(k, m, p, share):  # exact tail by whole numbers' binomials
        from math import comb

        return m > 0 and sum(comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k + 1)) <= share

    plain = {r[0]: not r[2] for r in rows}
    for stratum in ("en", "de"):
        mine = [r for r in rows if r[1] == stratum]
        known = [(r, good[r[0]]) for r in mine if r[0] in good and not r[2]]
        for at, rule in ((3, "symbol_ratio"), (4, "upper_ratio")):
            ok = [r for r, g in known if g]
            bad = [r for r, g in known if not g]
            allowed = []
            for c in sorted(Q.CUTOFFS[rule], reverse=True):
                a, b = sum(r[at] > c for r in ok), sum(r[at] > c for r in bad)
                if not bound_holds(a, len(ok), 0.05 / len(Q.CUTOFFS), 0.05 / (2 * len(Q.CUTOFFS))):
                    break
                if b * len(ok) > 2 * a * len(bad):
                    allowed.append((b, -a, c))
            if allowed:
                for r in mine:
                    plain[r[0]] &= r[at] <= max(allowed)[2]
    assert kept == plain and cutoffs.get("de") is None and cutoffs["en"]


def test_sha_of_kept_text(spark, docs):
    row = substring_dedup(docs).filter("doc_id = 4").select(F.sha2(F.encode("kept_text", "utf-8"), 256).alias("s")).first()
    assert row.s == hashlib.sha256(b"two words").hexdigest()


def test_crowded_keys_miss_no_near_copy(spark, monkeypatch):
    rng = np.random.default_rng(12)
    shared, texts = [f"c{i}" for i in range(15)], []
    for _ in range(110):
        base = shared + [f"w{i}" for i in rng.integers(0, 5000, 85)]
        for changes in (0, 1, 2):
            copy = list(base)
            for at in rng.choice(np.arange(20, 95, 10), changes, replace=False):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = list(range(len(texts)))
    for _ in range(3):
        for i, x in enumerate(sets):
            want[i] = min(want[j] for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y))
    real = near_dedup._marked
    monkeypatch.setattr(near_dedup, "_marked", lambda docs, shingle: real(docs, shingle).withColumn("keys", F.array(F.lit(7).cast("long"))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_groups(df).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) == 110


def test_no_link_of_near_copies_is_lost(spark):
    """All pairs of different texts of the given table at that similarity, by brute force over their shingles."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: WORD.findall((r.text or "").encode().lower().decode()) for r in df.select("doc_id", "text").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in rows.items()}
    holders = collections.defaultdict(list)
    for i, x in sets.items():
        for k in x:
            holders[k].append(i)
    pairs = {(a, b) for h in holders.values() if len(h) < 400 for a in h for b in h if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    want = {i: i for i in rows}
    for _ in range(6):
        for a, b in sorted(pairs):
            want[a] = want[b] = min(want[a], want[b])
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(df).collect()}
    assert got == want and any(rows[a] != rows[b] for a, b in pairs)


def test_binomial_tails_against_sums():
    import math

    for n, k, p in [(1, 0, 0.3), (10, 3, 0.05), (600, 2, 0.01), (600, 599, 0.9), (600, 600, 0.5), (37, 36, 0.99), (900, 45, 0.05)]:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert Q.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert 0.4 < Q.binomial_tail(10**8, 10**10, 0.01) < 0.6, "work doesn't grow with k"


def test_temporary_tables_go(spark, tmp_path, monkeypatch):
    from pallium.llm import session
    from pallium.llm.session import release, stored, temporary_tables

    release(spark)
    monkeypatch.setattr(session, "shared_folder", lambda spark: f"file://{tmp_path}")
    names = lambda: sorted(p.split("-")[0] for p in os.listdir(tmp_path))
    first = stored(spark.range(3), "first")
    with temporary_tables(spark):
        inner = stored(spark.range(5), "inner")
        kept = stored(inner.filter("id > 1"), "kept", keep=True)
    assert names() == ["first", "kept"] and first.count() == kept.count() == 3
    release(spark)
    assert names() == ["kept"]
    df = spark.createDataFrame([(i, "one line of some eight words or even more\nshort") for i in range(5)], "doc_id long, text string")
    assert LD.line_dedup(df).filter("n_removed > 0").count() == 4 and near_duplicate_groups(df).filter("component_id = 0").count() == 5
    assert names() == ["kept", "lines", "near"]


def test_stored_tables_leave_no_shuffle_files(spark):
    from pallium.llm.session import CLEANUP, stored

    files = lambda: {f.getName() for f in _java_files(spark) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(CLEANUP)
    held = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")), "held")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(CLEANUP) == setting and held.count() == 7


def _java_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    while found.hasNext():
        yield found.next()


def test_line_dedup_joins_texts_alike_at_every_size(spark):
    df = spark.createDataFrame([(i, "one line of some eight words or even more\nshort", f"x{i}") for i in range(5)], "doc_id long, text string, tag string")
    out = LD.line_dedup(df, also=("tag",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {(r.doc_id, r.n_removed, r.tag) for r in out.collect()} == {(i, 0 if i == 0 else 2, f"x{i}") for i in range(5)}


def test_near_copies_hold_texts_once(spark, monkeypatch):
    """Beside the texts of candidate pairs, one table holds texts."""
    tables, real = [], near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name, **k: tables.append((name, df.columns)) or real(df, name, **k))
    df = spark.createDataFrame([(i, f"{PASSAGE} {i // 2} {i % 2}") for i in range(8)], "doc_id long, text string")
    assert {r.component_id for r in near_duplicate_groups(df).collect()} == {0}
    assert [name for name, columns in tables if "text" in columns and name != "candidate-texts"] == ["texts"]


def test_near_copies_of_different_lengths_are_linked_by_first_shingles(spark, monkeypatch):
    """Pairs at and just below the similarity, met by the exact round alone, with the shared words at any place."""
    texts = []
    for k, n in enumerate((20, 40, 75, 120)):
        body = [f"t{k}w{i}" for i in range(n)]
        for cut in (int(n * 0.8), int(n * 0.8) + 1, int(n * 0.84), n - 1):
            texts += [" ".join(body[:cut]), " ".join(body[n - cut :])]
        texts.append(" ".join(body))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = list(range(len(texts)))
    for _ in range(6):
        for i, x in enumerate(sets):
            want[i] = min(want[j] for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y))
    monkeypatch.setattr(near_dedup, "_candidates", lambda keyed, distance: keyed.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(df).collect()}
    assert got == dict(enumerate(want)) and 4 <= len(set(want)) < len(texts)


def test_settled_suffixes_leave_the_doubling(spark):
    """Level k holds stretches of 2^k lines or more only; behind the levels come all suffixes."""
    long = "\n".join(["x"] * 20)
    levels = LD.suffix_levels(_lines(spark, [long, long, *[f"a {i}\nb\nc\nd {i}" for i in range(10)], *["b\nonly " + str(i) for i in range(10)]]))
    assert [x.count() for x in levels] == [70, 60, 40, 40, 40, 70]
    assert levels[-1].select("rank").distinct().count() == 20 + 2 + 1


def test_words_of_lines_are_counted_as_far_as_needed(spark):
    """Blank lines, blanks of all kinds, and a line that a pattern which tries each place anew would read for hours."""
    lines = ["", " \t\x0b\f\r", "a b c d e f g", "a b c d e f g h", "\ta\x0bb\fc\rd e  f\tg é ", "a b c d e f g\xa0h", "x" * 1_000_000 + " y", "a b c d e f g h i"]
    got = {r.place: r.words for r in LD.document_lines(spark.createDataFrame([(1, "\n".join(lines))], "at long, text string")).collect()}
    assert got == {i: 8 if len(WORD.findall(x)) >= 8 else 0 for i, x in enumerate(lines) if WORD.search(x)}
    few = LD.document_lines(spark.createDataFrame([(1, "a\na b\na b c")], "at long, text string"), 2)
    assert [r.words for r in few.collect()] == [0, 2, 2]
