"""Language-model scores of texts, with a model learnt from the corpus itself.

Learning: (1) all training words are counted; (2) all texts are cut into subword ids once and written; (3) the training
texts' ids give counts of ids, hence the classes, and counts of class bigrams; (4) every training text trains the
attention weights once, in two rounds: an eighth of the texts in the first one, all others in the second. In a round
every task trains a copy on its windows, and the copies are averaged by their numbers of tokens. What the driver
holds is bounded: the ids' counts, class bigrams, weights, and the `HEAD` most frequent words.

Scoring: every subword of a text is scored once, in a window with the tokens before it. A word's probability is the
product of its subwords', mixed with its smoothed share of the training tokens. Counts of the most frequent words
are at hand in every task, those of all others meet their occurrences in a shuffle join; both are mixed alike.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.llm import attention as net
from pallium.llm.bpe import Vocabulary, fast_encoder_of, read_tokenizer
from pallium.llm.session import batches_of, stored
from pallium.llm.words import pieces, slices

#: Words whose counts every task holds. All others are joined.
HEAD = 200_000
#: Windows of a training step and of a scoring step, and tokens whose windows are put in random order.
BATCH, BLOCK = 128, 250_000
#: Bytes of rows that a task gets at once.
AT_ONCE = 8 << 20
#: One of so many training documents is in the first round.
FIRST_ROUND = 8
#: Weight of the attention model in the mixture with the words' shares.
MIX = 0.5
#: Bytes of remembered words after which a worker starts afresh, and bytes that one takes besides its characters.
REMEMBERED, OVERHEAD = 128 << 20, 200


def _split(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split() cuts at x20 and x09-x0D exactly."""
    return (text or "").encode().lower().split()


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c): counts of all words of all texts."""

    def apply(batches):
        counts: Counter = Counter()

        def flushed():
            words, c = list(counts), list(counts.values())
            counts.clear()
            for lo in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words[lo : lo + 50_000]], pa.string()), pa.array(c[lo : lo + 50_000], pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(text_col).to_pylist():
                counts.update(_split(text))
                if len(counts) > 1_000_000:
                    yield from flushed()
        yield from flushed()

    return docs.select(text_col).mapInArrow(apply, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Counts:
    """Counts of the training words: N, V, documents, and those of the most frequent words; `whole` if these are all."""

    def __init__(self, spec: str, words: DataFrame, documents: int):
        found = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
        self.spec, self.documents = spec, documents
        self.tokens, self.distinct = found["n"] + documents, found["v"] + (documents > 0)
        self.head = {r["word"].encode(): r["c"] for r in words.orderBy(F.desc("c"), "word").limit(HEAD).toLocalIterator()}
        self.whole = found["v"] <= HEAD
        v = Vocabulary(spec)
        #: the id that ends a text
        self.end = max([*v.ids.tolist(), *v.special.values()]) + 1
        self.kind = np.uint16 if self.end < 1 << 16 else np.uint32


class _Known(dict):
    """Number of each word seen; of word i: ids[begin[i]:begin[i+1]], and its count, or -1 if that isn't at hand."""

    def __init__(self, counts: Counts):
        super().__init__()
        self.counts, self.encoder, self.used = counts, fast_encoder_of(counts.spec), 0
        self.begin, self.ids, self.count = array("q", [0]), array("i"), array("d")
        self.other = 0 if counts.whole else -1

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.count)
        ids = self.encoder.encode_ordinary(" " + word.decode())
        self.ids.extend(ids)
        self.begin.append(len(self.ids))
        self.count.append(self.counts.head.get(word, self.other))
        self.used += OVERHEAD + len(word) + 4 * len(ids)
        return number


def sequences(docs: DataFrame, shared) -> DataFrame:
    """Of each row of `docs` (id, held_out, text): its ids with the end's, a bit for each id that begins a word, each
    word's count (32-bit floats, -1 for those in `rare`), and sums over the words whose counts are at hand."""

    def apply(batches):
        counts: Counts = shared.value
        known, row = _Known(counts), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                if known.used > REMEMBERED:
                    known = _Known(counts)
                split = [_split(t) for t in part.column("text").to_pylist()]
                size = np.array([len(s) for s in split], dtype=np.int64)
                words = [w for s in split for w in s]
                number = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
                # number 0, 1, ... and, for the ends, one more
                begin, flat = np.array(known.begin, dtype=np.int64), np.append(np.array(known.ids, dtype=counts.kind), counts.kind(counts.end))
                begin, count = np.append(begin, len(flat)), np.append(np.array(known.count), counts.documents)
                units = np.full(len(words) + len(size), len(count) - 1)
                stop = np.cumsum(size + 1)
                is_word = np.ones(len(units), dtype=bool)
                is_word[stop - 1] = False
                units[is_word] = number
                lengths, count = (begin[1:] - begin[:-1])[units], count[units]
                total = np.concatenate([[0], np.cumsum(lengths)])
                ids = flat[np.repeat(begin[units] - total[:-1], lengths) + np.arange(total[-1])]
                starts = np.zeros(len(ids), dtype=bool)
                starts[total[:-1]] = True
                edge = np.concatenate([[0], stop])
                logs = np.concatenate([[0.0], np.cumsum(np.log10(np.maximum(count, 0) + 1))])
                there = np.concatenate([[0], np.cumsum(count > 0)])
                rare = np.flatnonzero(count[is_word] < 0)
                cut, at = np.searchsorted(rare, np.concatenate([[0], np.cumsum(size)])), total[edge].tolist()
                spans, weights = list(zip(at[:-1], at[1:], strict=True)), count.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(part.num_rows)),
                        part.column("id"),
                        part.column("held_out"),
                        pa.array(size + 1),
                        pa.array(np.diff(there[edge])),
                        pa.array(np.diff(logs[edge])),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array([words[i].decode() for i in rare.tolist()], pa.string())),
                        pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([np.packbits(starts[a:b]).tobytes() for a, b in spans], pa.binary()),
                        pa.array([weights[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary()),
                    ],
                    ["row", "id", "held_out", "n_tokens", "known", "logs", "rare", "ids", "starts", "counts"],
                )
                row += part.num_rows

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(apply, f"row long, id {kind}, held_out boolean, n_tokens long, known long, logs double, rare array<string>, ids binary, starts binary, counts binary")


def _read(batch: pa.RecordBatch, kind, most: int = 1 << 20):
    """(slice, its ids, begin and end of each row's) of about `most` bytes of ids; a longer row comes alone."""
    sizes = np.array([len(x) for x in batch.column("ids").to_pylist()], dtype=np.int64)
    for part in slices(batch, sizes, most):
        raw = part.column("ids").to_pylist()
        size = np.array([len(x) for x in raw], dtype=np.int64) // np.dtype(kind).itemsize
        end = np.cumsum(size)
        yield part, np.frombuffer(b"".join(raw), dtype=kind).astype(np.int64), end - size, end


class Classes:
    """Class of every subword id, and the log share of the id within its class. The end is the class EDGE."""

    def __init__(self, counts: np.ndarray, leading_space: np.ndarray, end: int):
        ids = np.argsort(-counts, kind="stable")
        ids = ids[ids != end]
        bands = net.SIZE // 2
        own = net.CLASSES - 1 - 2 * bands
        self.of = np.zeros(len(counts), dtype=np.int64)
        self.of[ids[:own]] = 1 + np.arange(min(own, len(ids)))
        rest = ids[own:]
        for space in (0, 1):
            side = rest[leading_space[rest] == space]
            weight = np.cumsum(counts[side] + 1.0)
            band = np.minimum((weight / max(weight[-1] if len(weight) else 1.0, 1.0) * bands).astype(np.int64), bands - 1)
            self.of[side] = 1 + own + space * bands + band
        smooth = counts + 0.5
        self.of[end] = net.EDGE
        total = np.bincount(self.of, smooth, net.CLASSES)
        self.log_share = np.log(smooth) - np.log(total[self.of])


def _summed(train: DataFrame, kind, size: int, count) -> np.ndarray:
    """Sums over all training texts of count(ids, begin, end), an array of `size` numbers. At most `size` rows reach the driver."""

    def apply(batches):
        total = np.zeros(size)
        for batch in batches:
            for _, ids, begin, end in _read(batch, kind):
                total += count(ids, begin, end)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "c"])

    out = np.zeros(size)
    found = train.select("ids").mapInArrow(apply, "i long, c double").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    out[found["i"].to_numpy()] = found["c"].to_numpy()
    return out


class Scorer:
    """What scoring needs: classes, bigrams, weights, and the numbers of training tokens and distinct ones."""

    def __init__(self, counts: Counts, train: DataFrame):
        self.tokens, self.distinct, self.kind = counts.tokens, counts.distinct, counts.kind
        size, n = counts.end + 1, net.CLASSES
        v = Vocabulary(counts.spec)
        space = np.zeros(size, dtype=np.int64)
        for i, t in zip(v.ids.tolist(), v.tokens, strict=True):
            space[i] = t.startswith(b" ")
        self.classes = Classes(_summed(train, self.kind, size, lambda ids, begin, end: np.bincount(ids, minlength=size)), space, counts.end)
        of = self.classes.of
        # texts lie one behind the other, so the class before a text's first one is EDGE
        pairs = _summed(train, self.kind, n * n, lambda ids, begin, end: np.bincount(np.append(net.EDGE, of[ids[:-1]]) * n + of[ids], minlength=n * n)).reshape(n, n)
        # a little of each row follows the overall shares, so that nothing is impossible
        overall = pairs.sum(axis=0) + 0.1
        self.bigram = net.Bigrams(pairs + 2.0 * overall / overall.sum() + 1e-6)
        self.weights = net.initial()
        #: subwords and ends that took part in training the weights
        self.trained = 0

    def log_share(self, count: np.ndarray) -> np.ndarray:
        """Natural log of the weighted smoothed share of a token that occurs so often in training texts."""
        return np.log((1 - MIX) / (self.tokens + self.distinct + 1) * (count + 1))

    def by_token(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Natural log probability of each id of texts ids[begin:end] that lie one behind the other."""
        data, out = net.gather(self.classes.of[ids], begin, end), []
        for lo in range(0, len(data[0]), BATCH):
            out.append(net.log_probabilities(self.weights, self.bigram, *[x[lo : lo + BATCH] for x in data]))
        # windows lie in text order, each token is scored in one of them
        return np.concatenate([*out, np.zeros(0)]) + self.classes.log_share[ids]

    def score(self, part: pa.RecordBatch, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability of each text without its rare words, number of rare words, natural log model probability of each rare word)."""
        sizes = (end - begin).tolist()
        starts = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for b, n in zip(part.column("starts").to_pylist(), sizes, strict=True)])
        raw = part.column("counts").to_pylist()
        units = np.array([len(b) for b in raw], dtype=np.int64) // 4
        count = np.frombuffer(b"".join(raw), dtype=np.float32).astype(np.float64)
        unit = np.add.reduceat(self.by_token(ids, begin, end), np.flatnonzero(starts))
        rare = count < 0
        mixed = np.where(rare, 0.0, np.logaddexp(unit + math.log(MIX), self.log_share(np.maximum(count, 0))))
        first = np.cumsum(units) - units
        return np.add.reduceat(mixed, first) / math.log(10), np.add.reduceat(rare, first, dtype=np.int64), unit[rare]


def _train(train: DataFrame, scorer: Scorer) -> tuple[dict[str, np.ndarray], int]:
    """Weights averaged over tasks, each of which trains on its windows, and the number of tokens that took part. Every row is in one of the two rounds."""
    spark = train.sparkSession
    weights, kind, tokens = net.flatten(scorer.weights), scorer.kind, 0
    first = F.pmod(F.xxhash64("row", F.lit("round")), F.lit(FIRST_ROUND)) == 0
    for r, rows in enumerate((train.filter(first), train.filter(~first))):
        shared = spark.sparkContext.broadcast((weights, scorer.bigram, scorer.classes.of))

        def apply(batches, shared=shared, r=r):
            flat, bigram, of = shared.value
            p, held, size, total = net.unflatten(flat), [], [], 0
            adam = net.Adam(p)

            def steps() -> int:
                end = np.cumsum(size)
                data = net.gather(np.concatenate(held), end - size, end)
                order = np.random.default_rng(r).permutation(len(data[0]))
                for lo in range(0, len(order), BATCH):
                    adam.rate = 4e-3 / (1 + r) / math.sqrt(1 + adam.step / 500)
                    adam.update(p, net.gradients(p, bigram, *[x[order[lo : lo + BATCH]] for x in data]))
                held.clear()
                size.clear()
                return int(data[-1][order].sum())

            for batch in batches:
                for _, ids, begin, end in _read(batch, kind):
                    held.append(of[ids])
                    size.extend((end - begin).tolist())
                    if sum(map(len, held)) > BLOCK:
                        total += steps()
            if held:
                total += steps()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([net.flatten(p).astype(np.float64).tolist()], pa.list_(pa.float64())), pa.array([total], pa.int64())], ["weights", "n"])

        trained = rows.select("ids").mapInArrow(apply, "weights array<double>, n long")
        mean = trained.select(F.posexplode("weights").alias("i", "w"), "n").groupBy("i").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"), F.sum("n").alias("n")).toArrow()
        if mean.num_rows:
            weights = np.zeros(len(weights))
            weights[mean["i"].to_numpy()] = mean["w"].to_numpy()
            tokens += mean["n"][0].as_py()
    return net.unflatten(weights), tokens


def learn(rows: DataFrame, tokenizer: str) -> tuple[Scorer, DataFrame, DataFrame]:
    """(scorer, counts of all training words, sequences of all rows) of `rows` (id, held_out, text)."""
    context = rows.sparkSession.sparkContext
    spec, train = read_tokenizer(tokenizer), rows.filter(~F.col("held_out"))
    words = stored(count_words(train, "text"), "word-counts")
    counts = Counts(spec, words, train.count())
    laid = stored(sequences(rows, context.broadcast(counts)), "sequences")
    known = laid.filter(~F.col("held_out"))
    scorer = Scorer(counts, known)
    scorer.weights, scorer.trained = _train(known, scorer)
    return scorer, words, laid


def _scored(laid: DataFrame, shared) -> DataFrame:
    """Of each row of sequences: log10 probability of its text without its rare words, and the model's natural log probability of each of these."""

    def apply(batches):
        kept = ["row", "id", "held_out", "n_tokens", "known", "logs", "rare"]
        for batch in batches:
            for part, ids, begin, end in _read(batch, shared.value.kind):
                total, rare, values = shared.value.score(part, ids, begin, end)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)]), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(total), listed], [*kept, "score", "by_model"])

    kind = laid.schema["id"].dataType.simpleString()
    return laid.mapInArrow(apply, f"row long, id {kind}, held_out boolean, n_tokens long, known long, logs double, rare array<string>, score double, by_model array<double>")


def score(docs: DataFrame, held_out: Column, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    The model learns from the rows that `held_out` doesn't mark (null counts as not marked). A text's tokens are
    its lower-cased words and one end. base_score sums log10((c + 1) / (N + V + 1)) over tokens; score is the
    model's log10 probability of the text. Null texts are empty: the end alone. Without training rows, counts
    are zero. Rows with equal or null ids are scored one by one. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    with batches_of(spark, AT_ONCE):
        scorer, words, laid = learn(rows, tokenizer)
        scored = stored(_scored(laid, spark.sparkContext.broadcast(scorer)), "scored")
    smooth = scorer.tokens + scorer.distinct + 1
    each = scored.select("row", F.explode(F.arrays_zip("rare", "by_model")).alias("r")).select("row", F.col("r.rare").alias("word"), (F.col("r.by_model") + math.log(MIX)).alias("m"))
    each = each.join(words, "word", "left").fillna({"c": 0}).withColumn("s", F.log((1 - MIX) / smooth * (F.col("c") + 1)))
    mixed = F.greatest("m", "s") + F.log1p(F.exp(-F.abs(F.col("m") - F.col("s"))))
    rare = each.groupBy("row").agg(F.count_if(F.col("c") > 0).alias("more_known"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs"), F.sum(mixed / math.log(10)).alias("more_score"))
    out = scored.drop("rare", "by_model").join(rare, "row", "left").fillna({"more_known": 0, "more_logs": 0.0, "more_score": 0.0})
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("more_known")).alias("n_known"),
        F.lit(scorer.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * math.log10(smooth)).alias("base_score"),
        (F.col("score") + F.col("more_score")).alias("score"),
    )
