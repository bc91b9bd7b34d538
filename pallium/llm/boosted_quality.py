"""A classifier of text quality: histogram gradient-boosted trees over document statistics.

Statistics are measured once for all texts, a batch at a time, and written. A bounded sample of labelled rows is
binned by quantiles; trees grow level by level on histograms of gradients over the bins, with the logistic loss.
The trees are complete and lie flattened in arrays, level after level, so scoring a batch is a few array lookups for each
level, for all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.session import stored
from pallium.llm.words import Words, pieces

#: At most so many labelled rows are fitted, those of the least hashes of their ids.
LABELLED_ROWS = 50_000
BINS, DEPTH, TREES, RATE, RIDGE, LEAST_ROWS = 64, 4, 80, 0.15, 1.0, 10.0

# Classes of bytes: others (beyond ASCII, controls), lower, upper, digit, blank, sentence end, comma and the like, quotes and brackets, symbols, line feed
_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".?", b",;:", b"'\"()[]{}", b"#*$%&|<>@\\^_`~+=/-", b"!", b"\n"), 1):
    _CLASS[list(_set)] = _i
CLASSES = 11
STATISTICS = [
    *[f"share_{n}" for n in ("other", "lower", "upper", "digit", "blank", "end", "comma", "quote", "symbol", "exclamation", "line")], "class_entropy",
    "words", "word_length", "word_length_deviation", "longest_word", "distinct_words", "commonest_word", "repeats_before", "repeated_runs",
    "capitalised", "upper_words", "symbol_ends", "no_letter", "lines", "line_words", "repeated_lines", "longest_line",
]


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of x over [begin[i], begin[i + 1])."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    return total[begin[1:]] - total[begin[:-1]]


def _most(x: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, group, x)
    return out


def _repeats(group: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group: (distinct keys, times of the commonest key, rows whose key occurs twice or more)."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]) if len(g) else np.zeros(0, dtype=bool)
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(g)))
    of = g[begin]
    return np.bincount(of, minlength=n), _most(times, of, n), np.bincount(of, weights=times * (times > 1), minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, STATISTICS). An empty text has zeros throughout."""
    words, n = Words(texts), len(texts)
    data, ends = words.data, words.offsets
    size = np.maximum(np.diff(ends) - 1, 1).astype(np.float64)
    kind = _CLASS[data]
    # the line feed that closes a text isn't its own
    counts = np.stack([_sums(kind == c, ends) - (c == CLASSES - 1) for c in range(CLASSES)], axis=1)
    share = counts / size[:, None]
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1)
    of, length, many = words.text_of_word(), words.end - words.start, np.maximum(words.counts, 1)
    mean = np.bincount(of, weights=length, minlength=n) / many
    deviation = np.sqrt(np.maximum(np.bincount(of, weights=length.astype(np.float64) ** 2, minlength=n) / many - mean**2, 0))
    h = words.hashes()
    distinct, common, _ = _repeats(of, h, n)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    at, run = words.windows(h, 4)
    runs = np.bincount(of[at], minlength=n)
    repeated = _repeats(of[at], run, n)[2] / np.maximum(runs, 1)
    before = lambda c: np.concatenate([[0], np.cumsum(kind == c)])
    within = lambda c: (x := before(c))[words.end] - x[words.start]
    lower, upper = within(1), within(2)
    first, last = kind[words.start], kind[words.end - 1]
    per_word = lambda x: np.bincount(of, weights=x, minlength=n) / many
    # lines with a word, told by the number of line feeds in front; a line's key is the sum of its words' places and hashes
    line = (np.cumsum(kind == CLASSES - 1) - (kind == CLASSES - 1))[words.start]
    new = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, dtype=bool)
    begin = np.flatnonzero(new)
    per_line = np.diff(np.append(begin, len(line)))
    place = np.arange(len(line), dtype=np.uint64) - np.repeat(begin, per_line).astype(np.uint64)
    key = np.add.reduceat(h * (2 * place + np.uint64(1)), begin) if len(begin) else np.zeros(0, dtype=np.uint64)
    lines = np.bincount(of[begin], minlength=n)
    same, _, _ = _repeats(of[begin], key, n)
    columns = [
        entropy, np.log1p(words.counts), mean, deviation, np.log1p(_most(length, of, n)), distinct / many, common / many, per_word(again), repeated,
        per_word((first == 2) | (first == 0)), per_word((upper > 1) & (lower == 0)), per_word((last == 8) | (last == 9)), per_word((lower == 0) & (upper == 0)),
        np.log1p(lines), words.counts / np.maximum(lines, 1), 1 - same / np.maximum(lines, 1), np.log1p(_most(per_line, of[begin], n)),
    ]
    out = np.column_stack([share, *columns])
    out[words.counts == 0] = 0
    return out


@dataclass(frozen=True)
class Trees:
    """Complete trees of `depth` levels in arrays: node k of a level splits into 2k and 2k + 1 of the next.

    Level d of tree t lies at [t, 2^d - 1 : 2^(d+1) - 1]; a row goes right where its feature exceeds the threshold.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows of x."""
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        depth = self.leaf.shape[1].bit_length() - 1
        for level in range(depth):
            at = node + (2**level - 1)
            node = 2 * node + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return self.base + self.leaf[trees, node].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE, least_rows: float = LEAST_ROWS) -> Trees:
    """Boosted trees for labels y (0 or 1) of the rows of x. Without rows every score is 0.5."""
    n, m = x.shape
    seen, good = max(n, 1), y.sum() if n else 0.5
    base = float(np.log((good + 0.5) / (seen - good + 0.5))) if n else 0.0
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), dtype=np.int64)
    placed = binned + np.arange(m)[None, :] * bins
    feature, threshold, leaf = np.zeros((trees, 2**depth - 1), dtype=np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth))
    margin = np.full(n, base)
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        spread = [np.repeat(gradient, m), np.repeat(weight, m), None]
        for level in range(depth):
            nodes = 2**level
            cell = (node[:, None] * (m * bins) + placed).ravel()
            sums = [np.bincount(cell, weights=v, minlength=nodes * m * bins).reshape(nodes, m, bins).cumsum(axis=2) for v in spread]
            (gl, wl, nl), (g, w, c) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (wl + ridge) + (g - gl) ** 2 / (w - wl + ridge) - g**2 / (w + ridge)
            gain[(nl < least_rows) | (c - nl < least_rows)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            found = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            for k in np.flatnonzero(found).tolist():
                j, b = divmod(int(best[k]), bins)
                # the last bin has no cut behind it: nothing would go right
                if b < len(cuts[j]):
                    feature[t, nodes - 1 + k], threshold[t, nodes - 1 + k] = j, cuts[j][b]
            at = nodes - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        total = [np.bincount(node, weights=v, minlength=2**depth) for v in (gradient, weight)]
        leaf[t] = -rate * total[0] / (total[1] + ridge)
        margin += leaf[t][node]
    return Trees(feature, threshold, leaf, base)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x) of each row, written: the statistics of its text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                x = statistics(part.column("text")).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(apply, f"id {kind}, x array<float>"), "statistics")


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.float64).reshape(-1, len(STATISTICS))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, cutoff: float = 0.3, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """One row per row of `docs`: (id, held_out, score, predicted).

    Rows whose CRC-32 of the id as text is divisible by `folds` are held out: their labels aren't read. Nothing but
    the text enters a score. Repeated labels of an id count once, as good if one says so; null labels and ids are
    ignored. A row with a null id isn't held out and has no label. Null and empty texts are scored by their zeros;
    very long ones are measured whole, one in a task at a time. Equal texts have equal scores. Without labels, every score is 0.5. An
    empty table gives an empty result. Other columns are ignored.
    """
    rows = measured(docs, id_col, text_col)
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    sample = rows.join(known, "id").filter(~held_out).orderBy(F.xxhash64("id"), "x").limit(labelled_rows).select("x", F.col("y").cast("double").alias("y")).toArrow().combine_chunks()
    x = sample["x"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float32()))
    trees = docs.sparkSession.sparkContext.broadcast(fit(_matrix(x), sample["y"].to_numpy() if sample.num_rows else np.zeros(0)))

    def apply(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(trees.value.scores(_matrix(part.column("x"))))], ["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"id {kind}, score double").select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
