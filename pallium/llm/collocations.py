"""Phrase collocations from sorted streams of n-gram counts.

Texts are counted in blocks: a task numbers the words of a block, sorts the numbers of its n-grams, and passes on each
n-gram once, with its count; Spark merges the counts of all blocks. Orders are counted one after another. An n-gram
is passed on only if the shorter ones within it may be frequent, which a bitmap of fixed size tells: it never lets
a frequent one go, and others that it lets through are dropped by their exact counts.

The frequent n-grams of all orders are one stream of counts in prefix order. Each cut of a candidate asks it for its
left part (a prefix) and, sorted anew by what remains (suffix order), for its right part; the best extension of each
phrase is a third stream. Stream and questions are sorted together by range and read in lockstep: the last count
met is the answer. No table is held, and a phrase that very many candidates share is spread over ranges, as the
last count of a range is handed to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pallium.llm.session import in_order, stored
from pallium.llm.words import byte_hashes, mix, pieces, text_bytes

#: Bits of the bitmap of frequent n-grams of an order.
FILTER_BITS = 1 << 26
#: Bytes of text that are counted together.
BLOCK = 1 << 20
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _cut(text: str, size: int) -> list[str]:
    """`text` in stretches of about `size` characters that end where a piece ends."""
    out, begin = [], 0
    while begin < len(text):
        end = begin + size
        while end < len(text) and text[end - 1] not in ".,;:!?\n\x0b\x0c\r":
            end += 1
        out.append(text[begin:end])
        begin = end
    return out


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, inverse, count) of np.unique for keys from 0 on. Key and place are sorted as one number where both fit in."""
    n = len(key)
    bits = n.bit_length()
    if n and int(key.max()) >> (63 - bits):
        return np.unique(key, return_index=True, return_inverse=True, return_counts=True)[1:]
    both = np.sort((key.astype(np.int64) << bits) | np.arange(n))
    place, key = both & ((1 << bits) - 1), both >> bits
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    inverse = np.empty(n, dtype=np.int64)
    inverse[place] = np.cumsum(new) - 1
    return place[begin], inverse, np.diff(np.append(begin, n))


class Block:
    """The n-grams of some texts: words get numbers, equal for equal (lang, word)."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, ends = text_bytes(texts)
        data = data.copy()
        data[(data >= 0x41) & (data <= 0x5A)] += 0x20
        kind = _KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        piece = np.cumsum(kind == 2)[start] if len(start) else start
        # whether a word and the next one are in one piece; texts end with a line feed
        self.joined = piece[1:] == piece[:-1]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        word, lang = spelt.dictionary_encode(), langs.dictionary_encode()
        text = np.searchsorted(ends, start, side="right") - 1
        both = lang.indices.to_numpy()[text].astype(np.int64) * len(word.dictionary) + word.indices.to_numpy()
        # first place, number by place, and count of each (lang, word)
        self.first, self.word, self.count = _grouped(both)
        unit = both[self.first]
        self.lang_of = lang.dictionary.take(pa.array(unit // max(len(word.dictionary), 1)))
        self.word_of = word.dictionary.take(pa.array(unit % max(len(word.dictionary), 1)))
        self.units = len(unit)

    def longer(self, number: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, numbers there, first place of each number, count of each) of n-grams one word longer than those numbered
        `number` by place, where `ok`."""
        at = np.flatnonzero(ok)
        key = number[at].astype(np.int64) * self.units + self.word[at + (len(self.word) - len(ok))]
        first, inverse, count = _grouped(key)
        return at, inverse, at[first], count

    def phrases(self, first: np.ndarray, size: int) -> tuple[pa.Array, pa.Array]:
        """(langs, phrases) of the n-grams of `size` words that begin at those words."""
        parts = [self.word_of.take(pa.array(self.word[first + k])) for k in range(size)]
        lang = self.lang_of.take(pa.array(self.word[first])) if len(first) else self.lang_of.slice(0, 0)
        return lang, pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if size > 1 else parts[0]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """A hash of each (lang, word); words are large binaries, none of them empty."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    spelt = byte_hashes(np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets))
    lang = langs.dictionary_encode()
    return mix(spelt + np.array([xxhash.xxh64_intdigest(k) for k in lang.dictionary.to_pylist()], dtype=np.uint64)[lang.indices.to_numpy()])


def _spots(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """Bits of n-grams whose words have those hashes."""
    total = np.zeros(len(hashes[0]), dtype=np.uint64)
    for h in hashes:
        total = mix(total * _ODD + h)
    return (total & np.uint64(bits - 1)).astype(np.int64)


def _set(bitmap: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (bitmap[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 == 1


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """`bits` bits (a power of two), set for all rows; it is built by the executors, a page of 4 KB in a row."""

    def spots(batches):
        for batch in batches:
            langs, phrases = batch.column("lang"), [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
            if phrases:
                yield pa.RecordBatch.from_arrays([pa.array(_spots([_word_hashes(langs, pa.array(w, pa.large_binary())) for w in zip(*phrases, strict=True)], bits) + 1)], ["spot"])

    rows = frequent.select("lang", "phrase").mapInArrow(spots, "spot long").groupBy(F.bitmap_bucket_number("spot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("set"))
    out = np.zeros(max(bits // 32768, 1) * 4096, dtype=np.uint8)
    for r in rows.toLocalIterator():
        out[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(r["set"], dtype=np.uint8)
    return out[: max(bits // 8, 1)]


def _counted(docs: DataFrame, sizes: tuple[int, ...], filters: list[np.ndarray], block_bytes: int) -> DataFrame:
    """(lang, phrase, n) of n-grams of these sizes, n being a long; `docs` has lang and text. With a bitmap for an
    order, an n-gram is counted only if those of that order within it may be frequent. Longer ones than words need that of words."""
    shared = [docs.sparkSession.sparkContext.broadcast(f) for f in filters]

    def rows(block: Block):
        if not block.units:
            return
        if 1 in sizes:
            yield 1, block.first, block.count
        if max(sizes) == 1:
            return
        hashes = _word_hashes(block.lang_of, block.word_of)
        known = _set(shared[0].value, _spots([hashes], 8 * len(shared[0].value)))[block.word]
        number, ok, place = block.word, block.joined & known[:-1] & known[1:], np.arange(len(block.word))
        pair = None
        for size in range(2, max(sizes) + 1):
            at, inverse, first, count = block.longer(number, ok)
            if size in sizes:
                yield size, first, count
            if size == max(sizes) or not len(at):
                return
            good = np.zeros(len(block.word), dtype=bool)
            if size == 2 and len(shared) > 1:
                good[at] = _set(shared[1].value, _spots([hashes[block.word[first]], hashes[block.word[first + 1]]], 8 * len(shared[1].value)))[inverse]
            else:
                good[at] = True
            pair = good if pair is None else pair
            number = np.zeros(len(place), dtype=np.int64)
            number[at] = inverse
            # the n-gram goes on if its last pair does
            ok = good[: len(place) - size] & pair[size - 1 : len(place) - 1]

    def apply(batches):
        for batch in batches:
            for part in pieces(batch, "text", block_bytes):
                parts = [(part.column("text"), part.column("lang"))]
                if part.num_rows == 1 and part.nbytes > block_bytes:
                    cut = _cut(part.column("text")[0].as_py(), block_bytes)
                    parts = [(pa.array([c]), part.column("lang")) for c in cut]
                for text, lang in parts:
                    block = Block(text, lang)
                    for size, first, count in rows(block):
                        k, p = block.phrases(first, size)
                        yield pa.RecordBatch.from_arrays([k.cast(pa.string()), p.cast(pa.large_string()).cast(pa.string()), pa.array(count.astype(np.int64))], ["lang", "phrase", "n"])

    counted = docs.mapInArrow(apply, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int, least: int, bits: int = FILTER_BITS, block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, f) of all phrases of 1 to `longest` words with f >= `least`, (lang, n) of all words).

    `docs` has lang and text without nulls. f counts all occurrences within pieces.
    """
    words = stored(_counted(docs, (1,), [], block_bytes), "word-counts")
    found, filters = [stored(words.filter(F.col("n") >= least), "frequent-words")], []
    for sizes in ((2,), tuple(range(3, longest + 1))):
        if sizes and max(sizes) <= longest:
            filters.append(_bitmap(found[-1], bits))
            found.append(stored(_counted(docs, sizes, filters, block_bytes).filter(F.col("n") >= least), "frequent-phrases"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    # words hold no blank, so a phrase tells its size
    return out.select("lang", F.size(F.split("phrase", " ")).alias("size"), "phrase", F.col("n").alias("f")), words.groupBy("lang").agg(F.sum("n").alias("n"))


def lockstep(stream: DataFrame, questions: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`questions` with `value` of the row of `stream` (unique by `keys`) that has its keys, or null.

    Both are sorted together by keys, the stream's row first, in ranges; the last such row is the answer to the questions
    behind it, and the last one of a range goes, as one row, to the ranges after it.
    """
    rest = [c for c in questions.columns if c not in keys]
    asked = questions.select(*keys, F.lit(None).cast(stream.schema[value].dataType).alias("_value"), F.lit(1).alias("_asks"), F.struct(*rest).alias("_rest"))
    given = stream.select(*keys, F.col(value).alias("_value"), F.lit(0).alias("_asks"), F.lit(None).cast(asked.schema["_rest"].dataType).alias("_rest"))
    rows = in_order(given.unionByName(asked), *keys, F.col("_asks"), F.col("_rest"), name="lockstep")
    row = F.when(F.col("_asks") == 0, F.struct(*keys, "_value"))
    ends = rows.groupBy("chunk").agg(F.max_by(row, F.when(row.isNotNull(), F.col("at"))).alias("_end"))
    before = ends.select("chunk", F.last("_end", ignorenulls=True).over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    met = F.last(row, ignorenulls=True).over(W.partitionBy("chunk").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("_met", met).filter("_asks = 1").join(F.broadcast(before), "chunk").withColumn("_met", F.coalesce("_met", "_before"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"_met.{k}") == F.col(k))
    return out.select(*keys, *[F.col(f"_rest.{c}").alias(c) for c in rest], F.when(same, F.col("_met._value")).alias(value))


def _exact(x: Column) -> Column:
    """20 digits: products with factors of some millions stay exact."""
    return x.cast("decimal(20,0)")


def _words(first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", longest: int = 4, least: int = 30, absorbed: int = 80, top: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `longest` words of each language.

    ASCII letters are lower-cased. Pieces end at .,;:!? and line ends; words are runs of other characters than blanks and tabs.
    a is how often the phrase occurs within pieces, l and r how often its parts do at its weakest cut, score the floor of
    scale * a / (l + r) there (equal scores: after the fewest words), n the words of the language. Phrases that
    occur less than `least` times are no candidates; one goes if a longer candidate around it has `absorbed`
    percent of its occurrences. Ranked are the `top` of a language by score, a, and phrase (byte order); numbers are long.
    A null language is `und`, as are all rows if there is no such column. Null and empty texts hold nothing; repeated
    rows count each time; an empty table gives an empty result. Other columns are ignored.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")) if lang_col in docs.columns else F.lit("und")
    texts = docs.select(lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    frequent, totals = frequent_phrases(texts, longest, least)
    candidates = frequent.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    # a phrase within one two words longer is within one between, which occurs no less: extensions by one word suffice
    shorter = F.array(_words(F.lit(1), F.col("size") - 1), _words(F.lit(2), F.col("size") - 1))
    extended = candidates.filter("size > 2").select("lang", F.explode(F.array_distinct(shorter)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("extension"))
    kept = lockstep(extended, candidates, ["lang", "phrase"], "extension").filter(F.col("extension").isNull() | (100 * _exact(F.col("extension")) < absorbed * _exact(F.col("a")))).drop("extension")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("left"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    counts = frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = lockstep(counts.withColumnRenamed("part", side), cuts, ["lang", side], "count").withColumnRenamed("count", name)
    # div is exact on decimals; there is no function of that name in Python
    scored = cuts.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {scale}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = weakest.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT d, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS p FROM docs)
), words AS (
  SELECT d, i, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS j FROM (SELECT d, i, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)
), runs AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY d, i ORDER BY j)
), grams AS (
  SELECT lang, [w1] AS ws FROM runs UNION ALL SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL
), f AS (
  SELECT lang, ws, count(*) AS f FROM grams GROUP BY lang, ws HAVING count(*) >= 30
), candidates AS (
  SELECT lang, ws, f AS a FROM f WHERE len(ws) > 1
), inner_parts AS (
  SELECT lang, a AS longer, ws[x:y] AS part FROM (SELECT lang, a, ws, unnest(range(1, len(ws) + 1)) AS x FROM candidates) c, range(1, 5) r(y) WHERE y <= len(ws) AND y > x AND y - x + 1 < len(ws)
), absorbed AS (
  SELECT DISTINCT c.lang, c.ws FROM candidates c JOIN inner_parts p ON c.lang = p.lang AND c.ws = p.part AND 100 * p.longer::HUGEINT >= 80 * c.a::HUGEINT
), cuts AS (
  SELECT c.lang, c.ws, c.a, k FROM candidates c ANTI JOIN absorbed b ON c.lang = b.lang AND c.ws = b.ws, range(1, 4) r(k) WHERE k < len(c.ws)
), scored AS (
  SELECT c.lang, c.ws, a, k, x.f AS l, y.f AS r, (2000000 * a::HUGEINT // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:]
), weakest AS (
  SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS i FROM scored) WHERE i = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT ranked.lang, rank, phrase, a, l, r, t.n, score FROM ranked JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) t ON ranked.lang = t.lang WHERE rank <= 2000
"""
