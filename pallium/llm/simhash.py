"""SimHash fingerprints and near-duplicate groups by pigeonring filtering.

Fingerprints of `bits` bits are cut into three consecutive segments on a ring. If two differ in at most 2
bits, some segment i starts a chain whose cumulative differences stay within the proportional budgets
2/3, 4/3 and 2: segment i equal, segments i and i+1 with at most one difference, all with at most two. With
at most one difference in segment i+1, one of its halves is equal as well; so segment i and that half are
the join key (about half of the bits), the chain is tested next, and the full distance last.

Only distinct fingerprints are joined. Copies of a text share one, so a group of copies costs one row.
Keys that very many distinct fingerprints share are not paired: these fingerprints look up all their
neighbours within the distance instead, which grows linearly.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.llm.components import connected_components
from pallium.llm.session import join_by_hot_key, stored
from pallium.llm.words import Words, pieces

BITS, DISTANCE, SEGMENTS = 64, 2, 3
#: Above so many distinct fingerprints, looking up the 2,080 neighbours of each is less work than pairing.
CROWDED = 4096


def _fingerprints(words: Words, shingle: int) -> np.ndarray:
    """Per text, the bits that are set in over half of its shingles' XXH64."""
    n = words.counts
    clean = b" ".join(words.join_kept(np.ones(len(words), dtype=bool))).lower()
    length = words.end - words.start
    # in `clean`, each text's words are joined by one space and texts by one more
    gaps = np.ones(len(words), dtype=np.int64)
    empty_before = np.cumsum(n == 0)[words.text_of_word()] if len(words) else gaps
    begin = np.concatenate([[0], np.cumsum(length + gaps)[:-1]]) + empty_before
    stop = begin + length
    out = np.zeros(len(n), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for i in np.flatnonzero(n).tolist():
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        last = max(hi - shingle + 1, lo + 1)
        ends = stop[lo + shingle - 1 : hi] if hi - lo >= shingle else stop[hi - 1 : hi]
        h = np.array([digest(clean[a:b], 42) for a, b in zip(begin[lo:last].tolist(), ends.tolist(), strict=True)], dtype=np.uint64)
        ones = np.zeros(64, dtype=np.int64)
        for k in range(0, len(h), 1 << 15):
            ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): the 64 bits as a signed long. Words are lower-cased (A-Z); a text without words gets 0."""

    def apply(batches):
        for batch in batches:
            for part in pieces(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(_fingerprints(Words(part.column(text_col)), shingle).view(np.int64), pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(apply, f"`{id_col}` {kind}, fp long")


def _segment(fp: Column, i: int) -> Column:
    """Segment i of the ring: 22, 21 and 21 bits."""
    low, width = ((0, 22), (22, 21), (43, 21))[i % SEGMENTS]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _half(fp: Column, i: int, upper: bool) -> Column:
    return F.shiftright(_segment(fp, i), 11) if upper else _segment(fp, i).bitwiseAND(F.lit((1 << 11) - 1))


def _keys(fp: Column) -> Column:
    """The six keys of a fingerprint: number of the key, segment i, a half of segment i + 1."""
    return F.array(*[F.struct(F.lit(2 * i + u).alias("kind"), _segment(fp, i).alias("seg"), _half(fp, i + 1, bool(u)).alias("half")) for i in range(SEGMENTS) for u in (0, 1)])


def links_within_two(fps: DataFrame) -> DataFrame:
    """(a, b) pairs of distinct fingerprints in `fps` (column fp, unique) that differ in one or two bits."""
    keys = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.*")
    crowded = keys.groupBy("kind", "seg", "half").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED)
    crowded = stored(crowded.drop("n"), "crowded")
    busy = not crowded.isEmpty()
    plain = keys.join(crowded, ["kind", "seg", "half"], "left_anti") if busy else keys
    x, y = plain.select("kind", "seg", "half", F.col("fp").alias("a")), plain.select("kind", "seg", "half", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # the chain from segment i: i is equal by the key; budgets 4/3 for i and i + 1, then 2 for all
    second = F.when(F.col("kind") < 2, F.bit_count(_segment(differ, 1))).when(F.col("kind") < 4, F.bit_count(_segment(differ, 2))).otherwise(F.bit_count(_segment(differ, 0)))
    pairs = x.join(y, ["kind", "seg", "half"]).filter((F.col("a") < F.col("b")) & (second <= 1) & (F.bit_count(differ) <= DISTANCE)).select("a", "b")
    if busy:
        masks = [sum(1 << j if j < 63 else -(1 << 63) for j in c) for r in (1, 2) for c in combinations(range(BITS), r)]
        some = keys.join(crowded, ["kind", "seg", "half"], "left_semi").select("fp").distinct()
        near = some.select(F.col("fp").alias("a"), F.explode(F.transform(F.lit(masks), lambda m: F.col("fp").bitwiseXOR(m))).alias("b"))
        near = near.join(fps.select(F.col("fp").alias("b")), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.union(near)
    return pairs.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of `docs`: (id, fp long, component_id): the least id reachable over links, itself included.

    Fingerprints link at two or fewer differing bits; equal ones always do. Texts without words (null, empty,
    white space) have fingerprint 0 and link like any other. Ids are longs; a null id takes part and counts as
    the largest. An empty table gives an empty result. Other columns are ignored.
    """
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    groups = connected_components(links_within_two(fps.select("fp")), "a", "b")
    named = fps.join(groups, fps.fp == groups.node, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", "n", "component_id")
    return join_by_hot_key(marked, named, "fp", "n")
