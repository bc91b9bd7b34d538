"""Near-duplicate documents at a Jaccard similarity of word shingles: SimHash with confident-bit keys.

At a similarity of 0.8, SimHash bits differ in about 15 % of all places, far too many for keys of plain
bits. But the bits that are set or unset by the widest margin hardly ever differ. Fingerprints here have 256
bits; a key joins, for some groups of 32 of them, the place and the sign of the group's most confident bit. Pairs
that share a key in one of the tables pass the pigeonring filter (some chain of 32-bit segments stays
within its proportional budgets), then the full Hamming check, and then the exact similarity of their texts.

Equal texts are one row throughout. Linking goes in two rounds. In the first, every text is compared with the
first text of its key, in each range that the key's texts lie in; that joins most copies, and large groups of them, with linear work. It finds
links with a probability that grows with the similarity, so the second round finds all that still join different components, exactly: of two
texts with that similarity, the first shingles of both (all but that share, and one more) in any common order have one in common. The order
puts frequent shingles last; counting them decides on the work alone, so a share of the texts is enough for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.components import connected_components
from pallium.llm.session import join_by_hot_key, stored, temporary_tables
from pallium.llm.words import Words, mix, pieces, powers

BITS, GROUP, TABLES, GROUPS_IN_KEY = 256, 32, 32, 3
SEGMENTS = 8
#: Every how many texts are counted for the order of shingles, and how many frequent shingles come last in it.
COUNTED, FREQUENT = 4, 500_000
#: Bits of the bitmap of first shingles that several texts have; a full one saves nothing and loses nothing.
FILTER_BITS = 1 << 26
#: Rows of one shingle on one side of a task's join.
SALTED = 1000

_rng = np.random.default_rng(77)
_SPREAD = _rng.integers(1, 1 << 62, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = np.stack([_rng.permutation(BITS) for _ in range(TABLES)])


def _lower(texts: pa.Array) -> pa.Array:
    return pa.array([(t or "").encode().lower().decode() for t in texts.to_pylist()], pa.string())


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, number of each text's first one). A text of fewer words is one shingle."""
    h = words.hashes()
    first, shingle = words.windows(h, size)
    text = words.text_of_word()[first] if len(first) else first
    short = np.flatnonzero(words.counts < size)
    whole = np.array([(h[words.first[i] : words.first[i + 1]] * powers(_SPREAD[0], size)[: words.counts[i]]).sum(dtype=np.uint64) for i in short.tolist()], dtype=np.uint64)
    order = np.argsort(np.concatenate([text, short]), kind="stable")
    out = np.concatenate([shingle, mix(whole)])[order]
    return out, np.searchsorted(np.concatenate([text, short])[order], np.arange(len(words.counts) + 1))


def margins(words: Words, size: int) -> np.ndarray:
    """(texts, BITS): by how many shingles each bit is set rather than unset."""
    h, begin = shingle_hashes(words, size)
    out = np.zeros((len(begin) - 1, BITS), dtype=np.int32)
    for i, (lo, hi) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        for k in range(lo, hi, 4096):
            part = h[k : min(k + 4096, hi)]
            wide = mix(part[:, None] * _SPREAD[None, :])
            out[i] += 2 * np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32) - len(part)
    return out


def keys_of(margin: np.ndarray) -> np.ndarray:
    """(texts, TABLES): the most confident bits of GROUPS_IN_KEY groups of each table's order of the bits."""
    out = []
    for order in _ORDERS:
        key = np.zeros(len(margin), dtype=np.int64)
        for g in range(GROUPS_IN_KEY):
            part = margin[:, order[g * GROUP : (g + 1) * GROUP]]
            best = np.abs(part).argmax(axis=1)
            key = key * (2 * GROUP) + 2 * best + (np.take_along_axis(part, best[:, None], axis=1)[:, 0] > 0)
        out.append(key)
    return np.stack(out, axis=1)


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    def apply(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                margin = margins(Words(_lower(part.column("text"))), shingle)
                bits = np.packbits(margin > 0, axis=1, bitorder="little").view(np.int64)
                keys = keys_of(margin)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * 4, pa.int32()), pa.array(bits.ravel())), pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * TABLES, pa.int32()), pa.array(keys.ravel()))],
                    ["id", "fp", "keys"],
                )

    return docs.select("id", "text").mapInArrow(apply, "id long, fp array<long>, keys array<long>")


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, SEGMENTS): differing bits of each 32-bit segment."""
    return np.bitwise_count((a ^ b).view(np.uint32)).astype(np.int64)


def _chained(d: np.ndarray, distance: int, length: int = 3) -> np.ndarray:
    """Whether from some segment on, the first 1, 2, ... segments of the ring stay within their shares of `distance`."""
    good, total = np.ones(d.shape, dtype=bool), np.zeros(d.shape, dtype=np.int64)
    for n in range(1, length + 1):
        total += np.roll(d, -(n - 1), axis=1)
        good &= total * SEGMENTS <= n * distance
    return good.any(axis=1)


def _candidates(keyed: DataFrame, distance: int) -> DataFrame:
    """(a, b): each text with the first one of its key in its range of texts, if they pass the filters.

    Rows are sorted by ranges of (table, key, id), so the texts of a key that very many share lie in several ranges.
    """
    names = ["table", "key", "id", "f0", "f1", "f2", "f3"]

    def apply(batches):
        lead = None
        for batch in batches:
            x = np.stack([batch.column(n).cast(pa.int64()).to_numpy() for n in names], axis=1)
            x = x if lead is None else np.concatenate([lead, x])
            new = np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(axis=1)])
            begin = np.flatnonzero(new)
            i, j = begin[np.cumsum(new) - 1], np.arange(len(x))
            i, j = i[i != j], j[i != j]
            d = _differences(np.ascontiguousarray(x[i, 3:]), np.ascontiguousarray(x[j, 3:]))
            use = _chained(d, distance) & (d.sum(axis=1) <= distance)
            yield pa.RecordBatch.from_arrays([pa.array(x[i[use], 2]), pa.array(x[j[use], 2])], ["a", "b"])
            lead = x[begin[-1] : begin[-1] + 1]

    dealt = keyed.select(*names).repartitionByRange("table", "key", "id").sortWithinPartitions("table", "key", "id")
    return dealt.mapInArrow(apply, "a long, b long").distinct()


def _shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    h, begin = shingle_hashes(Words(_lower(column)), shingle)
    return [np.unique(h[lo:hi]).view(np.int64) for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _set(bitmap: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    spot = shingles & (8 * len(bitmap) - 1)
    return (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def _bitmap(met: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set for all shingles of `met`; made by the executors in pages of 4 KB."""
    spot = F.col("shingle").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    pages = met.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("set"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in pages.toLocalIterator():
        out[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(r["set"], dtype=np.uint8)
    return out


def _prefix_pairs(texts: DataFrame, joined: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) of different components, among them all with that similarity. `texts` has id and text, `joined` the id and component of those that others were linked with."""
    spark = texts.sparkSession

    def shingles(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *_shingle_sets(part.column("text"), shingle)]))], ["shingle"])

    counted = texts.filter(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0).select("text").mapInArrow(shingles, "shingle long")
    often = stored(counted.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 3"), "frequent-shingles").orderBy(F.desc("n"), "shingle").limit(FREQUENT).orderBy("shingle").toArrow()
    shared = spark.sparkContext.broadcast((often["shingle"].to_numpy(), often["n"].to_numpy()))

    def prefixes(part):
        """Per text: (its first shingles, number of its shingles)."""
        value, number = shared.value
        for x in _shingle_sets(part.column("text"), shingle):
            at = np.minimum(np.searchsorted(value, x), max(len(value) - 1, 0))
            n = np.where(value[at] == x, number[at], 0) if len(value) else np.zeros(len(x), dtype=np.int64)
            yield x[np.lexsort((x, n))][: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1], len(x)

    def first(filter_):
        """(shingle, id, n, place) of first shingles, of those that the filter knows if there is one; without it, shingles alone."""

        def apply(batches):
            for batch in batches:
                for part in pieces(batch, "text"):
                    sets, size = zip(*prefixes(part)) if part.num_rows else ((), ())
                    places = [np.arange(len(x)) for x in sets]
                    if filter_ is not None:
                        chosen = [_set(filter_.value, x) for x in sets]
                        sets, places = [x[c] for x, c in zip(sets, chosen, strict=True)], [x[c] for x, c in zip(places, chosen, strict=True)]
                    times, none = [len(x) for x in sets], np.zeros(0, dtype=np.int64)
                    found = [pa.array(np.concatenate([none, *sets]))]
                    if filter_ is not None:
                        found += [pa.array(np.repeat(part.column("id").to_numpy(), times)), pa.array(np.repeat(np.array(size, dtype=np.int64), times)), pa.array(np.concatenate([none, *places]))]
                    yield pa.RecordBatch.from_arrays(found, ["shingle", "id", "n", "place"][: len(found)])

        return apply

    # most first shingles are no other text's: which ones are is found by number alone, then only these go with their texts
    bare = texts.select("text").mapInArrow(first(None), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("c"))
    known = spark.sparkContext.broadcast(_bitmap(stored(bare.filter("c > 1").select("shingle"), "shingles-of-several")))
    several = stored(texts.select("id", "text").mapInArrow(first(known), "shingle long, id long, n long, place long"), "shingles-with-ids")
    prefix = stored(several.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")), "first-shingles")
    met = prefix.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    met = stored(met.select("shingle", F.ceil(F.col("c") / SALTED).alias("parts"), "c"), "met-shingles")
    rows = stored(join_by_hot_key(prefix, met, "shingle", "c").filter("parts is not null"), "shared-shingles")
    left = rows.select("shingle", F.pmod(F.xxhash64("id"), "parts").alias("salt"), F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("place").alias("pa"))
    right = rows.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    near = (F.col("na") >= similarity * F.col("nb") - 1e-9) & (F.col("nb") >= similarity * F.col("na") - 1e-9)
    # two such texts have so many shingles in common; if this is the first of them, they are all from here on in both
    enough = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6
    return left.join(right, ["shingle", "salt"]).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near & enough).select("a", "b").distinct()


def _jaccard(pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose sets of shingles have at least that Jaccard similarity."""

    def apply(batches):
        for batch in batches:
            for part in pieces(batch, "text_a"):
                good = []
                for x, y in zip(_shingle_sets(part.column("text_a"), shingle), _shingle_sets(part.column("text_b"), shingle), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both >= similarity * (len(x) + len(y) - both))
                chosen = part.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b")], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(apply, "a long, b long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of `docs`: (id, component_id), the least id that links of that similarity reach.

    Words are lower-cased (A-Z). Equal texts always link; null counts as empty. Ids are longs; rows with a null
    id have component null and link nothing. No link between different texts is lost, and none is made below
    the similarity (but for two shingles of one 64-bit hash). An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with temporary_tables(docs.sparkSession):
        named = rows.filter("id is not null").select("id", F.struct(F.xxhash64("text"), F.xxhash64(F.lit("again"), "text")).alias("same"), "text")
        copies = stored(named.select("id", "same"), "text-ids")
        first = stored(copies.groupBy("same").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-texts")
        alone = first.select(F.col("least").alias("id"))
        texts = stored(named.select("id", "text").join(alone, "id", "left_semi"), "texts")
        marked = stored(_marked(texts, shingle), "margins")
        # at this similarity about share * 256 bits differ; two and a half deviations above
        cosine = 2 * similarity / (1 + similarity)
        share = float(np.arccos(cosine) / np.pi)
        distance = int(BITS * share + 2.5 * (BITS * share * (1 - share)) ** 0.5)

        keyed = marked.select("id", *[F.col("fp")[i].alias(f"f{i}") for i in range(4)], F.posexplode("keys").alias("table", "key"))

        def links(found: DataFrame) -> DataFrame:
            pairs = stored(found, "candidates")
            # only texts of candidates travel
            wanted = stored(texts.join(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id", "left_semi"), "candidate-texts")
            sides = pairs.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            return stored(_jaccard(sides, shingle, similarity), "near-links")

        led = links(_candidates(keyed, distance))
        joined = connected_components(led, "a", "b").withColumnRenamed("node", "id")
        both = led.union(links(_prefix_pairs(texts, joined, shingle, similarity)))
        groups = connected_components(both, "a", "b")
        component = first.join(groups, first.least == groups.node, "left").select("same", "n", F.coalesce("component", "least").alias("component_id"))
        found = stored(join_by_hot_key(copies, component, "same", "n").select(F.col("id").alias(id_col), "component_id"), "near-groups", keep=True)
    return found.unionByName(rows.filter("id is null").select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("component_id")))
