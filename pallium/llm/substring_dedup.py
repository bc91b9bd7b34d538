"""Exact substring dedup: remove repeated passages of at least `window` words.

Fixed-block anchors. A block is `window // 2 + 1` words. The reference index holds the blocks that start
at multiples of the block length in their document; every rolling window of that length probes it. Any
repeat of `window` words has an indexed block on one side and the equal probe on the other, so each of its
words lies near a hit. Hits are then extended: the `window`-word sequences around them are compared by
a 64-bit hash and by their bucket, which another hash chooses, and overlapping equal ones together form the maximal exact repeats.

Documents are dealt into chunks of a few MB by the hash of their id and text. A chunk sends each key once to each
bucket, packed, however often the passage occurs in it, so a passage found in a third of all documents
costs a bucket one key a chunk. Answers go back as bits or word positions. The number of chunks and of
buckets grows with the input; no pair of documents is ever made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.session import text_megabytes
from pallium.llm.words import Words

CHUNK_MB, BUCKET_MB = 3.0, 8.0
_PACKED = "chunk int, bucket int, keys binary, aligned binary, twice binary"
_WIDE = "chunk int, bucket int, keys binary, places binary"


def _sorted_words(table: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, Words]:
    table = table.sort_by([(id_col, "ascending"), (text_col, "ascending")])
    return table, Words(table[text_col])


def _block_keys(words: Words, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each rolling block, bucket << 32 | key, whether it is a reference block)."""
    at, h = words.windows(words.hashes(), block, 1)
    key = ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
    place = at - words.first[words.text_of_word()[at]] if len(at) else at
    return at, key, place % block == 0


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of sorted bucket numbers, one for each bucket that occurs: the work grows with the keys, not with the buckets."""
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, dtype=np.int64)
    return ((int(b), slice(lo, hi)) for b, lo, hi in zip(bucket[begin].tolist(), begin.tolist(), np.append(begin, len(bucket))[1:].tolist(), strict=True))


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n).astype(bool)


def _anchors(id_col: str, text_col: str, block: int, buckets: int):
    """Per chunk: each block key once, with whether it is a reference block and whether it occurs twice here."""

    def emit(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        _, words = _sorted_words(table, id_col, text_col)
        _, key, aligned = _block_keys(words, block, buckets)
        unique, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        reference = np.zeros(len(unique), dtype=bool)
        reference[inverse[aligned]] = True
        rows = [(chunk, b, (unique[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), _bits(reference[s]), _bits(count[s] > 1)) for b, s in _by_bucket(unique >> np.uint64(32))]
        return _table(rows, [("chunk", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("aligned", pa.binary()), ("twice", pa.binary())])

    return emit


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _answer_hits(table: pa.Table) -> pa.Table:
    """Per bucket: for each chunk, the bits of its keys that hit a reference block and occur twice or more."""
    chunks, keys = table["chunk"].to_pylist(), [np.frombuffer(k, dtype=np.uint32) for k in table["keys"].to_pylist()]
    sizes = [len(k) for k in keys]
    flat = np.concatenate(keys)
    aligned = np.concatenate([_unbits(x, n) for x, n in zip(table["aligned"].to_pylist(), sizes, strict=True)])
    twice = np.concatenate([_unbits(x, n) for x, n in zip(table["twice"].to_pylist(), sizes, strict=True)])
    order = np.argsort(flat)
    ranked = flat[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(flat))) > 1
    good = np.logical_or.reduceat(aligned[order], begin) & (many | np.logical_or.reduceat(twice[order], begin))
    hit = np.zeros(len(flat), dtype=bool)
    hit[order] = good[np.cumsum(new) - 1]
    rows, bucket = [], table["bucket"][0].as_py()
    for c, end, n in zip(chunks, np.cumsum(sizes).tolist(), sizes, strict=True):
        if hit[end - n : end].any():
            rows.append((c, bucket, _bits(hit[end - n : end])))
    return _table(rows, [("chunk", pa.int32()), ("bucket", pa.int32()), ("hits", pa.binary())])


def _extend(id_col: str, text_col: str, window: int, block: int, buckets: int, wide: int):
    """Per chunk: the hash of each `window`-word sequence around a hit, once, with its first place here."""

    def emit(table: pa.Table, hits: pa.Table) -> pa.Table:
        fields = [("chunk", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("places", pa.binary())]
        if not hits.num_rows or not table.num_rows:
            return _table([], fields)
        chunk = table["chunk"][0].as_py()
        _, words = _sorted_words(table, id_col, text_col)
        at, key, _ = _block_keys(words, block, buckets)
        unique, inverse = np.unique(key, return_inverse=True)
        hit = np.zeros(len(unique), dtype=bool)
        found = dict(zip(hits["bucket"].to_pylist(), hits["hits"].to_pylist(), strict=True))
        for b, s in _by_bucket(unique >> np.uint64(32)):
            if b in found:
                hit[s] = _unbits(found[b], s.stop - s.start)
        near = np.zeros(len(words) + 1, dtype=np.int64)
        near[at[hit[inverse]] + 1] = 1
        near = np.cumsum(near)
        first, h = words.windows(words.hashes(), window, 2)
        # a window's blocks start at its first window - block + 1 words
        near_hit = near[first + window - block + 1] > near[first]
        h, place = np.unique(h[near_hit], return_index=True)
        first = first[near_hit][place]
        bucket = _second(words, window, first) % np.uint64(wide)
        order = np.argsort(bucket, kind="stable")
        rows = [(chunk, b, h[order[s]].tobytes(), first[order[s]].astype(np.uint32).tobytes()) for b, s in _by_bucket(bucket[order])]
        return _table(rows, fields)

    return emit


def _second(words: Words, window: int, first: np.ndarray) -> np.ndarray:
    """Another hash of the windows that begin at these words, independent of the first one. It chooses a window's bucket, so as many
    more bits are compared as the number of buckets has."""
    at, h = words.windows(words.hashes(), window, 3)
    return h[np.searchsorted(at, first)]


def _answer_repeats(keep_first: bool):
    """Per bucket: for each chunk, the places of sequences that other chunks (or, to keep the first, lower ones) have."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunks, keys = table["chunk"].to_pylist(), [np.frombuffer(k, dtype=np.uint64) for k in table["keys"].to_pylist()]
        sizes = [len(k) for k in keys]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")  # within a key, chunks ascend
        ranked = flat[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        repeated = ~new if keep_first else ~(new & np.append(new[1:], True))
        hit = np.zeros(len(flat), dtype=bool)
        hit[order] = repeated
        rows = []
        for c, end, n, places in zip(chunks, np.cumsum(sizes).tolist(), sizes, table["places"].to_pylist(), strict=True):
            if (h := hit[end - n : end]).any():
                rows.append((c, np.frombuffer(places, dtype=np.uint32)[h].tobytes()))
        return _table(rows, [("chunk", pa.int32()), ("places", pa.binary())])

    return answer


def _remove(id_col: str, text_col: str, id_type: pa.DataType, window: int, keep_first: bool, spaced: bool):
    def apply(table: pa.Table, repeats: pa.Table) -> pa.Table:
        names = [id_col, "n_words", "n_removed", "kept_text"]
        if not table.num_rows:
            return pa.table([pa.array([], id_type), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=names)
        table, words = _sorted_words(table, id_col, text_col)
        first, h = words.windows(words.hashes(), window, 2)
        gone = np.zeros(len(words) + 1, dtype=bool)  # by first word of the window
        _, place, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        # equal by two hashes
        again = count[inverse] > 1
        other = _second(words, window, first) if again.any() else h
        again &= other == other[place[inverse]] if again.any() else again
        if keep_first:
            again &= place[inverse] != np.arange(len(h))
        gone[first[again]] = True
        for p in repeats["places"].to_pylist():
            gone[np.frombuffer(p, dtype=np.uint32)] = True
        begin = np.flatnonzero(gone)
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, np.minimum(begin + window, len(words)), -1)
        drop = np.cumsum(cover[:-1]) > 0
        kept = words.join_kept(~drop) if spaced else words.without(drop)
        removed = np.concatenate([[0], np.cumsum(drop)])[words.first]
        return pa.table(
            [table[id_col], pa.array(words.counts, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array([k.decode() for k in kept], pa.string())],
            names=names,
        )

    return apply


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, keep_first: bool = False, spaced: bool = True) -> DataFrame:
    """One row per row of `docs`: (id, n_words, n_removed, kept_text).

    A word goes if a `window`-word sequence that covers it occurs twice or more, anywhere in `docs`, the
    same document included; with `keep_first`, the first occurrence (in chunk order, which is fixed by the
    ids) stays. All windows are judged on the input. `spaced` joins kept words by one space; otherwise the
    text keeps its own white space except behind removed words.

    A null text counts as empty: no words, kept text ''. Texts shorter than the window lose nothing. Equal
    rows are copies of each other. Rows with equal or null ids are documents of their own. An empty table gives an
    empty result; other columns are ignored. Chunks are dealt by the hash of id and text.
    """
    spark = docs.sparkSession
    mb = text_megabytes(docs, text_col)
    block = window // 2 + 1
    chunks = max(1, math.ceil(mb / CHUNK_MB))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(mb / 64))
    # about a key of 4 bytes for every 6 bytes of text
    buckets = max(8, math.ceil(mb * 4 / 6 / BUCKET_MB))
    id_field = docs.schema[id_col]
    dealt = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).cast("int").alias("chunk"), id_col, F.col(text_col).cast("string").alias(text_col)).repartition(parts, "chunk")
    hits = dealt.groupBy("chunk").applyInArrow(_anchors(id_col, text_col, block, buckets), _PACKED).groupBy("bucket").applyInArrow(_answer_hits, "chunk int, bucket int, hits binary")
    by_chunk = dealt.groupBy("chunk")
    wide = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_extend(id_col, text_col, window, block, buckets, buckets), _WIDE)
    repeats = wide.groupBy("bucket").applyInArrow(_answer_repeats(keep_first), "chunk int, places binary")
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"`{id_col}` {id_field.dataType.simpleString()}, n_words long, n_removed long, kept_text string"
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(_remove(id_col, text_col, to_arrow_type(id_field.dataType), window, keep_first, spaced), schema)
