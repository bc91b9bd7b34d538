"""Values of a session that its masked texts still hold.

Each value is known by one piece of it, of PIECE bytes at most: the one that the fewest values of its session share. A Bloom
filter of (session, piece) goes to the tasks that read the texts; they look at every window of a text in one pass and
make a row only of windows that the filter knows, with the bytes around them. These rows meet the values on
(session, piece), so a large session is spread over its pieces, and the whole value is looked for in the bytes around.

A filter has MOST_BITS at most. Where the values need more, sessions are dealt to several filters by their hashes; each text
is looked at once, with the filter of its session.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.operators.storage import stored

PIECE = 5
#: Bits of the filter for each value, how many of them a value sets, and the most bits of a filter (64 MB).
BITS_PER_VALUE, PROBES, MOST_BITS = 24, 8, 1 << 29
#: Bytes of text that are looked at together.
BLOCK = 1 << 20

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _spot(key: np.ndarray, session: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit of each (piece, session) for a probe; bits is a power of two."""
    x = (key ^ (session * _FACTORS[(probe + 3) % PROBES])) * _FACTORS[probe]
    x ^= x >> np.uint64(29)
    x *= _FACTORS[(probe + 1) % PROBES]
    return ((x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def _keys(data: np.ndarray, size: int) -> np.ndarray:
    """A number for each window of `size` bytes, different for different windows of any size up to seven."""
    n = len(data) - size + 1
    out = np.full(max(n, 0), size << 56, dtype=np.uint64)
    for k in range(size):
        out |= data[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts, null counting as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _known(filter_: np.ndarray, data: np.ndarray, session: np.ndarray, size: int) -> np.ndarray:
    """Places of the windows of `size` bytes that the filter knows; `session` is given for each byte."""
    key, bits = _keys(data, size), 8 * len(filter_)
    at = np.arange(len(key))
    for probe in range(PROBES):
        spot = _spot(key[at], session[at], probe, bits)
        at = at[(filter_[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
        if not len(at):
            break
    return at


def pieces_of_values(values: DataFrame, session_col: str) -> DataFrame:
    """`values` (session, _value, ...), distinct, with `_piece`: the piece that the fewest values of the session share."""
    raw = F.col("_value").cast("binary")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length("_value") - PIECE + 1, F.lit(1))), lambda i: F.substring(raw, i, F.lit(PIECE)))
    rows = values.select(session_col, "_value", F.explode(F.array_distinct(windows)).alias("_piece")).distinct()
    shared = rows.groupBy(session_col, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    # tables as large as the values: a broadcast would take them through the driver
    rarest = rows.join(shared.hint("merge"), [session_col, "_piece"]).groupBy(session_col, "_value").agg(F.min_by("_piece", F.struct("_n", F.xxhash64("_piece"), "_piece")).alias("_piece"))
    return values.join(rarest.hint("merge"), [session_col, "_value"])


def _filter(pieces: DataFrame, session_col: str, bits: int) -> np.ndarray:
    """The Bloom filter of (session, _piece), made by the executors in pages of 4 KB."""

    def spots(batches):
        for batch in batches:
            session = batch.column("session").to_numpy().view(np.uint64)
            found = batch.column("_piece").to_pylist()
            key = np.array([int.from_bytes(p, "little") | len(p) << 56 for p in found], dtype=np.uint64)
            both = np.concatenate([np.zeros(0, dtype=np.int64), *[_spot(key, session, k, bits) for k in range(PROBES)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(both) + 1)], ["spot"])

    rows = pieces.select(F.xxhash64(session_col).alias("session"), "_piece").distinct().mapInArrow(spots, "spot long")
    pages = rows.groupBy(F.bitmap_bucket_number("spot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("set"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in pages.toLocalIterator():
        out[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(r["set"], dtype=np.uint8)
    return out


def _hits(texts: DataFrame, columns: list[str], session_col: str, filter_: np.ndarray, sizes: list[int], reach: int) -> DataFrame:
    """(columns, _piece, _around) of all windows that the filter knows, with `reach` bytes on both sides."""
    shared = texts.sparkSession.sparkContext.broadcast(filter_)

    def look(batches):
        for batch in batches:
            data, offsets = _bytes(batch.column("_masked"))
            session = batch.column("_session").to_numpy().view(np.uint64)
            for begin in range(0, len(data), BLOCK):
                # blocks overlap by less than a window
                part = data[begin : begin + BLOCK + PIECE - 1]
                row = np.searchsorted(offsets, np.arange(begin, begin + len(part)), side="right") - 1
                for size in sizes:
                    at = _known(shared.value, part, session[row], size)
                    # a window lies in one text, and starts in this block
                    at = at[(at < BLOCK) & (row[at] == row[at + size - 1])]
                    if len(at):
                        of = row[at]
                        low, high = np.maximum(begin + at - reach, offsets[of]), np.minimum(begin + at + size + reach, offsets[of + 1])
                        around = pa.array([data[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
                        piece = pa.array([part[a : a + size].tobytes() for a in at.tolist()], pa.binary())
                        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(of)) for c in columns], piece, around], [*columns, "_piece", "_around"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*columns).schema)
    return texts.select(*columns, F.xxhash64(session_col).alias("_session"), "_masked").mapInArrow(look, f"{kinds}, _piece binary, _around binary")


def leaks(masked: DataFrame, detections: DataFrame, keys: list[str], masked_col: str = "masked_text", session_col: str = "session_id", most_bits: int = MOST_BITS) -> DataFrame:
    """(keys, entity_type), never the value, of rows whose masked text holds a value found in any text of its session.

    Texts and values are compared byte by byte. Null texts, null sessions and empty values leak nothing. Values are
    written and their filters built when this is called; the texts are read when the result is.
    """
    values = detections.filter(F.col(session_col).isNotNull() & (F.octet_length("text") > 0)).select(session_col, "entity_type", F.col("text").alias("_value")).distinct()
    named = stored(pieces_of_values(stored(values, "values"), session_col), "pieces-of-values")
    size = named.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("_value")).alias("reach"), F.collect_set(F.least(F.octet_length("_value"), F.lit(PIECE))).alias("sizes")).first()
    bits = 1 << 15
    while bits < min(BITS_PER_VALUE * size["n"], most_bits):
        bits *= 2
    filters = max(-(-BITS_PER_VALUE * size["n"] // bits), 1)
    columns = list(dict.fromkeys([*keys, session_col]))
    texts = masked.select(*columns, F.col(masked_col).cast("string").alias("_masked")).filter(F.col("_masked").isNotNull() & F.col(session_col).isNotNull())
    dealt: Column = F.pmod(F.xxhash64(F.lit("filter"), session_col), F.lit(filters))
    found = None
    for k in range(filters):
        # with one filter no text is left out
        here = [x if filters == 1 else x.filter(dealt == k) for x in (named, texts)]
        hits = _hits(here[1], columns, session_col, _filter(here[0], session_col, bits), sorted(size["sizes"]), size["reach"] or 0)
        found = hits if found is None else found.unionByName(hits)
    met = found.join(named.hint("merge"), [session_col, "_piece"])
    return met.filter(F.contains("_around", F.col("_value").cast("binary"))).select(*keys, "entity_type").distinct()
