"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length, turned by three rounds of random signs and a fast Hadamard transform, and
hashed to the nearest signed axis. A code joins `k` such hashes; there are `tables` independent codes. Queries
come in blocks of bounded size: a block's multiprobe tables (the `probes` best codes of each query in each
table, by how much worse their axes are than the best) are broadcast. Every row's codes are computed once and written with
it; in a pass for each block it meets the queries that probe them, and is compared with them exactly, on the original vectors
in double precision, unless a product of matrices shows that it is farther than those kept.
A task keeps the nearest rows of each query; the last step merges the tasks'. Nothing is dealt out by code, so
a code or a vector that a third of all rows share costs no more than others. Queries that met fewer rows than
asked for, as outliers do, are then compared with all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pallium.llm.session import stored

TABLES, PROBES, HASHES = 16, 512, 2
#: Bytes of the probe tables of a block of queries.
BROADCAST_BYTES = 64 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def axis_scores(unit: np.ndarray, hashes: int, seed: int):
    """For each of `hashes` pseudo-rotations, the inner products with all signed axes: (n, 2 d) each."""
    rng = np.random.default_rng(seed)
    width = 1 << max(unit.shape[1] - 1, 0).bit_length()
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    for _ in range(hashes):
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], width))
        yield np.concatenate([y, -y], axis=1)


def codes(unit: np.ndarray, tables: int, k: int, seed: int) -> np.ndarray:
    """(tables, n) codes of the rows."""
    out, scores = [], axis_scores(unit, tables * k, seed)
    for _ in range(tables):
        code = np.zeros(len(unit), dtype=np.int64)
        for _ in range(k):
            s = next(scores)
            code = code * s.shape[1] + s.argmax(axis=1)
        out.append(code)
    return np.stack(out)


def probe_codes(unit: np.ndarray, tables: int, k: int, probes: int, seed: int) -> list[np.ndarray]:
    """Per table, (n, probes) codes with the least sum of squared shortfalls against the best axes."""
    out, scores = [], axis_scores(unit, tables * k, seed)
    for _ in range(tables):
        code, cost = np.zeros((len(unit), 1), dtype=np.int64), np.zeros((len(unit), 1))
        for _ in range(k):
            s = next(scores)
            axis = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            best = np.take_along_axis(s, axis, axis=1)
            cost = (cost[:, :, None] + ((best[:, :1] - best) ** 2)[:, None, :]).reshape(len(unit), -1)
            code = (code[:, :, None] * s.shape[1] + axis[:, None, :]).reshape(len(unit), -1)
            few = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            code, cost = np.take_along_axis(code, few, axis=1), np.take_along_axis(cost, few, axis=1)
        out.append(code)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class QueryBlock:
    """A block of queries with its probe tables: per table, the codes that are probed, and for each of them its queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tables: int, k: int, probes: int, seed: int):
        self.ids, self.vectors, self.shape = ids, vectors, (tables, k, seed)
        self.tables = []
        for code in probe_codes(_unit(vectors), tables, k, probes, seed):
            flat = code.ravel()
            order = np.argsort(flat, kind="stable")
            probed, begin = np.unique(flat[order], return_index=True)
            self.tables.append((probed, np.append(begin, len(flat)).astype(np.int32), (order // code.shape[1]).astype(np.uint16 if len(ids) < 1 << 16 else np.int32)))

    def hits(self, code: np.ndarray) -> np.ndarray:
        """(rows, queries): whether a row of those codes, (tables, rows), shares one with a query."""
        out = np.zeros((code.shape[1], len(self.ids)), dtype=bool)
        for (probed, begin, query), c in zip(self.tables, code, strict=True):
            at = np.minimum(np.searchsorted(probed, c), len(probed) - 1)
            row = np.flatnonzero(probed[at] == c)
            low = begin[at[row]].astype(np.int64)
            count = begin[at[row] + 1] - low
            total = np.concatenate([[0], np.cumsum(count)])
            out[np.repeat(row, count), query[np.repeat(low - total[:-1], count) + np.arange(total[-1])]] = True
        return out

    def candidates(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, query) pairs that share a code."""
        return np.nonzero(self.hits(codes(_unit(vectors), *self.shape)))


class WholeBlock:
    """A block of queries each of which meets every row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors

    def hits(self, code: np.ndarray) -> np.ndarray:
        return np.ones((code.shape[1], len(self.ids)), dtype=bool)


def _nearest(query: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first rows of each query by (distance, id); equal ones count once."""
    order = np.lexsort((ids, distance, query))
    same = (query[order[1:]] == query[order[:-1]]) & (distance[order[1:]] == distance[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]])
    order = order[np.concatenate([[True], ~same])] if len(order) else order
    query = query[order]
    new = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=bool)
    begin = np.flatnonzero(new)
    rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
    order = order[rank < k]
    return query[rank < k], distance[order], ids[order]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def search(vectors: DataFrame, queries: DataFrame, neighbours: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, k: int = HASHES, block: int | None = None, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): per row of `queries`, its nearest rows of `vectors` found, nearest first.

    Nearness is the smallest Euclidean distance, ties go to the smaller id; rows with the query's own id are no
    candidates. Vectors that are null, empty, zero, or hold a null or non-finite component take no part, and
    neither do those of another length than most. Ids are longs; rows with a null id take no part. `k` is the
    number of hashes in a code, the same at every size: as rows grow, the nearest ones of a query get nearer and
    share codes more often, but with a third hash `probes` codes would be too few. Every row is indexed. A query
    has all candidates if there are fewer than `neighbours`. An empty table on either side gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
        return df.select(F.col(id_col).alias("id"), x.alias("v")).filter(F.col("id").isNotNull() & x.isNotNull() & good)

    rows = usable(vectors)
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    schema = "query_id long, vec_id long, score double"
    merged = spark.createDataFrame([], schema)

    def compared(asked: DataFrame, make) -> DataFrame:
        blocks = math.ceil(asked.count() / at_once)
        out = spark.createDataFrame([], schema)
        for b in range(blocks):
            # about `at_once` rows of a fixed width: the hash deals them evenly
            some = asked.filter(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).toArrow()
            if some.num_rows:
                shared = spark.sparkContext.broadcast(make(some["id"].to_numpy().astype(np.int64), _matrix(some["v"].combine_chunks(), width)))
                out = out.union(stored(rows.mapInArrow(_compare(shared, width, neighbours), schema), "nearest-of-tasks"))
        return out

    if widths is not None:
        width = widths["width"]
        # the rows' codes are computed once, for all blocks of queries
        rows = stored(rows.filter(F.size("v") == width).mapInArrow(_coded(width, tables, k, seed), f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, codes array<long>"), "codes")
        at_once = block or block_size(width, tables, probes, k)
        asked = stored(usable(queries).filter(F.size("v") == width), "queries")
        merged = compared(asked, lambda ids, x: QueryBlock(ids, x, tables, k, probes, seed)).distinct()
        full = merged.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= neighbours)
        merged = merged.union(compared(stored(asked.join(full, "id", "left_anti"), "short-queries"), WholeBlock))
    first = W.partitionBy("query_id").orderBy("score", "vec_id")
    return merged.distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def block_size(width: int, tables: int, probes: int, k: int) -> int:
    """Queries of a block whose probe tables take BROADCAST_BYTES at most."""
    axes = 2 << max(width - 1, 0).bit_length()
    # a number of two bytes for each probe; the code and its place too, unless there are few codes
    return max(min(BROADCAST_BYTES // (tables * probes * (2 if axes**k <= 1 << 16 else 14)), 4096), 64)


def _coded(width: int, tables: int, k: int, seed: int, rows_at_once: int = 1024):
    def apply(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(lo, rows_at_once)
                x = _matrix(part.column("v"), width)
                own = codes(_unit(x), tables, k, seed).T
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(m).ravel())) for m, n in ((x, width), (own, tables))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *lists], ["id", "v", "codes"])

    return apply


def _close(x: np.ndarray, own: np.ndarray, q: QueryBlock, hits: np.ndarray, most: np.ndarray, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the hits that may be among the nearest: no farther, but for rounding, than `most` (squared) or than the
    `neighbours`-th hit of these rows. Products of matrices tell; who passes is measured exactly."""
    sizes = (x * x).sum(axis=1)[:, None] + (q.vectors * q.vectors).sum(axis=1)[None, :]
    square = sizes - 2 * (x @ q.vectors.T)
    hits &= own[:, None] != q.ids[None, :]
    far = np.where(hits, square, np.inf)
    # rows of an id that came before here count once
    fresh = np.sort(np.unique(own, return_index=True)[1])
    if len(fresh) > neighbours:
        most = np.minimum(most, np.partition(far[fresh], neighbours - 1, axis=0)[neighbours - 1])
    with np.errstate(invalid="ignore"):
        return np.nonzero(hits & ((square <= most[None, :] + 1e-10 * sizes) | ~np.isfinite(square)))


def _compare(shared, width: int, neighbours: int, rows_at_once: int = 1024):
    def apply(batches):
        q = shared.value
        query, distance, ids = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
        most = np.full(len(q.ids), np.inf)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(lo, rows_at_once)
                x, own = _matrix(part.column("v"), width), part.column("id").to_numpy().astype(np.int64)
                code = part.column("codes").flatten().to_numpy().reshape(len(x), -1).T
                row, near = _close(x, own, q, q.hits(code), most, neighbours)
                d = np.concatenate([np.sqrt(((x[row[i : i + 100_000]] - q.vectors[near[i : i + 100_000]]) ** 2).sum(axis=1)) for i in range(0, len(row), 100_000)] or [np.zeros(0)])
                query, distance, ids = _nearest(np.concatenate([query, near]), np.concatenate([distance, d]), np.concatenate([ids, own[row]]), neighbours)
                whole = np.flatnonzero(np.bincount(query, minlength=len(q.ids)) == neighbours)
                # queries come in order, their rows nearest first
                most[whole] = distance[np.searchsorted(query, whole, "right") - 1] ** 2
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[query]), pa.array(ids), pa.array(distance)], ["query_id", "vec_id", "score"])

    return apply


def exact_search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, neighbours: int) -> list[tuple[int, int, int, float]]:
    """Brute force over arrays, for measuring recall on small tables: rows (query_id, rank, vec_id, score)."""
    out = []
    for q in queries.tolist():
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)).tolist() if ids[i] != q][:neighbours]
        out += [(q, r + 1, int(ids[i]), float(d[i])) for r, i in enumerate(order)]
    return out
