"""Shared places and small plan helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "pallium-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Tables written by each thread that nobody has removed: (application, thread) -> paths.
_WRITTEN: dict[tuple[str, int], list[str]] = {}


def _written(spark: SparkSession) -> list[str]:
    return _WRITTEN.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


#: Spark removes the shuffle files of a query as it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of queries that are written within go as each ends."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Bytes of rows that Spark hands to Python at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """Jobs that run within hand Python about `size` bytes at once, a longer row alone: a task holds a batch several times, in the JVM and in Python."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and work is done once, so its shuffle files go too.

    The table goes with the next release(), or at the end of the temporary_tables() it is made in, unless `keep`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _written(spark).append(path)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, begin: int = 0) -> None:
    """Removes the tables that this thread has stored, from number `begin` on. Whoever calls this reads none of them any more."""
    paths = _written(spark)
    for path in paths[begin:]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del paths[begin:]


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables stored within go at the end; what is read later must be stored with `keep`. After an error they stay, for those who look for its cause."""
    begin = len(_written(spark))
    yield
    release(spark, begin)


def text_megabytes(docs: DataFrame, column: str = "text") -> float:
    """Size of all texts, for choosing numbers of partitions."""
    row = docs.agg(F.sum(F.octet_length(column)).alias("n")).first()
    return (row["n"] or 0) / 1e6


def join_by_hot_key(left: DataFrame, right: DataFrame, key: str, weight: str, total: int | None = None, hot_share: float | None = None) -> DataFrame:
    """left join of `left` with `right` (unique by `key`), where few keys may hold most left rows.

    `right[weight]` says how many left rows have the key, `total` how many there are (counted if not given). Keys
    with over `hot_share` of them number at most 1 / hot_share: that is the proven size of what is broadcast. Unless given, it is a
    thousandth, or a quarter of what a shuffle partition holds on average if that is less, so no other key makes a task much larger than the rest. Their
    left rows stay where they are, all others are joined by a shuffle. `left` is read twice, so it should be stored.
    `weight` isn't returned.
    """
    if total is None:
        total = right.agg(F.sum(weight).alias("n")).first()["n"] or 0
    share = hot_share or min(1e-3, 1 / (4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    least = max(share * total, 100)
    hot = right.filter(F.col(weight) > least).drop(weight)
    cold = right.filter(F.col(weight) <= least).drop(weight)
    spread = left.join(F.broadcast(hot), key)
    dealt = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    columns = [*left.columns, *[c for c in right.columns if c not in (key, weight)]]
    return spread.select(*columns).unionByName(dealt.select(*columns))


def in_order(df: DataFrame, *order: Column, name: str = "sorted") -> DataFrame:
    """`df` sorted by range and written, with `at`: a number that grows in that order, and `chunk`, its range."""
    out = stored(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), name)
    return out.withColumn("chunk", F.shiftrightunsigned("at", 33))


def numbered_in_order(df: DataFrame, *order: Column) -> DataFrame:
    """`df` with `place`: 0, 1, 2, ... in that order. No task holds more than a range; the ranges' sizes, a row each, are summed and broadcast."""
    rows = in_order(df, *order)
    sizes = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    begin = sizes.select("chunk", F.coalesce(F.sum("n").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    return rows.join(F.broadcast(begin), "chunk").withColumn("place", F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("chunk", "at", "begin")
