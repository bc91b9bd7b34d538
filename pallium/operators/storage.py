"""Intermediate tables in the folder that the cluster shares, and rows in order without a single task."""

from __future__ import annotations

import os
import tempfile
import uuid

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
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends there, and work is done once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order: Column, name: str = "sorted") -> DataFrame:
    """`df` sorted by ranges and written, with `at`, a number that grows in that order, and `chunk`, its range.

    What a row needs of the rows before it is a window over its chunk, and one row of each chunk for the chunks behind it (`carried`).
    """
    out = stored(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), name)
    return out.withColumn("chunk", F.shiftrightunsigned("at", 33))


def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """`rows` of in_order with `name`: the last `value` that is not null in the rows up to this one, itself included.

    No window goes over more than a chunk; the last value of each chunk goes to the chunks behind it as a row of a broadcast table.
    """
    marked = rows.withColumn("_value", value)
    ends = marked.groupBy("chunk").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("at"))).alias("_end"))
    before = ends.select("chunk", F.last("_end", ignorenulls=True).over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    here = F.last("_value", ignorenulls=True).over(W.partitionBy("chunk").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("_here", here).join(F.broadcast(before), "chunk").withColumn(name, F.coalesce("_here", "_before")).drop("_value", "_here", "_before")


def previous(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """`rows` of in_order with `name`: `value` (not null) of the row before this one; null for the first."""
    marked = rows.withColumn("_value", value)
    ends = marked.groupBy("chunk").agg(F.max_by("_value", "at").alias("_end"))
    before = ends.select("chunk", F.lag("_end").over(W.orderBy("chunk")).alias("_before"))
    here = F.lag("_value").over(W.partitionBy("chunk").orderBy("at"))
    return marked.withColumn("_here", here).join(F.broadcast(before), "chunk").withColumn(name, F.coalesce("_here", "_before")).drop("_value", "_here", "_before")
