"""The vault: one row for each (session, token), with the encrypted value."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pallium.operators.mask import token, value_hash

COLUMNS = ["session_id", "token", "value_hash", "encrypted_value", "entity_type", "created_at", "access_count"]
KINDS = "session_id string, token string, value_hash string, encrypted_value binary, entity_type string, created_at timestamp, access_count long"


def seal(value: Column, key: Column) -> Column:
    """AES-GCM with a fresh 12-byte nonce in front; key: 16, 24 or 32 bytes."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def unseal(sealed: Column, key: Column) -> Column:
    return F.aes_decrypt(sealed, key, F.lit("GCM")).cast("string")


def build_vault(detections: DataFrame, session_col: str = "session_id", key: Column | None = None, created_at: Column | None = None, hex_len: int = 12) -> DataFrame:
    """Vault rows of detections (long form): one for each distinct (session, type, value); redacted ones have none.

    The shuffle key holds the value, so a large session is spread, and equal values meet in partial
    aggregation first. Without a key the column `value` stands in for encrypted_value: for tests only.
    """
    kept = detections.filter(~F.col("entity_type").startswith("REDACTED_")).withColumn("_created", created_at if created_at is not None else F.current_timestamp())
    rows = kept.groupBy(F.col(session_col).alias("session_id"), "entity_type", F.col("text").alias("value")).agg(F.min("_created").alias("created_at"), F.count(F.lit(1)).alias("times"))
    sealed = seal(F.col("value"), key).alias("encrypted_value") if key is not None else F.col("value")
    return rows.select("session_id", token(F.col("session_id"), F.col("entity_type"), F.col("value"), hex_len).alias("token"), value_hash(F.col("entity_type"), F.col("value")).alias("value_hash"), sealed, "entity_type", "created_at", F.lit(0).cast("long").alias("access_count"))


def token_clashes(vault: DataFrame) -> DataFrame:
    """(session_id, token, values) of tokens that stand for two or more values. Must be empty before use."""
    return vault.groupBy("session_id", "token").agg(F.count_distinct("value_hash").alias("values")).filter("values > 1")


def upsert_vault(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by (session_id, token); the newer row wins."""
    both = old.select(*old.columns).unionByName(new.select(*old.columns))
    first = W.partitionBy("session_id", "token").orderBy(F.desc("created_at"))
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


# --- a vault on files ----------------------------------------------------------------------------------------
#
# path/rows/<write>/bucket=<n>/    rows whose (session_id, token) hash to that bucket, as one write left them
# path/versions/<number>/          one row for each bucket that holds rows: the write that it is to be read from
#
# A version is a table that appears whole or not at all, after all that it names is there. Readers take the newest.

BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("session_id", "token"), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> DataFrame:
    kind = "bucket int, buckets int, location string, columns string, version int"
    try:
        return spark.read.schema(kind).option("basePath", f"{path}/versions").json(f"{path}/versions/version=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def _newest(spark: SparkSession, path: str) -> list[Row]:
    """A row for each bucket: at most as many as there are buckets."""
    versions = _versions(spark, path)
    newest = versions.agg(F.max("version")).first()[0]
    return [] if newest is None else versions.filter(F.col("version") == newest).collect()


def _put(spark: SparkSession, path: str, rows: DataFrame, kept: list[Row], buckets: int, version: int) -> None:
    """Writes `rows` (with bucket) and then a version of them and of the buckets of `kept`."""
    location = f"rows/{uuid.uuid4().hex}"
    # empty buckets of a partitioned write leave nothing behind, so they are looked up
    rows.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/{location}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("bucket").schema)
    filled = [r["bucket"] for r in spark.read.schema(f"{columns}, bucket int").parquet(f"{path}/{location}").select("bucket").distinct().collect()]
    named = [(b, buckets, location, columns) for b in filled] + [(r["bucket"], buckets, r["location"], columns) for r in kept]
    table = spark.createDataFrame(named or [(-1, buckets, location, columns)], "bucket int, buckets int, location string, columns string")
    # fails if another writer was faster; what was written is then named nowhere
    table.coalesce(1).write.mode("errorifexists").json(f"{path}/versions/version={version}")


def write_vault(vault: DataFrame, path: str, mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    """A new version of the vault at `path` that holds these rows only (`overwrite`), or these and the ones there (`append`).

    Rows are dealt by the hash of (session_id, token), so one large session is written by many tasks.
    """
    spark = vault.sparkSession
    if mode == "append":
        upsert_into_vault(vault, path)
        return
    newest = _versions(spark, path).agg(F.max("version")).first()[0]
    _put(spark, path, vault.withColumn("bucket", _bucket(buckets)), [], buckets, (newest or 0) + 1)


def _read_buckets(spark: SparkSession, path: str, rows: list[Row]) -> DataFrame | None:
    rows = [r for r in rows if r["bucket"] >= 0]
    if not rows:
        return None
    places = [f"{path}/{r['location']}/bucket={r['bucket']}" for r in rows]
    return spark.read.schema(rows[0]["columns"]).parquet(*places)


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; older ones stay readable for those who have begun."""
    newest = _newest(spark, path)
    found = _read_buckets(spark, path, newest)
    return found if found is not None else spark.createDataFrame([], newest[0]["columns"] if newest else KINDS)


def upsert_into_vault(new: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Merges rows into the vault at `path`, the newer of equal (session_id, token). Only buckets that get rows are written again.

    The vault changes at once, when its next version appears; if anything fails before, readers see what was there.
    """
    spark, newest = new.sparkSession, _newest(new.sparkSession, path)
    buckets = newest[0]["buckets"] if newest else buckets
    version = (_versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    dealt = new.withColumn("bucket", _bucket(buckets)).persist()
    touched = {r["bucket"] for r in dealt.select("bucket").distinct().collect()}
    old = _read_buckets(spark, path, [r for r in newest if r["bucket"] in touched])
    merged = upsert_vault(old, new) if old is not None else upsert_vault(new.limit(0), new)
    _put(spark, path, merged.withColumn("bucket", _bucket(buckets)), [r for r in newest if r["bucket"] not in touched and r["bucket"] >= 0], buckets, version)
    dealt.unpersist()


def destroy_in_vault(spark: SparkSession, path: str, sessions: DataFrame) -> None:
    """Takes all rows of these sessions (session_id) out of the vault at `path`; only buckets that hold some are written again."""
    newest = [r for r in _newest(spark, path)]
    found = _read_buckets(spark, path, newest)
    if found is None:
        return
    buckets = newest[0]["buckets"]
    ended = sessions.select("session_id").distinct()
    touched = {r["bucket"] for r in found.join(ended, "session_id", "left_semi").select(_bucket(buckets).alias("bucket")).distinct().collect()}
    if touched:
        old = _read_buckets(spark, path, [r for r in newest if r["bucket"] in touched])
        version = _versions(spark, path).agg(F.max("version")).first()[0] + 1
        _put(spark, path, destroy_sessions(old, ended).withColumn("bucket", _bucket(buckets)), [r for r in newest if r["bucket"] not in touched and r["bucket"] >= 0], buckets, version)


def lookup_values(df: DataFrame, vault: DataFrame) -> DataFrame:
    """`df` (session_id, token) with the vault's row, if there is one in its own session."""
    return df.join(vault, ["session_id", "token"], "left")


def lookup_tokens(df: DataFrame, vault: DataFrame) -> DataFrame:
    """`df` (session_id, entity_type, value) with its token, if the session has stored the value."""
    keyed = df.withColumn("value_hash", value_hash(F.col("entity_type"), F.col("value")))
    return keyed.join(vault.select("session_id", "value_hash", "token"), ["session_id", "value_hash"], "left")


def count_access(vault: DataFrame, restores: DataFrame) -> DataFrame:
    """`vault` with access_count raised by the rows (session_id, token) of `restores`."""
    times = restores.groupBy("session_id", "token").agg(F.count(F.lit(1)).alias("_more"))
    return vault.join(times, ["session_id", "token"], "left").withColumn("access_count", F.col("access_count") + F.coalesce("_more", F.lit(0))).drop("_more")


def destroy_sessions(vault: DataFrame, sessions: DataFrame) -> DataFrame:
    return vault.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def expired_sessions(vault: DataFrame, ttl_seconds: int, now: Column) -> DataFrame:
    """(session_id, rows) of sessions whose newest entry is older than the time to live."""
    newest = vault.groupBy("session_id").agg(F.max("created_at").alias("newest"), F.count(F.lit(1)).alias("rows"))
    return newest.filter(F.unix_timestamp(now) - F.unix_timestamp("newest") > ttl_seconds).select("session_id", "rows")


def purge_expired(vault: DataFrame, ttl_seconds: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(vault without expired sessions, one row of how many sessions and rows went)."""
    gone = expired_sessions(vault, ttl_seconds, now)
    counts = gone.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return destroy_sessions(vault, gone), counts
