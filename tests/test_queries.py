"""A few registered queries against DuckDB on the smallest tables, and the streaming jobs against their batch twins."""

import hashlib
import json
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pallium.operators import audit as A
from pallium.streaming.jobs import chunk_stream, join_parts, live_metrics, mask_stream, rate_stream, restore_stream, safe_cut

SF = "/root/testdata/sf0.001"
SOME = ["recognize_person_name", "mask_notes", "mask_leaks", "vault_build", "vault_written_and_read", "rate_decisions", "audit_written_and_read", "detect_with_failing_recognizer", "sensitivity_reasons", "restore_reformatted", "policy_masked_views", "sensitivity_scores", "chain_heads", "chain_resumed", "chain_verification", "metric_p99_by_day", "audit_events_of_a_run", "vault_upsert_on_files", "metric_active_sessions", "session_activity", "chat_request_texts"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("customer", "events", "documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = entry.queries()[name](spark, SF)
    expected = c.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(d[0] for d in expected.description)
    at = [[d[0] for d in expected.description].index(x) for x in columns]
    as_text = lambda r: tuple(repr(round(x, 6) if isinstance(x, float) else x) for x in r)
    assert sorted(as_text([r[x] for x in columns]) for r in found.collect()) == sorted(as_text([r[i] for i in at]) for r in expected.fetchall())


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    # all files come in one batch; with timeouts of state, the query would go on with empty ones
    deadline = time.time() + 120
    while q.isActive and time.time() < deadline and not any(p["numInputRows"] for p in q.recentProgress):
        time.sleep(0.3)
    q.stop()
    return df.sparkSession.table(name)


def test_masking_a_stream(spark, tmp_path):
    spark.createDataFrame([("s", "mail a@b.com"), ("s", "none")], "session_id string, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, text string").json(str(tmp_path / "in"))
    texts = {r.masked_text for r in _run(mask_stream(stream), "masked_stream").collect()}
    assert "none" in texts and any(t.startswith("mail {{SG_EMAIL_") for t in texts)


def test_chunks_never_split_tokens(spark, tmp_path):
    text = "x" * 90 + "{{SG_EMAIL_abcdef123456}}" + "y" * 150
    chunks = [("a", i, text[i * 7 : i * 7 + 7], i == 37) for i in range(38)]
    spark.createDataFrame(chunks, "stream_id string, seq long, delta string, last boolean").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id string, seq long, delta string, last boolean").json(str(tmp_path / "in"))
    parts = [r for r in _run(chunk_stream(stream), "parts").collect() if r.text is not None]
    assert "".join(r.text for r in sorted(parts, key=lambda r: r.part)) == text
    for n in range(len(text)):
        cut = safe_cut(text[:n], 20)
        assert 0 <= cut <= n and text[:cut].count("{{SG_") == text[:cut].count("}}")


def test_rates(spark, tmp_path):
    calls = [("a", i, float(i)) for i in range(10)] + [("b", 100, 0.0)]
    df = spark.createDataFrame(calls, "client string, event_id long, ts double")
    batch = {(r.event_id, r.allowed, r.remaining) for r in A.rate_decisions(df, limit=3, window_s=5.0).collect()}
    assert {e for e, ok, _ in batch if ok} == {0, 1, 2, 5, 6, 7, 100}
    df.write.json(str(tmp_path / "in"))
    stream = rate_stream(spark.readStream.schema(df.schema).json(str(tmp_path / "in")), 3, 5.0)
    assert {(r.event_id, r.allowed, r.remaining) for r in _run(stream, "rates").collect()} == batch


def test_live_metrics(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 10).cast("timestamp").alias("ts"), F.lit("x").alias("event_type"), (F.col("id") % 4 == 0).alias("failed"))
    df.write.parquet(str(tmp_path / "in"))
    q = live_metrics(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), watermark="0 seconds").writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.table("live").collect()
    assert out and all(r.n == 30 for r in out)


def test_chain_finds_tampering(spark):
    rows = [("c", float(i), f"t{i}", "E", '{"n": %d}' % i) for i in range(5)]
    chain = A.build_chain(spark.createDataFrame(rows, "chain_id string, ts double, timestamp string, event string, data string")).withColumn("pos", F.col("sequence") + 1)
    good = A.verify_chain(chain).first()
    assert good.valid and good.entries_checked == 5 and good.first_broken_at is None
    bad = A.verify_chain(chain.withColumn("data", F.when(F.col("sequence") == 2, "{}").otherwise(F.col("data")))).first()
    assert not bad.valid and bad.first_broken_at == 2
    lost = A.verify_chain(chain.filter("sequence <> 3")).first()
    assert not lost.valid and lost.first_broken_at == 4
    malformed = A.verify_chain(chain.withColumn("event", F.when(F.col("sequence") != 1, F.col("event")))).first()
    assert malformed.first_broken_at == 2 and malformed.entries_checked == 4


def test_chain_streams_long_chains(spark):
    rows = [(f"c{i % 2}", float(i // 2), f"t{i}", 'a"b\\\\', f'{{"n": {i}}}') for i in range(8000)]
    df = spark.createDataFrame(rows, "chain_id string, ts double, timestamp string, event string, data string").repartition(3)
    chain = A.build_chain(df)
    assert "collect_list" not in chain._jdf.queryExecution().toString(), "no chain is gathered in one row"
    checked = A.verify_chain(chain.withColumn("pos", F.col("sequence"))).collect()
    assert [(r.valid, r.entries_checked) for r in checked] == [(True, 4000)] * 2
    assert all(r.data == f'{{"n": {2 * r.sequence + int(r.chain_id[1])}}}' for r in chain.collect())


def test_chunks_share_the_vault_of_their_session(spark):
    from pallium.streaming.jobs import restore_chunks

    token = "{{SG_EMAIL_0123456789ab}}"
    kept = spark.createDataFrame([("s", token, "a@b.c")], "session_id string, token string, value string")
    chunks = spark.createDataFrame([(f"n{i}", "s", k, part) for i in range(3) for k, part in enumerate([f"{i} {token[:5]}", token[5:]])], "stream_id string, session_id string, seq int, delta string")
    out = restore_chunks(chunks, kept, session_col="session_id")
    assert out.count() == 3 and set(out.columns) >= {"stream_id", "session_id", "restored_text"}


def test_chain_hashes_are_those_of_sorted_ascii_json(spark):
    """Accents, emojis, control characters, quotes and backslashes, in events and in data."""
    odd = ["plain", 'a"b\\c', "é\u0301 à", "日本 🎉", "line\nfeed\ttab\r\x00\x1f\x7f\b\f", ""]
    rows = [("c", float(i), f"t{i} é", e, json.dumps({"z": e, "a": [1, {"é": None}]}, ensure_ascii=False)) for i, e in enumerate(odd)]
    chain = A.build_chain(spark.createDataFrame(rows, "chain_id string, ts double, timestamp string, event string, data string")).persist()
    prev = "GENESIS"
    for r, (_, _, at, event, data) in zip(sorted(chain.collect(), key=lambda r: r.sequence), rows, strict=True):
        entry = {"sequence": r.sequence, "timestamp": at, "event": event, "data": json.loads(data), "prev_hash": prev}
        prev = hashlib.sha256(json.dumps(entry, sort_keys=True).encode()).hexdigest()
        assert r.entry_hash == prev
    assert A.verify_chain(chain.withColumn("pos", F.col("sequence"))).first().valid, "the Column form escapes alike"


def test_a_masked_stream_is_cut_and_restored(spark, tmp_path):
    """Chunks of a stream become parts, and the join with the vault restores these."""
    token = "{{SG_EMAIL_0123456789ab}}"
    texts = {f"n{i}": "x" * (i * 40) + f" {token} and {token}, " + "y" * 130 for i in range(4)}
    chunks = [(k, i, t[i * 9 : i * 9 + 9], (i + 1) * 9 >= len(t)) for k, t in texts.items() for i in range(-(-len(t) // 9))]
    spark.createDataFrame(chunks, "stream_id string, seq long, delta string, last boolean").write.json(str(tmp_path / "in"))
    vault = spark.createDataFrame([(k, token, f"{k}@b.c") for k in texts], "session_id string, token string, value string")
    stream = spark.readStream.schema("stream_id string, seq long, delta string, last boolean").json(str(tmp_path / "in"))
    parts = _run(chunk_stream(stream), "parts_to_restore")
    assert {r.stream_id: r.text for r in join_parts(restore_stream(parts, vault)).collect()} == {k: t.replace(token, f"{k}@b.c") for k, t in texts.items()}


def test_busy_clients_are_cut_at_pauses(spark):
    calls = spark.createDataFrame([("a", i, float(100 * (i // 5) + i % 5)) for i in range(200)], "client string, event_id long, ts double")
    out = A.rate_decisions(calls, limit=3, window_s=50.0)
    assert "_stretch" in out._jdf.queryExecution().executedPlan().toString()
    assert [r.allowed for r in sorted(out.collect(), key=lambda r: r.event_id)] == [i % 5 < 3 for i in range(200)]
