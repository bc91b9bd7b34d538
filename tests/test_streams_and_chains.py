"""Reordered chunks, sessions that end, the vault on files, resumed and long chains, busy clients, sketches."""

import json
import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pallium.operators import audit as A
from pallium.operators import vault as V
from pallium.streaming.jobs import chunk_stream, end_sessions, expired_stream, use_rocksdb

CHUNK = "stream_id string, seq long, delta string, last boolean"


def _files(folder, batches):
    """One JSON file for each micro-batch, in order of time."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i:03}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        time.sleep(0.02)


def _stream(spark, folder, kind):
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(folder))


def _until(query, done, seconds=150):
    deadline = time.time() + seconds
    while query.isActive and not done() and time.time() < deadline:
        time.sleep(0.3)
    failed = query.exception()
    query.stop()
    assert failed is None and done()


@pytest.fixture(scope="module")
def rocks(spark):
    use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_shuffled_chunks_over_batches_make_the_exact_text(rocks, tmp_path):
    rng = random.Random(4)
    texts = {f"n{i}": "".join(rng.choice(["word ", "{{SG_EMAIL_abcdef123456}}", "é, "]) for _ in range(60)) for i in range(3)}
    chunks = [{"stream_id": k, "seq": i, "delta": t[i * 9 : i * 9 + 9], "last": (i + 1) * 9 >= len(t)} for k, t in texts.items() for i in range(-(-len(t) // 9))]
    rng.shuffle(chunks)
    again = [dict(c) for c in chunks[:5]]
    _files(tmp_path / "in", [*[chunks[i::4] for i in range(4)], again])
    query = chunk_stream(_stream(rocks, tmp_path / "in", CHUNK), gap_ms=600_000).writeStream.format("memory").queryName("reordered").option("checkpointLocation", str(tmp_path / "c")).start()
    rows = lambda: rocks.table("reordered").collect()
    _until(query, lambda: len([r for r in rows() if r.text is None]) >= 5)
    for k, t in texts.items():
        parts = sorted((r for r in rows() if r.stream_id == k and r.text is not None), key=lambda r: r.part)
        assert "".join(r.text for r in parts) == t and [r.part for r in parts] == list(range(len(parts)))
        assert all(r.text.count("{{SG_") == r.text.count("}}") for r in parts), "no token is split"
    assert sorted(r.part for r in rows() if r.text is None) == sorted(-1 - c["seq"] for c in again), "repeated chunks are reported"


def test_a_gap_is_given_up_after_its_time(rocks, tmp_path):
    chunks = [{"stream_id": "a", "seq": i, "delta": f"<{i}>", "last": False} for i in (0, 1, 4, 5)]
    _files(tmp_path / "in", [chunks])
    query = chunk_stream(_stream(rocks, tmp_path / "in", CHUNK), tail=4, gap_ms=1500).writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    rows = lambda: rocks.table("gaps").collect()
    text = lambda: "".join(r.text for r in sorted(rows(), key=lambda r: r.part) if r.text is not None)
    _until(query, lambda: text() == "<0><1><4><5>")
    assert [r.part for r in rows() if r.text is None] == [-3], "chunk 2 and those behind it, in one row"


def test_sessions_end_by_event_time_and_take_their_rows_along(rocks, tmp_path):
    """s1 is renewed twice, s2 once; s3 goes on. The last event moves the watermark past the others' expiry."""
    at = lambda s: f"2024-01-01T00:{s // 60:02}:{s % 60:02}.000Z"
    batches = [[("s1", 0), ("s2", 10)], [("s1", 50), ("s3", 55)], [("s1", 100), ("s2", 105)], [("s3", 100), ("s3", 150)], [("s3", 200), ("s3", 250), ("s3", 300)], [("s3", 350)]]
    _files(tmp_path / "in", [[{"session_id": s, "ts": at(t)} for s, t in b] for b in batches])
    vault = rocks.createDataFrame([(f"s{i % 3 + 1}", f"t{i}", "h", bytearray(b"v"), "EMAIL", None, 0) for i in range(30)], V.KINDS)
    V.write_vault(vault, str(tmp_path / "vault"), buckets=8)
    told = []
    ended = expired_stream(_stream(rocks, tmp_path / "in", "session_id string, ts timestamp"), ttl_seconds=60, watermark="5 seconds")
    step = end_sessions(lambda events, epoch: told.extend(events.collect()), str(tmp_path / "vault"))
    query = ended.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c")).start()
    _until(query, lambda: {r.session_id for r in told} >= {"s1", "s2"})
    sessions = {(r.session_id, r.ts) for r in told}
    base = 1_704_067_200
    # s2 was seen at 10 and at 105: that is 95 seconds apart, so its first session had ended at 70
    assert sessions == {("s1", base + 160), ("s2", base + 70), ("s2", base + 165)} and {r.event for r in told} == {"SESSION_ENDED"}
    assert {r.session_id for r in V.read_vault(rocks, str(tmp_path / "vault")).collect()} == {"s3"}


def _vault(spark, rows, day):
    return spark.createDataFrame([(s, t, f"h{t}", bytearray(v.encode()), "EMAIL", None, 0) for s, t, v in rows], V.KINDS).withColumn("created_at", F.to_timestamp(F.lit(f"2024-01-{day:02}")))


def _held(spark, path):
    return {(r.session_id, r.token, bytes(r.encrypted_value).decode()) for r in V.read_vault(spark, path).collect()}


def test_upserts_write_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "vault")
    assert V.read_vault(spark, path).count() == 0 and V.read_vault(spark, path).columns == V.COLUMNS
    rows = [("hot", f"t{i}", "old") for i in range(200)] + [("s", "x", "old")]
    V.write_vault(_vault(spark, rows, 1), path, buckets=16)
    first = {r["bucket"]: r["location"] for r in V._newest(spark, path)}
    assert len(first) == 16, "one session lies in all buckets"
    V.upsert_into_vault(_vault(spark, [("hot", "t7", "new"), ("new", "y", "new")], 2), path)
    second = {r["bucket"]: r["location"] for r in V._newest(spark, path)}
    assert 1 <= sum(first.get(b) != p for b, p in second.items()) <= 2
    want = {(s, t, "new" if t == "t7" else v) for s, t, v in rows} | {("new", "y", "new")}
    assert _held(spark, path) == want
    V.upsert_into_vault(_vault(spark, [("hot", "t7", "older")], 1), path)
    assert _held(spark, path) == want, "an older row changes nothing"
    V.destroy_in_vault(spark, path, spark.createDataFrame([("hot",), ("nobody",)], "session_id string"))
    assert _held(spark, path) == {("s", "x", "old"), ("new", "y", "new")}
    V.write_vault(_vault(spark, [], 3), path)
    assert _held(spark, path) == set()
    V.upsert_into_vault(_vault(spark, [("a", "b", "c")], 3), path)
    assert _held(spark, path) == {("a", "b", "c")}


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "vault")
    V.write_vault(_vault(spark, [("s", "x", "old")], 1), path, buckets=4)
    held = V.read_vault(spark, path)
    failing = _vault(spark, [("s", "x", "new")], 2).withColumn("token", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("token")))
    with pytest.raises(Exception, match="lost"):
        V.upsert_into_vault(failing, path)
    assert _held(spark, path) == {("s", "x", "old")}
    V.upsert_into_vault(_vault(spark, [("s", "x", "new")], 2), path)
    assert {bytes(r.encrypted_value) for r in held.collect()} == {b"old"}, "who reads the old version still can"
    # two writers that saw the same version: the second fails, and loses nothing of the first
    with pytest.raises(AnalysisException):
        V._put(spark, path, _vault(spark, [("s", "x", "lost")], 3).withColumn("bucket", V._bucket(4)), [], 4, 2)
    assert _held(spark, path) == {("s", "x", "new")}


ENTRY = "chain_id string, ts double, timestamp string, event string, data string"


def test_resumed_chains_are_the_whole_chains(spark):
    rows = [(f"c{i % 3}", float(i), f"t{i}", "E", f'{{"n": {i}}}') for i in range(60)] + [("new", 100.0, "t", "E", "{}")]
    df = spark.createDataFrame(rows, ENTRY)
    whole = A.build_chain(df).persist()
    first = A.build_chain(df.filter("ts < 31")).persist()
    heads = A.chain_head(first).unionByName(spark.createDataFrame([("gone", 4, "x"), ("new", None, None)], "chain_id string, next_sequence int, last_hash string"))
    rest = A.build_chain(df.filter("ts >= 31"), heads=heads).persist()
    assert sorted(first.union(rest).collect()) == sorted(whole.collect()) and rest.filter("chain_id = 'gone'").isEmpty()
    assert all(r.valid for r in A.verify_chain(first.union(rest).withColumn("pos", F.col("sequence"))).collect())
    broken = first.withColumn("event", F.when(~((F.col("chain_id") == "c1") & (F.col("sequence") == 2)), F.col("event")))
    again = A.resume_heads(broken)
    assert {r.chain_id for r in again.collect()} == {"c0", "c2"}
    anew = A.build_chain(df.filter("ts >= 31"), heads=again).filter("sequence = 0").collect()
    assert {(r.chain_id, r.prev_hash) for r in anew} == {("c1", "GENESIS"), ("new", "GENESIS")}


def _plain_check(rows):
    """(valid, entries checked, first broken at, errors) of stored rows in order, by a loop; `tampered` rows have a changed hash."""
    prev, checked, errors, first = "GENESIS", 0, 0, None
    for pos, r, tampered in rows:
        wrong = 1
        if r["event"] is not None:
            wrong = int(tampered) + (r["prev_hash"] != prev)
            prev, checked = r["entry_hash"], checked + 1
        errors += wrong
        if wrong and first is None:
            first = r["sequence"] if r["event"] is not None else pos
    return errors == 0, checked, first, errors


def test_long_chains_are_checked_by_ranges(spark):
    rng = random.Random(1)
    rows = [(f"c{i % 10 // 9}", float(i), f"t{i}", "E", f'{{"n": {i}}}') for i in range(3000)]
    good = sorted(A.build_chain(spark.createDataFrame(rows, ENTRY)).collect(), key=lambda r: (r.chain_id, r.sequence))
    stored, plain = [], {"c0": [], "c1": []}
    for pos, r in enumerate(good):
        d, tampered, fate = r.asDict(), False, rng.random()
        if r.chain_id == "c1" or r.sequence < 1200:
            fate = 1
        if fate < 0.02:
            continue
        if fate < 0.05:
            d["event"] = None
        elif fate < 0.08:
            d["data"], tampered = '{"n": -1}', True
        stored.append({**d, "pos": pos})
        plain[r.chain_id].append((pos, d, tampered))
    kind = "chain_id string, sequence int, timestamp string, event string, data string, prev_hash string, entry_hash string, pos long"
    lines = spark.createDataFrame([tuple(x[c.split()[0]] for c in kind.split(", ")) for x in stored], kind).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = A.verify_chain(lines)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.chain_id: (r.valid, r.entries_checked, r.first_broken_at, r.errors) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {k: _plain_check(v) for k, v in plain.items()} and not got["c0"][0] and got["c1"][0]
    # windows are behind the tasks that read the lines, over their few rows; lines are dealt by ranges
    assert "rangepartitioning(chain" in plan and plan.index("Window") < plan.index("MapInArrow") and plan.count("Window ") == 1


def _plain_rates(calls, limit, window):
    held, out = {}, {}
    for client, i, t in sorted(calls, key=lambda c: (c[0], c[2], c[1])):
        h = held[client] = [x for x in held.get(client, []) if x > t - window]
        out[i] = len(h) < limit
        if out[i]:
            h.append(t)
    return out


def test_rates_of_a_busy_client_are_cut_by_ranges(spark):
    rng = random.Random(2)
    calls = [(rng.choice(["busy"] * 9 + ["a", "b"]), i, round(rng.expovariate(1) * 400, 1)) for i in range(3000)]
    df = spark.createDataFrame(calls, "client string, event_id long, ts double").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = A.rate_decisions(df, limit=2, window_s=1.5)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.event_id: r.allowed for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == _plain_rates(calls, 2, 1.5)
    assert "windowspecdefinition(client" not in plan and "windowspecdefinition(chunk" in plan


def test_sketches_merge_and_keep_their_bound(spark):
    rng = random.Random(8)
    rows = [(i, rng.paretovariate(1.5)) for i in range(40_000)]
    df = spark.createDataFrame(rows, "i int, duration double").withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i") * 4))
    five = A.duration_sketches(df).persist()
    days = A.sketched_p99(A.merged_sketches(five, "day"), limit=3.0).collect()
    assert len(days) == 2 and sum(r.n for r in days) == 40_000
    for r in days:
        day = sorted(d for i, d in rows if (i * 4) // 86_400 == (r.window_start.timestamp() - 1_704_067_200) // 86_400)
        rank = sum(d <= r.p99 for d in day) / len(day)
        assert abs(rank - 0.99) <= 1.7 / 400 and r.alert == (r.p99 > 3.0)
    # windows of up to k durations are exact
    one = A.sketched_p99(five).orderBy("window_start").first()
    assert one.n == 75 and one.p99 == sorted(d for i, d in rows[:75])[-(-99 * 75 // 100) - 1]
