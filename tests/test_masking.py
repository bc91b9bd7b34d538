"""Masking, vault, restoration, policies and sensitivity."""

import pytest
from pyspark.sql import functions as F

from pallium.operators import policy as P
from pallium.operators.detect import detect, detections
from pallium.operators.mask import mask, normalize_type, split_failed, token
from pallium.operators.restore import restore, round_trip
from pallium.operators.sensitivity import sensitivity
from pallium.operators.leaks import leaks, pieces_of_values
from pallium.operators.vault import build_vault, purge_expired, read_vault, seal, token_clashes, unseal, upsert_vault, write_vault


@pytest.fixture(scope="module")
def masked(spark):
    rows = [(1, "s1", "mail a@b.com, again a@b.com"), (2, "s2", "mail a@b.com"), (3, "s1", "nothing"), (4, "s1", None), (5, "s2", "+1 (743) 555-3824 rings")]
    return mask(detect(spark.createDataFrame(rows, "id int, session_id string, text string"))).persist()


@pytest.fixture(scope="module")
def vault(masked):
    return build_vault(detections(masked, ["id", "session_id"])).persist()


def test_tokens_by_session(masked, vault):
    rows = {r.id: r for r in masked.collect()}
    first = rows[1].masked_text
    assert first.count("{{SG_EMAIL_") == 2 and len(set(first.replace(",", " ").split()[1::2])) == 1
    assert rows[2].masked_text.split()[1] not in first
    assert rows[3].masked_text == "nothing" and rows[4].masked_text is None and not rows[3].had_pii
    assert token_clashes(vault).isEmpty()


def test_round_trip(masked, vault):
    assert round_trip(masked.select("id", "session_id", "text", "masked_text"), vault).isEmpty()


def test_other_sessions_restore_nothing(spark, masked, vault):
    t = masked.filter("id = 1").select(F.lit("s2").alias("session_id"), F.col("masked_text").alias("text"))
    row = restore(t, vault).first()
    assert row.tokens_restored == 0 and row.tokens_not_found == 2


def test_reformatted_tokens_and_completeness(spark):
    vault = spark.createDataFrame([("s", "{{SG_EMAIL_deadbeef}}", "a@b.c"), ("s", "{{SG_TN_PHONE_abcdef12}}", "+216")], "session_id string, token string, value string")
    sent = ["{{SG_EMAIL_deadbeef}}", "{{SG_TN_PHONE_abcdef12}}"]
    cases = [("SG EMAIL deadbeef", "a@b.c"), ("[SG_EMAIL_deadbeef]", "a@b.c"), ("`SG_EMAIL_deadbeef`", "a@b.c"), ("SG-TN PHONE-abcdef12 x", "+216 x"), ("{{SG_EMAIL_deadbeef}} SG EMAIL deadbeef", "a@b.c SG EMAIL deadbeef")]
    df = spark.createDataFrame([(i, "s", c[0], sent) for i, c in enumerate(cases)], "i int, session_id string, text string, sent array<string>")
    for r in restore(df, vault, tokens_sent="sent").collect():
        assert r.restored_text == cases[r.i][1], cases[r.i]
        assert r.completeness == 0.5 and len(r.unreplaced) == 1


def test_encryption(spark):
    key = F.unhex(F.lit("00" * 32))
    row = spark.createDataFrame([("abc",)], "v string").select(seal(F.col("v"), key).alias("s")).select("s", unseal(F.col("s"), key).alias("v")).first()
    assert len(row.s) == 31 and row.v == "abc"


def test_upsert_and_purge(spark, vault):
    old = vault.withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    both = upsert_vault(old, vault)
    assert both.count() == vault.count() and both.filter("created_at < '2000-01-01'").isEmpty()
    kept, counts = purge_expired(old, 3600, F.timestamp_seconds(F.lit(4000)))
    assert kept.isEmpty() and counts.first().sessions == 2
    assert purge_expired(old, 10**6, F.timestamp_seconds(F.lit(4000)))[1].first().sessions == 0


def test_failures_go_to_quarantine(spark):
    df = spark.createDataFrame([(1, "secret", None), (2, "x", "x"), (3, None, None)], "id int, text string, masked_text string")
    ok, bad = split_failed(df, ["id"])
    assert {r.id for r in ok.collect()} == {2, 3} and bad.columns == ["id", "reason"] and bad.first().id == 1


def test_leaks_send_no_table_through_the_driver(spark):
    texts = spark.createDataFrame([(1, "s", "mail a@b.com"), (2, "s", "none")], "id int, session_id string, masked_text string")
    values = spark.createDataFrame([("s", "EMAIL", "a@b.com"), ("s", "EMAIL", "c@b.com")], "session_id string, entity_type string, text string")
    pieces = pieces_of_values(values.withColumnRenamed("text", "_value"), "session_id")
    found = leaks(texts, values, ["id"])
    assert pieces.count() == 2 and [tuple(r) for r in found.collect()] == [(1, "EMAIL")]
    for df in (pieces, found):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_failed_rows_are_told_without_another_detection(spark):
    texts = spark.createDataFrame([(1, "s", "mail a@b.com"), (2, "s", "none"), (3, "s", None)], "id int, session_id string, text string")
    plain = mask(detect(texts))
    ok, bad = split_failed(plain.withColumn("masked_text", F.when(F.col("id") != 2, F.col("masked_text"))), ["id"])
    assert [tuple(r) for r in bad.collect()] == [(2, "masking failed")] and sorted(r.id for r in ok.collect()) == [1, 3] and ok.columns == plain.columns
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("@[a-zA-Z0-9.")
    assert 0 < scans(plain) == scans(bad) == scans(ok)


def test_token_forms(spark):
    row = spark.range(1).select(token(F.lit("s"), F.lit("tn-national id"), F.lit("v"), 8).alias("t"), normalize_type(F.lit(" tn - phone ")).alias("n")).first()
    assert row.t.startswith("{{SG_TN_NATIONAL_ID_") and len(row.t) == len("{{SG_TN_NATIONAL_ID_}}") + 8 and row.n == "TN_PHONE"
    with pytest.raises(ValueError):
        token(F.lit("s"), F.lit("t"), F.lit("v"), 5)


CONDITIONS = [
    (("value_length", "gt", "3"), "abcd", True),
    (("value_length", "gt", "3"), "abc", False),
    (("numeric_value", "lte", "10000"), "10,000 TND", True),
    (("numeric_value", "gt", "10000"), "1.2.3", True),
    (("numeric_value", "eq", "0"), "none", True),
    (("pattern", "matches", "^AB"), "abc", True),
    (("pattern", "matches", "^x"), "abc", False),
    (("pattern", "contains", "x"), "abc", True),
    (("else", "gt", "1"), "abc", True),
]


def test_conditions(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CONDITIONS)], f"i int, c {P.CONDITION}, v string")
    for r in df.select("i", P.condition_holds(F.col("c"), F.col("v")).alias("ok")).collect():
        assert r.ok is CONDITIONS[r.i][2], CONDITIONS[r.i]


def test_sensitivity(spark):
    cases = [([], 0.0), (["EMAIL"], 0.1), (["PERSON_NAME", "FR_NIR"], 0.825), (["X", "Y"], 0.2), (["EMAIL", "PHONE", "PERSON_NAME", "IBAN"], 1.0), (["EMAIL", "PHONE", "PERSON_NAME"], 0.35 * 1.3), (["CREDIT_CARD"] * 9, 1.0)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t array<string>")
    for r in df.select("i", sensitivity(F.col("t")).alias("s")).collect():
        assert r.s.score == pytest.approx(cases[r.i][1])


def test_leaks_look_through_the_session(spark):
    texts = [(1, "s1", "safe"), (2, "s1", "has Jean Dupont within"), (3, "s2", "has Jean Dupont within"), (4, "s1", None), (5, "s1", "only 7x"), (6, "s1", "a Jean Dupon")]
    masked = spark.createDataFrame(texts, "id int, session_id string, masked_text string")
    found = spark.createDataFrame([(1, "s1", "PERSON_NAME", "Jean Dupont"), (1, "s1", "CODE", "7x"), (3, "s2", "EMAIL", "a@b.com")], "id int, session_id string, entity_type string, text string")
    assert {tuple(r) for r in leaks(masked, found, ["id"]).collect()} == {(2, "PERSON_NAME"), (5, "CODE")}


def test_vault_and_policies_are_written_and_read(spark, vault, tmp_path):
    write_vault(vault, str(tmp_path / "vault"))
    assert sorted(read_vault(spark, str(tmp_path / "vault")).collect()) == sorted(vault.collect())
    (tmp_path / "p.json").write_text('{"policies": [{"name": "x", "rules": []}],\n "role_bindings": [{"api_key": "k", "role": "r", "policy": "x"}]}')
    policies, bindings = P.load_policies(spark, str(tmp_path / "p.json"))
    assert policies.first().default_action == "mask" and tuple(bindings.first()) == ("k", "r", "x")


def test_texts_and_audit_lines_are_read(spark, tmp_path):
    from pallium.sources.audit_log import read_audit, write_audit
    from pallium.sources.chat import read_texts

    spark.createDataFrame([(1, "t", 5)], "k int, text string, other int").write.json(str(tmp_path / "t"))
    assert read_texts(spark, str(tmp_path / "t"), ["k"], "text", "json").collect() == [(1, "t")]
    events = spark.createDataFrame([(5.5, "E", "s", 3)], "timestamp double, event string, session_id string, entity_count long")
    write_audit(events, str(tmp_path / "a"))
    row = read_audit(spark, str(tmp_path / "a")).first()
    assert (row.ts, row.event, row.session_id, row.entity_count) == (5.5, "E", "s", 3)
    with pytest.raises(ValueError, match="text"):
        write_audit(events.withColumn("text", F.lit("secret")), str(tmp_path / "b"))


def test_texts_without_tokens_are_not_shuffled(spark):
    vault = spark.createDataFrame([("s", "{{SG_EMAIL_0123456789ab}}", "a@b.c")], "session_id string, token string, value string")
    rows = [(i, "s", t) for i, t in enumerate(["OK", None, "", "sg", "{{SG_EMAIL_0123456789ab}}", "{{SG_EMAIL_0123456789ab}}"])] + [(9, None, "{{SG_EMAIL_0123456789ab}}"), (10, "other", "{{SG_EMAIL_0123456789ab}}")]
    df = spark.createDataFrame(rows, "id int, session_id string, text string")
    for tiers in (("exact",), ("exact", "fuzzy_bracket", "bare_extraction")):
        out = restore(df, vault, tiers=tiers)
        got = {r.id: (r.restored_text, r.tokens_restored, r.tokens_not_found) for r in out.collect()}
        token = rows[-1][2]
        assert got == {0: ("OK", 0, 0), 1: (None, 0, 0), 2: ("", 0, 0), 3: ("sg", 0, 0), 4: ("a@b.c", 1, 0), 5: ("a@b.c", 1, 0), 9: (token, 0, 1), 10: (token, 0, 1)}
    plan = restore(df, vault, tiers=("exact",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "NOT coalesce(RLIKE(text" in plan


def test_only_the_texts_of_a_body_change(spark):
    from pallium.sources.chat import _place, _steps, request_texts, set_texts

    body = '{ "temperature": 1.50e0,\n "big": 12345678901234567890, "a.b": {"x": [1, {"text": "old\\u00e9"}]},  "messages": [ {"role":"user","content":"one"} , {"content": [{"type":"image_url"},{"type": "text", "text" : "two"}]}], "esc": "\\u0041\\/", "prompt": "p" }'
    new = [("messages[0].content", 'a "b"\n'), ("messages[1].content[1].text", "zwei €"), ("prompt", ""), ("['a.b'].x[1].text", None)]
    df = spark.createDataFrame([(1, body), (2, body), (3, None)], "request_id int, body string")
    out = {r.request_id: r.body for r in set_texts(df, spark.createDataFrame([(1, p, t) for p, t in new] + [(3, "prompt", "x")], "request_id int, path string, text string")).collect()}
    want = body.replace('"one"', '"a \\"b\\"\\n"').replace('"two"', '"zwei €"').replace('"prompt": "p"', '"prompt": ""').replace('"old\\u00e9"', "null")
    assert out == {1: want, 2: body, 3: None}
    # every path that is read can be written
    for r in request_texts(df.filter("request_id = 1")).collect():
        begin, end = _place(body, _steps(r.path))
        assert body[begin:end] == f'"{r.text}"'
    for path in ("nothing", "messages[7].content", "prompt.x", "messages.x"):
        with pytest.raises(KeyError):
            _place(body, _steps(path))
    assert _steps("a[0]['b.c\\'d'].e") == ["a", 0, "b.c'd", "e"]


def test_stored_notes_are_masked_once(spark):
    from pallium.plans.queries import QUERIES

    for name in ("audit_events_of_a_run", "restore_completeness", "restore_exact", "chat_stream_restored"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "[REDACTED]" not in plan, name
