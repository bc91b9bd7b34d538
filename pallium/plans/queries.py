"""Registered queries over the given tables, each with the SQL that recomputes it where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.functions import patterns as P
from pallium.functions.recognizers import OPTIONAL, RECOGNIZERS, PythonRecognizer
from pallium.functions.recognizers import pattern as user_pattern
from pallium.operators import audit as A
from pallium.operators import policy as POL
from pallium.operators.detect import detect, detections, spread
from pallium.operators.mask import mask, split_failed
from pallium.operators.restore import restore, restore_distinct, round_trip
from pallium.operators.storage import new_path
from pallium.operators.sensitivity import most_sensitive, route, sensitivity
from pallium.operators.leaks import leaks
from pallium.operators.vault import build_vault, count_access, destroy_in_vault, destroy_sessions, lookup_tokens, lookup_values, purge_expired, read_vault, token_clashes, upsert_into_vault, upsert_vault, write_vault
from pallium.plans import derived as D
from pallium.plans import oracles as O
from pallium.sources import chat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.sql(D.NOTES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(chat.read_texts(spark, f"{sf_dir}/documents.parquet", ["doc_id", "source"], "text")).selectExpr("doc_id AS id", "source AS session_id", "text")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return new_path(spark, name)


def long_form(df: DataFrame) -> DataFrame:
    return detections(df, ["id"]).select("id", "entity_type", "start", "end", F.round("score", 6).alias("score"), "text")


# --- recognizers ---------------------------------------------------------------------------------------------


def _recognize(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    r = next(x for x in [*RECOGNIZERS, *OPTIONAL] if x.name == name)
    return long_form(notes(spark, sf_dir).withColumn("spans", r.recognize(F.col("text"))))


for _r in RECOGNIZERS:
    QUERIES[f"recognize_{_r.name}"] = partial(_recognize, name=_r.name)
    ORACLES[f"recognize_{_r.name}"] = O.recognize_sql(_r.name)
QUERIES["recognize_tn_person_name"] = partial(_recognize, name="tn_person_name")
ORACLES["recognize_tn_person_name"] = rf"""WITH src AS ({D.NOTES}), h AS (
  SELECT id, regexp_extract(text, '\bDr\.?\s+([A-Z][a-z]{{2,}}(\s+(Ben|ben|Bin|bin|Ibn|ibn)\s+[A-Z][a-z]{{2,}})?(\s+[A-Z][a-z]{{2,}})?)', 1) AS v, text FROM src)
SELECT id, 'PERSON_NAME' AS entity_type, (strpos(text, concat('Dr ', v)) + 2)::INT AS "start", (strpos(text, concat('Dr ', v)) + 2 + length(v))::INT AS "end", 0.84::DOUBLE AS score, v AS text FROM h WHERE v <> ''"""

_LONG = 'SELECT id, x.etype AS entity_type, x.s AS "start", x.e AS "end", round(x.score, 6) AS score, x.v AS text FROM (SELECT id, unnest(xs) AS x FROM resolved)'


@query("detect_notes", f"WITH {O.resolved_ctes(D.NOTES)} {_LONG}")
def detect_notes(spark, sf_dir):
    return long_form(detect(notes(spark, sf_dir)))


_PLAIN = ["email", "phone", "credit_card", "iban", "ip_address"]


# RE2 knows ASCII word borders only, so a blank before a letter like e-acute ends a match there: compare the ends of values
_ENDS = _LONG.replace('x.e AS "end"', 'x.s + length(x.v) AS "end"')


@query("detect_documents", f"WITH {O.resolved_ctes(D.DOCUMENTS)} {_ENDS}")
def detect_documents(spark, sf_dir):
    return long_form(detect(documents(spark, sf_dir))).withColumn("end", (F.col("start") + F.length("text")).cast("long"))


@query("detect_document_contacts", f"WITH {O.resolved_ctes(D.DOCUMENTS, _PLAIN)} {_ENDS}")
def detect_document_contacts(spark, sf_dir):
    from pallium.operators.detect import all_spans, boost_locale, resolve_overlaps

    chosen = [r for r in RECOGNIZERS if r.name in _PLAIN]
    found = documents(spark, sf_dir)
    out = long_form(found.withColumn("spans", resolve_overlaps(boost_locale(F.concat(*all_spans(F.col("text"), chosen))))))
    return out.withColumn("end", (F.col("start") + F.length("text")).cast("long"))


@query("detect_french_only", "WITH f AS (" + f"WITH {O.resolved_ctes(D.NOTES, [r.name for r in RECOGNIZERS if r.locale == 'fr'])} {_LONG}" + ") SELECT * FROM f")
def detect_french_only(spark, sf_dir):
    return long_form(detect(notes(spark, sf_dir), locales=["fr"]))


def _fails_on_cards(text: str):
    if "card" in text:
        raise ValueError("cannot read this")
    return [("NOTE", 0, 4, 0.9)]


@query("detect_with_failing_recognizer", f"WITH {O.resolved_ctes(D.NOTES)} SELECT src.id, CASE WHEN contains(text, 'card') THEN 'fails_on_cards' ELSE '' END AS errors, (coalesce(len(xs), 0) + CASE WHEN contains(text, 'card') THEN 0 ELSE 1 END)::INT AS entities FROM src LEFT JOIN resolved ON src.id = resolved.id")
def detect_with_failing_recognizer(spark, sf_dir):
    """A user's recognizer that raises on some texts: all others' spans stay, and its name is among the errors."""
    out = detect(notes(spark, sf_dir), python=[PythonRecognizer("fails_on_cards", _fails_on_cards)])
    return out.select("id", F.array_join("errors", ",").alias("errors"), F.size("spans").alias("entities"))


@query("custom_recognizer", rf"""SELECT c_custkey AS id, 'CUSTOMER_NO' AS entity_type, 0 AS "start", length(c_name)::INT AS "end", 0.9::DOUBLE AS score, c_name AS text FROM customer""")
def custom_recognizer(spark, sf_dir):
    own = user_pattern("customer_no", "CUSTOMER_NO", "universal", 50, r"customer#\d{9}", 0.9)
    named = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS text")
    return long_form(detect(named, locales=[], extra=[own]))


# --- masking and vault ---------------------------------------------------------------------------------------


def masked_notes(spark, sf_dir) -> DataFrame:
    return mask(detect(notes(spark, sf_dir)))


def note_detections(spark, sf_dir) -> DataFrame:
    return detections(detect(notes(spark, sf_dir)), ["id", "session_id"])


def note_vault(spark, sf_dir) -> DataFrame:
    return build_vault(note_detections(spark, sf_dir), created_at=F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))


class StoredNotes:
    """Notes with their spans, and masked if so wished, written once for queries that read them several times."""

    def __init__(self, spark: SparkSession, sf_dir: str, masked: bool = False):
        path = scratch(spark, "spans")
        found = detect(notes(spark, sf_dir))
        found = mask(found) if masked else found
        found.write.parquet(path)
        self.spans = spark.read.schema(found.schema).parquet(path)

    def masked(self) -> DataFrame:
        return self.spans if "masked_text" in self.spans.columns else mask(self.spans)

    def detections(self) -> DataFrame:
        return detections(self.spans, ["id", "session_id"])

    def vault(self) -> DataFrame:
        return build_vault(self.detections(), created_at=F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))


_MASKED = f"WITH {O.masked_ctes(D.NOTES)}"


@query("mask_notes", f"{_MASKED} SELECT id, masked_text, len(xs)::INT AS entity_count, array_to_string(list_sort(list_distinct(list_transform(xs, lambda x: x.etype))), ',') AS entity_types, len(xs) > 0 AS had_pii FROM masked")
def mask_notes(spark, sf_dir):
    return masked_notes(spark, sf_dir).select("id", "masked_text", "entity_count", F.array_join("entity_types", ",").alias("entity_types"), "had_pii")


@query("mask_stream_twin", f"{_MASKED} SELECT id, masked_text FROM masked")
def mask_stream_twin(spark, sf_dir):
    """The streaming job on a table: it is the same expression."""
    from pallium.streaming.jobs import mask_stream

    return mask_stream(notes(spark, sf_dir)).select("id", "masked_text")


@query("mask_bypass", f"SELECT id, text AS masked_text, 0 AS entity_count FROM ({D.NOTES})")
def mask_bypass(spark, sf_dir):
    return mask(detect(notes(spark, sf_dir)), bypass=True).select("id", "masked_text", "entity_count")


@query("mask_documents", f"WITH {O.masked_ctes(D.DOCUMENTS).removeprefix('WITH ')} SELECT id, masked_text, len(xs)::INT AS entity_count FROM masked")
def mask_documents(spark, sf_dir):
    return mask(detect(documents(spark, sf_dir))).select("id", "masked_text", "entity_count")


_VAULT = f"WITH {O.resolved_ctes(D.NOTES)}, {O.SPANS}, {O.VAULT}"


@query("vault_build", f"{_VAULT} SELECT session_id, token, value_hash, value, entity_type FROM vault")
def vault_build(spark, sf_dir):
    return note_vault(spark, sf_dir).select("session_id", "token", "value_hash", "value", "entity_type")


@query("vault_sealed_round_trip", f"{_VAULT} SELECT session_id, token, value FROM vault")
def vault_sealed_round_trip(spark, sf_dir):
    from pallium.operators.vault import unseal

    key = F.unhex(F.substring(F.sha2(F.lit("key of this test"), 256), 1, 32))
    vault = build_vault(note_detections(spark, sf_dir), key=key)
    return vault.select("session_id", "token", unseal(F.col("encrypted_value"), key).alias("value"))


@query("vault_token_clashes", f"{_VAULT} SELECT session_id, token, 2::BIGINT AS \"values\" FROM vault WHERE session_id = 's7'")
def vault_token_clashes(spark, sf_dir):
    """The tokens of one session stand for other values as well."""
    n = StoredNotes(spark, sf_dir)
    vault = n.vault()
    return token_clashes(vault.union(vault.filter("session_id = 's7'").withColumn("value_hash", F.reverse("value_hash"))))


@query("vault_written_and_read", f"{_VAULT} SELECT session_id, token, value FROM vault")
def vault_written_and_read(spark, sf_dir):
    path = scratch(spark, "vault")
    write_vault(note_vault(spark, sf_dir), path)
    return read_vault(spark, path).select("session_id", "token", "value")


@query("vault_upsert", f"{_VAULT} SELECT session_id, token, CASE WHEN entity_type = 'EMAIL' THEN 7 ELSE 0 END::BIGINT AS access_count FROM vault")
def vault_upsert(spark, sf_dir):
    """Newer rows of some tokens take the place of older ones."""
    n = StoredNotes(spark, sf_dir)
    old = n.vault()
    new = old.filter("entity_type = 'EMAIL'").withColumns({"created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY"), "access_count": F.lit(7).cast("long")})
    return upsert_vault(old, new).select("session_id", "token", "access_count")


@query("vault_upsert_on_files", f"{_VAULT} SELECT session_id, token, CASE WHEN entity_type = 'EMAIL' THEN 7 ELSE 0 END::BIGINT AS access_count FROM vault WHERE substr(session_id, 2)::INT % 3 <> 0")
def vault_upsert_on_files(spark, sf_dir):
    """Newer rows of some tokens are merged into a stored vault, then some sessions are taken out of it."""
    path = scratch(spark, "vault")
    write_vault(note_vault(spark, sf_dir), path)
    old = read_vault(spark, path)
    upsert_into_vault(old.filter("entity_type = 'EMAIL'").withColumns({"created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY"), "access_count": F.lit(7).cast("long")}), path)
    destroy_in_vault(spark, path, old.select("session_id").filter(F.substring("session_id", 2, 9).cast("int") % 3 == 0))
    return read_vault(spark, path).select("session_id", "token", "access_count")


@query("vault_lookup_tokens", f"{_VAULT} SELECT x.session_id, x.id, v.token FROM (SELECT id, session_id, x.etype AS entity_type, x.v AS value FROM detected) x JOIN vault v ON x.session_id = v.session_id AND x.entity_type = v.entity_type AND x.value = v.value")
def vault_lookup_tokens(spark, sf_dir):
    n = StoredNotes(spark, sf_dir)
    asked = n.detections().select("id", "session_id", "entity_type", F.col("text").alias("value"))
    return lookup_tokens(asked, n.vault()).select("session_id", "id", "token")


@query("vault_lookup_values", f"{_VAULT} SELECT concat('s', (substr(session_id, 2)::INT % 25)::VARCHAR) AS session_id, token, CASE WHEN substr(session_id, 2)::INT < 25 THEN value END AS value FROM vault")
def vault_lookup_values(spark, sf_dir):
    """Tokens asked for in another session find nothing there."""
    n = StoredNotes(spark, sf_dir)
    vault = n.vault()
    asked = vault.select(F.concat(F.lit("s"), (F.substring("session_id", 2, 9).cast("int") % 25).cast("string")).alias("session_id"), "token")
    return lookup_values(asked, vault).select("session_id", "token", "value")


@query("vault_access_counts", f"{_VAULT} SELECT session_id, token, times::BIGINT AS access_count FROM vault")
def vault_access_counts(spark, sf_dir):
    n = StoredNotes(spark, sf_dir)
    found = n.detections()
    vault = n.vault()
    read = lookup_tokens(found.select("session_id", "entity_type", F.col("text").alias("value")), vault)
    return count_access(vault, read).select("session_id", "token", "access_count")


@query("vault_destroy_sessions", f"{_VAULT} SELECT session_id, count(*) AS n FROM vault WHERE substr(session_id, 2)::INT % 3 <> 0 GROUP BY session_id")
def vault_destroy_sessions(spark, sf_dir):
    n = StoredNotes(spark, sf_dir)
    vault = n.vault()
    ended = vault.select("session_id").filter(F.substring("session_id", 2, 9).cast("int") % 3 == 0)
    return destroy_sessions(vault, ended).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


_NEWEST = "SELECT session_id, max(id) AS newest, count(DISTINCT concat(x.etype, ':', x.v)) AS n FROM detected GROUP BY session_id"


@query("vault_purge_expired", f"{_VAULT}, v AS (SELECT session_id, x.etype, x.v, min(id) AS created FROM detected GROUP BY ALL), s AS (SELECT session_id, max(created) AS newest, count(*) AS n FROM v GROUP BY session_id) SELECT count(*) AS sessions, coalesce(sum(n), 0)::BIGINT AS rows FROM s WHERE 3600 + 1480 - newest > 3600")
def vault_purge_expired(spark, sf_dir):
    return purge_expired(note_vault(spark, sf_dir), 3600, F.timestamp_seconds(F.lit(1_700_000_000 + 3600 + 1480)))[1]


@query("mask_quarantine", f"SELECT id, 'masking failed' AS reason FROM ({D.NOTES}) WHERE id % 7 = 0")
def mask_quarantine(spark, sf_dir):
    failing = masked_notes(spark, sf_dir).withColumn("masked_text", F.when(F.col("id") % 7 != 0, F.col("masked_text")))
    return split_failed(failing, ["id"])[1]


@query("mask_leaks", f"{_MASKED}, kept AS (SELECT id, session_id, CASE WHEN id % 10 = 3 THEN text ELSE masked_text END AS t FROM masked), v AS (SELECT DISTINCT session_id, x.etype AS entity_type, x.v AS value FROM (SELECT session_id, unnest(xs) AS x FROM masked)) SELECT DISTINCT id, entity_type FROM kept JOIN v ON kept.session_id = v.session_id AND contains(t, value)")
def mask_leaks(spark, sf_dir):
    """Every tenth note went out unmasked: found are its own values, and those of other notes of its session."""
    n = StoredNotes(spark, sf_dir, masked=True)
    out = n.masked().withColumn("masked_text", F.when(F.col("id") % 10 == 3, F.col("text")).otherwise(F.col("masked_text")))
    return leaks(out, n.detections(), ["id"])


# --- restoration ---------------------------------------------------------------------------------------------


@query("restore_exact", f"{_MASKED} SELECT id, text AS restored_text, len(xs)::INT AS tokens_restored, 0 AS tokens_not_found FROM masked")
def restore_exact(spark, sf_dir):
    n = StoredNotes(spark, sf_dir, masked=True)
    out = restore(n.masked().select("id", "session_id", "masked_text"), n.vault(), "masked_text", tiers=("exact",))
    return out.select("id", "restored_text", "tokens_restored", "tokens_not_found")


def _reformatted(df: DataFrame) -> DataFrame:
    """Tokens as a model may write them: by id in other brackets, in code quotes, bare, or as they were."""
    t = F.col("masked_text")
    inside = r"\{\{(SG_[A-Z_]+_[a-f0-9]+)\}\}"
    return df.withColumn("reply", F.when(F.col("id") % 4 == 0, F.regexp_replace(t, inside, "[ $1 ]")).when(F.col("id") % 4 == 1, F.regexp_replace(t, inside, "`$1`")).when(F.col("id") % 4 == 2, F.regexp_replace(t, inside, "$1")).otherwise(t))


@query("restore_reformatted", f"{_MASKED} SELECT id, text AS restored_text, CASE id % 4 WHEN 2 THEN 'bare_extraction' WHEN 3 THEN 'exact' ELSE 'fuzzy_bracket' END AS strategies FROM masked WHERE len(xs) > 0 UNION ALL SELECT id, text, '' FROM masked WHERE len(xs) = 0")
def restore_reformatted(spark, sf_dir):
    n = StoredNotes(spark, sf_dir, masked=True)
    out = restore(_reformatted(n.masked()).select("id", "session_id", "reply"), n.vault(), "reply")
    return out.select("id", "restored_text", F.array_join("strategies", ",").alias("strategies"))


@query("restore_completeness", f"""{_MASKED} SELECT id, len(list_distinct(list_transform(xs, lambda x: concat(x.etype, ':', x.v))))::INT AS sent,
  CASE WHEN len(xs) = 0 THEN 1.0::DOUBLE WHEN id % 2 = 0 THEN 0.0::DOUBLE ELSE (len(xs) / len(list_distinct(list_transform(xs, lambda x: concat(x.etype, ':', x.v)))))::DOUBLE END AS completeness FROM masked""")
def restore_completeness(spark, sf_dir):
    """Every other reply leaves all tokens out."""
    n = StoredNotes(spark, sf_dir, masked=True)
    sent = F.regexp_extract_all("masked_text", F.lit(r"\{\{SG_[A-Z_]+_[a-f0-9]+\}\}"), F.lit(0))
    replies = n.masked().select("id", "session_id", F.when(F.col("id") % 2 == 1, F.col("masked_text")).otherwise("none").alias("reply"), F.array_distinct(sent).alias("sent_tokens"))
    out = restore(replies, n.vault(), "reply", tiers=("exact",), tokens_sent="sent_tokens")
    return out.select("id", F.col("tokens_sent_count").alias("sent"), "completeness")


@query("restore_distinct_tokens", f"{_MASKED} SELECT id, concat(text, ' and ', text) AS restored_text, len(list_distinct(list_transform(xs, lambda x: concat(x.etype, ':', x.v))))::INT AS distinct_restored, 0 AS distinct_not_found FROM masked")
def restore_distinct_tokens(spark, sf_dir):
    n = StoredNotes(spark, sf_dir, masked=True)
    twice = n.masked().select("id", "session_id", F.concat_ws(" and ", "masked_text", "masked_text").alias("reply"))
    return restore_distinct(twice, n.vault(), "reply").select("id", "restored_text", "distinct_restored", "distinct_not_found")


@query("restore_round_trip", f"{_MASKED} SELECT id FROM masked WHERE len(list_filter(xs, lambda x: x.etype = 'EMAIL')) > 0")
def restore_round_trip(spark, sf_dir):
    """The vault has lost its e-mail addresses, so texts with one are not what they were."""
    n = StoredNotes(spark, sf_dir, masked=True)
    vault = n.vault().filter("entity_type <> 'EMAIL'")
    return round_trip(n.masked().select("id", "session_id", "text", "masked_text"), vault).select("id")


# --- policies and sensitivity --------------------------------------------------------------------------------


def policies(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    with open(os.path.join(os.path.dirname(__file__), "policies.json"), encoding="utf-8") as f:  # a part of the package, read by the driver
        return POL.parse_policies(spark, f.read())


_POLICY_TOKEN = f"CASE WHEN view = 'partner' OR (view = 'analyst' AND x.etype = 'DATE_OF_BIRTH') THEN '[REDACTED]' ELSE {O.NAMED} END"
_VIEW = "list_filter(xs, lambda x: CASE view WHEN 'agent' THEN x.etype NOT IN ('PHONE', 'TN_PHONE', 'FR_PHONE', 'MA_PHONE') WHEN 'analyst' THEN x.etype IN ('PERSON_NAME', 'IBAN', 'FR_NIR', 'DATE_OF_BIRTH') ELSE true END)"


@query(
    "policy_masked_views",
    f"""WITH {O.resolved_ctes(D.NOTES)},
joined AS (SELECT src.id, session_id, text, view, coalesce({_VIEW}, []::{O.STRUCT}) AS xs FROM src LEFT JOIN resolved ON src.id = resolved.id, (SELECT unnest(['agent', 'analyst', 'partner', 'unbound']) AS view)),
folded AS (SELECT *, list_reduce(list_transform(xs, lambda x: {{p0: x.s, nxt: x.s + length(x.v), t: {_POLICY_TOKEN}}}), lambda a, y: {{p0: 0, nxt: y.nxt, t: concat(a.t, substr(text, a.nxt + 1, y.p0 - a.nxt), y.t)}}, {{p0: 0, nxt: 0, t: ''}}) AS f FROM joined)
SELECT id, view AS role, CASE WHEN len(xs) = 0 THEN text ELSE concat(f.t, substr(text, f.nxt + 1)) END AS masked_text FROM folded""",
)
def policy_masked_views(spark, sf_dir):
    roles = spark.createDataFrame([("agent", "helpdesk"), ("analyst", "analytics"), ("partner", "export"), ("unbound", "no such policy")], "role string, policy string")
    return POL.masked_views(detect(notes(spark, sf_dir)), roles, policies(spark)[0]).select("id", "role", "masked_text")


@query("policy_for_key", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'helpdesk' WHEN 1 THEN 'billing' ELSE 'default' END AS policy, CASE c_custkey % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'clerk' WHEN 2 THEN 'lost' END AS role FROM customer")
def policy_for_key(spark, sf_dir):
    pol, bind = policies(spark)
    bind = POL.with_binding(bind, "demo-key-of-nobody", "lost", "no such policy")
    key = F.when(F.col("id") % 4 == 0, "demo-key-of-helpdesk").when(F.col("id") % 4 == 1, "demo-key-of-billing").when(F.col("id") % 4 == 2, "demo-key-of-nobody").otherwise("unknown")
    calls = notes(spark, sf_dir).select("id").withColumn("api_key", key)
    return POL.policy_for_key(calls, bind, pol).select("id", F.col("policy.name").alias("policy"), "role")


@query("policy_read_from_a_store", "SELECT c_custkey AS id, CASE WHEN abs(c_acctbal) < 2500 THEN 'pass' ELSE 'mask' END AS action FROM customer")
def policy_read_from_a_store(spark, sf_dir):
    """The policies as a file in the shared folder, and one of them applied to customers' balances."""
    path = scratch(spark, "policies")
    with open(os.path.join(os.path.dirname(__file__), "policies.json"), encoding="utf-8") as f:
        spark.createDataFrame([(f.read(),)], "value string").coalesce(1).write.text(path)
    row = POL.load_policies(spark, path)[0].filter("name = 'billing'").select(F.struct("name", "default_action", "rules").alias("policy"))
    totals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.format_string("EUR %.2f", F.abs("c_acctbal")).alias("value"))
    return totals.join(F.broadcast(row)).select("id", POL.action(F.col("policy"), F.lit("INVOICE_TOTAL"), F.col("value")).alias("action"))


@query("policy_amount_conditions", "SELECT c_custkey AS id, CASE WHEN abs(c_acctbal) > 5000 THEN 'mask' ELSE 'pass' END AS action FROM customer")
def policy_amount_conditions(spark, sf_dir):
    """A rule on amounts above 5,000, else they pass; others take the default."""
    over = {"entity_types": ["financial_amount"], "action": "mask", "condition": {"field": "numeric_value", "operator": "gt", "value": 5000}}
    pol = POL.with_policy(policies(spark)[0], "amounts", "pass", [over])
    amounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.format_string("%.2f", F.abs("c_acctbal")), F.lit(" TND")).alias("value"))
    row = pol.filter("name = 'amounts'").select(F.struct("name", "default_action", "rules").alias("policy"))
    return amounts.join(F.broadcast(row)).select("id", POL.action(F.col("policy"), F.lit("FINANCIAL_AMOUNT"), F.col("value")).alias("action"))


def scored_notes(spark, sf_dir) -> DataFrame:
    types = F.transform("spans", lambda s: s["entity_type"])
    return detect(notes(spark, sf_dir)).withColumn("s", sensitivity(types)).select("id", "session_id", F.round("s.score", 6).alias("score"), F.array_join("s.reasons", "; ").alias("reasons"))


_SCORED = f"WITH {O.resolved_ctes(D.NOTES)}, j AS (SELECT src.id, session_id, coalesce(xs, []::{O.STRUCT}) AS xs FROM src LEFT JOIN resolved ON src.id = resolved.id), scored AS (SELECT id, session_id, round({O.score_sql()}, 6) AS score FROM j)"


@query("sensitivity_scores", f"{_SCORED} SELECT id, score, CASE WHEN score >= 0.5 THEN 'local' ELSE 'external' END AS route FROM scored")
def sensitivity_scores(spark, sf_dir):
    return scored_notes(spark, sf_dir).select("id", "score", route(F.col("score"), 0.5, True).alias("route"))


_REASONS = "concat_ws('; ', " + ", ".join(f"CASE WHEN list_has_all(ts, [{', '.join(repr(t) for t in g)}]) THEN '{' + '.join(g)}: {f}x' END" for g, f in P.CORRELATED) + ", CASE WHEN len(ts) >= 4 THEN concat(len(ts), ' types: 1.2x') END, CASE WHEN score >= 0.9 THEN 'score >= 0.9' END)"


@query("sensitivity_reasons", f"WITH {O.resolved_ctes(D.NOTES)}, j AS (SELECT src.id, coalesce(xs, []::{O.STRUCT}) AS xs FROM src LEFT JOIN resolved ON src.id = resolved.id), s AS (SELECT id, list_distinct(list_transform(xs, lambda x: x.etype)) AS ts, {O.score_sql()} AS score FROM j) SELECT id, {_REASONS} AS reasons FROM s")
def sensitivity_reasons(spark, sf_dir):
    """The score's two digits are left out, as engines round halves differently."""
    return scored_notes(spark, sf_dir).select("id", F.regexp_replace("reasons", r"score [0-9.]+ >=", "score >=").alias("reasons"))


@query("most_sensitive", f"{_SCORED} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20")
def most_sensitive_notes(spark, sf_dir):
    return most_sensitive(scored_notes(spark, sf_dir), 20, ties="id").select("id", "score")


@query("most_sensitive_by_session", f"{_SCORED} SELECT session_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id)::INT AS rank FROM scored) WHERE rank <= 3")
def most_sensitive_by_session(spark, sf_dir):
    return most_sensitive(scored_notes(spark, sf_dir), 3, by=["session_id"], ties="id").select("session_id", "id", "score", "rank")


# --- audit, metrics, rates -----------------------------------------------------------------------------------


def audit_events(spark, sf_dir) -> DataFrame:
    raw = table(spark, sf_dir, "events").withColumn("epoch_s", F.unix_timestamp("ts"))
    return spark.sql(D.AUDIT + " FROM {events}", events=raw).withColumn("entity_types", F.expr("CASE WHEN event = 'TEXT_MASKED' THEN slice(array('EMAIL', 'PHONE', 'IBAN', 'MA_CIN'), 1, cast(entity_count AS int)) END"))


_AUDIT = f"WITH a AS ({D.AUDIT} FROM (SELECT *, floor(epoch(ts))::BIGINT AS epoch_s FROM events))"
_DAYS = "ts BETWEEN epoch(TIMESTAMP '2024-01-05 00:00:00') AND epoch(TIMESTAMP '2024-01-19 23:59:59')"


@query("audit_report", f"{_AUDIT} SELECT count(*) AS total_events, count_if(event = 'SESSION_ENDED')::BIGINT AS total_sessions, sum(CASE WHEN event = 'TEXT_MASKED' THEN entity_count END)::BIGINT AS total_entities_masked, sum(CASE WHEN event = 'TEXT_RESTORED' THEN tokens_restored END)::BIGINT AS total_tokens_restored, 'ok' AS status FROM a WHERE {_DAYS}")
def audit_report(spark, sf_dir):
    return A.audit_report(audit_events(spark, sf_dir), "2024-01-05", "2024-01-19")


@query("audit_report_no_data", "SELECT 0::BIGINT AS total_events, 0::BIGINT AS total_sessions, 0::BIGINT AS total_entities_masked, 0::BIGINT AS total_tokens_restored, 'no_data' AS status")
def audit_report_no_data(spark, sf_dir):
    return A.audit_report(audit_events(spark, sf_dir), "1999-01-01", "1999-01-02")


@query("audit_events_breakdown", f"{_AUDIT} SELECT event, count(*) AS n FROM a GROUP BY event")
def audit_events_breakdown(spark, sf_dir):
    return A.events_breakdown(audit_events(spark, sf_dir))


@query("audit_entity_types", f"{_AUDIT} SELECT entity_type, count(*) AS n FROM (SELECT unnest(['EMAIL', 'PHONE', 'IBAN', 'MA_CIN'][1:entity_count]) AS entity_type FROM a WHERE event = 'TEXT_MASKED') GROUP BY entity_type")
def audit_entity_types(spark, sf_dir):
    return A.entity_types_detected(audit_events(spark, sf_dir))


@query("audit_parsed_lines", f"{_AUDIT} SELECT event_id, CASE event_id % 4 WHEN 2 THEN 0.0 ELSE ts END::DOUBLE AS ts, event, entity_count::BIGINT AS entity_count FROM a WHERE event_id % 10 <> 9")
def audit_parsed_lines(spark, sf_dir):
    """Lines with times as numbers, ISO strings with Z, nonsense, and ISO strings; every tenth line is malformed."""
    from pallium.sources.audit_log import parse_audit

    iso = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(F.col("event_id") % 4 == 0, F.col("ts").cast("string")).when(F.col("event_id") % 4 == 1, F.concat(F.lit('"'), iso, F.lit('Z"'))).when(F.col("event_id") % 4 == 2, F.lit('"long ago"')).otherwise(F.concat(F.lit('"'), iso, F.lit('+00:00"')))
    line = F.concat(F.lit('{"timestamp": '), stamp, F.lit(', "event": "'), F.col("event"), F.lit('", "session_id": "'), F.col("event_id").cast("string"), F.lit('", "entity_count": '), F.col("entity_count").cast("string"), F.lit("}"))
    lines = audit_events(spark, sf_dir).select(F.when(F.col("event_id") % 10 == 9, F.substring(line, 1, 30)).otherwise(line).alias("value"))
    return parse_audit(lines).select(F.col("session_id").cast("long").alias("event_id"), "ts", "event", "entity_count")


@query("mask_audit_events", f"{_MASKED} SELECT session_id, sum(len(xs))::BIGINT AS entities, count(*) AS events FROM masked GROUP BY session_id")
def mask_audit_events(spark, sf_dir):
    return A.mask_events(masked_notes(spark, sf_dir), F.lit(0.0)).groupBy("session_id").agg(F.sum("entity_count").alias("entities"), F.count(F.lit(1)).alias("events"))


@query("audit_events_of_a_run", f"""{_MASKED}, s AS (SELECT count(DISTINCT session_id) AS n FROM masked)
SELECT 'TEXT_MASKED' AS event, count(*) AS n, sum(len(xs))::BIGINT AS entities, 0::BIGINT AS restored FROM masked
UNION ALL SELECT 'TEXT_RESTORED', count(*), 0, sum(len(xs))::BIGINT FROM masked UNION ALL SELECT 'SESSION_ENDED', n, 0, 0 FROM s""")
def audit_events_of_a_run(spark, sf_dir):
    """The audit events of masking all notes, of restoring them, and of ending their sessions."""
    n = StoredNotes(spark, sf_dir, masked=True)
    masked = n.masked()
    restored = restore(masked.select("id", "session_id", "masked_text"), n.vault(), "masked_text", tiers=("exact",))
    events = A.mask_events(masked, F.lit(1.0)).unionByName(A.restore_events(restored, F.lit(2.0)), True).unionByName(A.session_events(masked.select("session_id").distinct(), F.lit(3.0)), True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"), total("entity_count").alias("entities"), total("tokens_restored").alias("restored"))


@query("metric_entities_by_type", f"WITH {O.resolved_ctes(D.NOTES)} SELECT x.etype AS entity_type, count(*) AS entities FROM (SELECT unnest(xs) AS x FROM resolved) GROUP BY x.etype")
def metric_entities_by_type(spark, sf_dir):
    return A.entities_masked(note_detections(spark, sf_dir))


@query("metric_requests_by_status", f"{_AUDIT} SELECT status, count(*) AS requests FROM a GROUP BY status")
def metric_requests_by_status(spark, sf_dir):
    return A.requests_by_status(audit_events(spark, sf_dir))


@query("metric_tokens_restored", f"{_MASKED} SELECT sum(len(xs))::BIGINT AS tokens_restored FROM masked")
def metric_tokens_restored(spark, sf_dir):
    n = StoredNotes(spark, sf_dir, masked=True)
    out = restore(n.masked().select("id", "session_id", "masked_text"), n.vault(), "masked_text", tiers=("exact",))
    return A.tokens_restored(out)


_BUCKETS = [0.5, 1.0, 5.0, 10.0, 50.0]


@query("metric_duration_histogram", f"{_AUDIT} SELECT le, count_if(duration <= le)::BIGINT AS n FROM a, (SELECT unnest([0.5, 1.0, 5.0, 10.0, 50.0, 'inf'::DOUBLE]::DOUBLE[]) AS le) GROUP BY le")
def metric_duration_histogram(spark, sf_dir):
    return A.duration_histogram(audit_events(spark, sf_dir), _BUCKETS)


@query("metric_duration_p99", f"{_AUDIT} SELECT duration AS p99, duration > 5.0 AS alert FROM (SELECT duration, row_number() OVER (ORDER BY duration) AS i, count(*) OVER () AS n FROM a) WHERE i = floor(0.99 * n)")
def metric_duration_p99(spark, sf_dir):
    return A.duration_p99(audit_events(spark, sf_dir))


@query("metric_p99_by_day", f"{_AUDIT} SELECT epoch_us(date_trunc('day', to_timestamp(ts)::TIMESTAMP)) AS day, count(*) AS n, true AS within FROM a WHERE duration IS NOT NULL GROUP BY ALL")
def metric_p99_by_day(spark, sf_dir):
    """Sketches of 5 minutes merged by day; `within`: the sketch's p99 lies between the exact quantiles that its error bound allows."""
    requests = audit_events(spark, sf_dir).withColumn("ts", F.timestamp_seconds("ts"))
    days = A.sketched_p99(A.merged_sketches(A.duration_sketches(requests), "day"))
    exact = requests.filter("duration is not null").groupBy(F.date_trunc("day", "ts").alias("window_start")).agg(F.percentile("duration", F.array(F.lit(0.98), F.lit(1.0))).alias("q"))
    return days.join(exact, "window_start").select(F.unix_micros("window_start").alias("day"), "n", F.col("p99").between(F.col("q")[0], F.col("q")[1]).alias("within"))


@query("metric_active_sessions", """WITH s AS (SELECT user_id, event_type, min(ts) AS started, max(ts) AS ended FROM events GROUP BY ALL), c AS (SELECT started AS ts, 1 AS d FROM s UNION ALL SELECT ended, -1 FROM s), g AS (SELECT ts, sum(d) AS d FROM c GROUP BY ts)
SELECT epoch_us(ts) AS ts, sum(d) OVER (ORDER BY ts)::BIGINT AS active, sum(d) OVER (ORDER BY ts) > 100 AS alert FROM g""")
def metric_active_sessions(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").cast("timestamp").alias("started"), F.max("ts").cast("timestamp").alias("ended"))
    return A.active_sessions(sessions).select(F.unix_micros("ts").alias("ts"), "active", "alert")


@query("metric_error_rate", "SELECT (floor(epoch(ts) / 300) * 300)::BIGINT AS window_start, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.1 AS alert FROM events GROUP BY ALL")
def metric_error_rate(spark, sf_dir):
    out = A.error_rate(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), failed=F.col("event_type") == "error")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), F.round("rate", 6).alias("rate"), "alert")


@query("session_activity", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS last_seen, count(*) AS events FROM n GROUP BY user_id, k""")
def session_activity(spark, sf_dir):
    out = A.session_activity(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id")
    return out.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("last_seen").alias("last_seen"), "events")


_HELD = "list_filter(a.held, lambda h: h > x.t - 36000.0)"
_RATES = f"""WITH c AS (SELECT user_id AS client, list({{t: epoch_us(ts) / 1e6, id: event_id, held: []::DOUBLE[], out: []::STRUCT(id BIGINT, t DOUBLE, ok BOOLEAN, r INT)[]}} ORDER BY ts, event_id) AS es FROM events GROUP BY user_id),
f AS (SELECT client, list_reduce(es, lambda a, x: CASE WHEN len({_HELD}) < 3
  THEN {{t: x.t, id: x.id, held: list_append({_HELD}, x.t), out: list_append(a.out, {{id: x.id, t: x.t, ok: true, r: (2 - len({_HELD}))::INT}})}}
  ELSE {{t: x.t, id: x.id, held: {_HELD}, out: list_append(a.out, {{id: x.id, t: x.t, ok: false, r: 0::INT}})}} END,
  {{t: 0.0::DOUBLE, id: 0::BIGINT, held: []::DOUBLE[], out: []::STRUCT(id BIGINT, t DOUBLE, ok BOOLEAN, r INT)[]}}).out AS out FROM c)
SELECT client, o.id AS event_id, o.t AS ts, o.ok AS allowed, o.r AS remaining FROM (SELECT client, unnest(out) AS o FROM f)"""


@query("rate_decisions", _RATES)
def rate_decisions(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return A.rate_decisions(calls, limit=3, window_s=36_000.0)


@query("live_metrics_by_window", "SELECT (floor(epoch(ts) / 300) * 300)::BIGINT AS window_start, event_type, count(*) AS n, round(avg(CASE WHEN event_id % 11 = 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS error_rate FROM events GROUP BY ALL")
def live_metrics_by_window(spark, sf_dir):
    """The streaming job's aggregation on a table, where all windows are closed."""
    from pallium.streaming.jobs import live_metrics

    out = live_metrics(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("event_id") % 11 == 0).alias("failed")))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("error_rate", 6).alias("error_rate"))


@query("audit_written_and_read", f"{_AUDIT} SELECT event, count(*) AS n, sum(entity_count)::BIGINT AS entities, sum(ts)::DOUBLE AS ts FROM a GROUP BY event")
def audit_written_and_read(spark, sf_dir):
    """Events as JSON lines in the shared folder, read and summed."""
    from pallium.sources.audit_log import read_audit, write_audit

    path = scratch(spark, "audit")
    write_audit(audit_events(spark, sf_dir).select(F.col("ts").alias("timestamp"), "event", "session_id", "entity_count", "entity_types", "status"), path)
    return read_audit(spark, path).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("entity_count").alias("entities"), F.sum("ts").alias("ts"))


def chain_entries(spark, sf_dir) -> DataFrame:
    e = audit_events(spark, sf_dir)
    data = F.concat(F.lit('{"entity_count": '), F.col("entity_count").cast("string"), F.lit("}"))
    return e.select(F.concat_ws("-", F.lit("day"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")).alias("chain_id"), (F.col("ts") * 1_000_000 + F.col("event_id")).alias("ts"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "event", data.alias("data"))


_CHAIN = f"""{_AUDIT}, e AS (SELECT concat('day-', strftime(to_timestamp(ts), '%Y-%m-%d')) AS chain_id, strftime(to_timestamp(ts), '%Y-%m-%dT%H:%M:%S') AS timestamp, event, concat('{{"entity_count": ', entity_count::VARCHAR, '}}') AS data, row_number() OVER (PARTITION BY strftime(to_timestamp(ts), '%Y-%m-%d') ORDER BY ts * 1000000 + event_id) - 1 AS sequence FROM a)"""
_FOLD = """list_reduce(es, lambda h, x: {h: sha256(concat('{"data": ', x.d, ', "event": "', x.e, '", "prev_hash": "', h.h, '", "sequence": ', x.s::VARCHAR, ', "timestamp": "', x.t, '"}')), d: '', e: '', s: 0, t: ''}, {h: 'GENESIS', d: '', e: '', s: 0, t: ''}).h"""


@query("chain_heads", f"{_CHAIN} SELECT chain_id, next_sequence::INT AS next_sequence, {_FOLD} AS last_hash FROM (SELECT chain_id, count(*) AS next_sequence, list({{h: '', d: data, e: event, s: sequence::INT, t: timestamp}} ORDER BY sequence) AS es FROM e GROUP BY chain_id)")
def chain_heads(spark, sf_dir):
    return A.chain_head(A.build_chain(chain_entries(spark, sf_dir)))


@query("chain_resumed", f"{_CHAIN} SELECT chain_id, next_sequence::INT AS next_sequence, {_FOLD} AS last_hash, resumed, true AS valid FROM (SELECT chain_id, count(*) AS next_sequence, count(*) FILTER (WHERE timestamp[12:13]::INT >= 10) AS resumed, list({{h: '', d: data, e: event, s: sequence::INT, t: timestamp}} ORDER BY sequence) AS es FROM e GROUP BY chain_id)")
def chain_resumed(spark, sf_dir):
    """Each day's entries up to ten o'clock are one run; a second run goes on from the stored heads. Both together are the whole chains."""
    entries = chain_entries(spark, sf_dir)
    late = F.substring("timestamp", 12, 2).cast("int") >= 10
    path = scratch(spark, "chains")
    A.build_chain(entries.filter(~late)).write.parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    A.build_chain(entries.filter(late), heads=A.resume_heads(first)).withColumn("resumed", F.lit(1)).write.parquet(f"{path}/second")
    whole = first.withColumn("resumed", F.lit(0)).unionByName(spark.read.parquet(f"{path}/second"))
    checked = A.verify_chain(whole.withColumn("pos", F.col("sequence"))).select("chain_id", "valid")
    counts = whole.groupBy("chain_id").agg(F.sum("resumed").alias("resumed"))
    return A.chain_head(whole).join(counts, "chain_id").join(checked, "chain_id").select("chain_id", "next_sequence", "last_hash", "resumed", "valid")


@query("chain_verification", f"{_CHAIN} SELECT chain_id, max(sequence) < 5 AS valid, count(*) AS entries_checked, CASE WHEN max(sequence) >= 5 THEN 5 END::BIGINT AS first_broken_at, CASE WHEN max(sequence) >= 5 THEN 1 ELSE 0 END::BIGINT AS errors FROM e GROUP BY chain_id")
def chain_verification(spark, sf_dir):
    """The sixth entry of each chain is tampered with."""
    chain = A.build_chain(chain_entries(spark, sf_dir))
    stored = chain.withColumn("data", F.when(F.col("sequence") == 5, F.lit('{"entity_count": 99}')).otherwise(F.col("data"))).withColumn("pos", F.col("sequence"))
    return A.verify_chain(stored)


# --- chat bodies ---------------------------------------------------------------------------------------------


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("request_id", F.concat_ws("-", "conv_id", "turn"))


@query("chat_request_texts", """SELECT concat(conv_id, '-', turn) AS request_id, unnest(CASE turn % 3 WHEN 0 THEN ['messages[0].content', 'system'] WHEN 1 THEN ['messages[0].content[1].text', 'input[0]'] ELSE ['prompt'] END) AS path, text FROM conversations""")
def chat_request_texts(spark, sf_dir):
    plain = F.to_json(F.expr("named_struct('model', 'm', 'system', text, 'messages', array(named_struct('role', role, 'content', text)))"))
    parts = F.to_json(F.expr("named_struct('messages', array(named_struct('role', role, 'content', array(named_struct('type', 'image_url', 'text', cast(null as string)), named_struct('type', 'text', 'text', text)))), 'input', array(text))"))
    legacy = F.to_json(F.expr("named_struct('prompt', text)"))
    body = F.when(F.col("turn") % 3 == 0, plain).when(F.col("turn") % 3 == 1, parts).otherwise(legacy)
    return chat.request_texts(_turns(spark, sf_dir).select("request_id", body.alias("body")))


@query("chat_response_texts", "SELECT concat(conv_id, '-', turn) AS response_id, CASE WHEN turn % 2 = 0 THEN 'choices[0].message.content' ELSE 'choices[0].text' END AS path, text FROM conversations UNION ALL SELECT concat('a', conv_id, '-', turn), 'content[1].text', text FROM conversations")
def chat_response_texts(spark, sf_dir):
    t = _turns(spark, sf_dir)
    chatty, old = F.to_json(F.expr("named_struct('choices', array(named_struct('message', named_struct('content', text))))")), F.to_json(F.expr("named_struct('choices', array(named_struct('text', text)))"))
    blocks = F.to_json(F.expr("named_struct('content', array(named_struct('type', 'tool_use', 'text', 'x'), named_struct('type', 'text', 'text', text)))"))
    a = chat.response_texts(t.select(F.col("request_id").alias("response_id"), F.when(F.col("turn") % 2 == 0, chatty).otherwise(old).alias("body")))
    return a.unionByName(chat.response_texts(t.select(F.concat(F.lit("a"), "request_id").alias("response_id"), blocks.alias("body")), "anthropic"))


@query("chat_set_texts", "SELECT concat(conv_id, '-', turn) AS request_id, reverse(text) AS content, 7 AS extra FROM conversations")
def chat_set_texts(spark, sf_dir):
    """Texts are replaced at their paths; fields that nobody knows stay."""
    body = F.to_json(F.expr("named_struct('extra', 7, 'messages', array(named_struct('role', role, 'content', text)))"))
    bodies = _turns(spark, sf_dir).select("request_id", body.alias("body"))
    new = chat.request_texts(bodies).withColumn("text", F.reverse("text"))
    out = chat.set_texts(bodies, new)
    return out.select("request_id", F.get_json_object("body", "$.messages[0].content").alias("content"), F.get_json_object("body", "$.extra").cast("int").alias("extra"))


@query("chat_stream_restored", f"{_MASKED} SELECT id AS stream_id, text FROM masked")
def chat_stream_restored(spark, sf_dir):
    """Masked notes cut into chunks of seven characters, in two providers' forms, put together and restored."""
    n = StoredNotes(spark, sf_dir, masked=True)
    from pallium.streaming.jobs import restore_chunks

    m = n.masked()
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("delta").alias("content")).alias("delta"))).alias("choices")))
    block = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), F.col("delta").alias("text")).alias("delta")))
    cut = m.select("id", "session_id", F.concat_ws("|", "session_id", "id").alias("stream_id"), F.posexplode(F.regexp_extract_all("masked_text", F.lit("(?s).{1,7}"), F.lit(0))).alias("seq", "delta"))
    plain = chat.stream_deltas(cut.filter("id % 2 = 0").withColumn("chunk", choices).drop("delta"))
    deltas = plain.unionByName(chat.stream_deltas(cut.filter("id % 2 = 1").withColumn("chunk", block).drop("delta"), "anthropic"))
    vault = n.vault().select("session_id", "token", "value")
    return restore_chunks(deltas, vault, session_col="session_id").select(F.regexp_extract("stream_id", r"\|(\d+)$", 1).cast("long").alias("stream_id"), F.col("restored_text").alias("text"))


@query("chat_stream_parts_restored", f"{_MASKED} SELECT id AS stream_id, text FROM masked")
def chat_stream_parts_restored(spark, sf_dir):
    """Masked notes in parts that split no token, restored piece by piece by the streaming join, and put together."""
    n = StoredNotes(spark, sf_dir, masked=True)
    from pallium.streaming.jobs import join_parts, restore_stream

    m = n.masked()
    parts = m.select(F.col("id").alias("stream_id"), "session_id", F.posexplode(F.split("masked_text", "(?= ; )")).alias("part", "text"))
    return join_parts(restore_stream(parts, n.vault(), "session_id"))
