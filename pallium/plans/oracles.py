"""SQL for DuckDB that recomputes the registered queries from the same tables."""

from __future__ import annotations

from pallium.functions import patterns as P
from pallium.functions.recognizers import OPTIONAL, RECOGNIZERS, ranked
from pallium.plans.derived import DOCUMENTS, NOTES

STRUCT = "STRUCT(s INTEGER, e INTEGER, score DOUBLE, v VARCHAR, etype VARCHAR, loc VARCHAR, rank INTEGER)[]"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _re(pattern: str, flags: str = "") -> str:
    return _q(flags + P.for_re2(pattern))


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_re(pattern, '(?i)')})"


def _hits(pattern: str, order: int, flags: str = "") -> str:
    p = _re(pattern, flags)
    return f"""SELECT id, text, {order} AS ord, unnest(m) AS v,
    unnest(list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT)) AS s
  FROM (SELECT id, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS parts FROM src)"""


_DIGITS = r"regexp_replace(v, '[\s\-]', '', 'g')"
_BARE = r"regexp_replace(v, '\s', '', 'g')"


def _luhn(d: str) -> str:
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({d})[i]::INT WHEN reverse({d})[i]::INT > 4 THEN 2 * reverse({d})[i]::INT - 9 ELSE 2 * reverse({d})[i]::INT END)) % 10 = 0"


def _around(n: int) -> str:
    return f"substr(text, greatest(s - {n}, 0) + 1, s + length(v) + {n} - greatest(s - {n}, 0))"


def _listed(specs: list[tuple[str, float]]) -> list[tuple[str, str, str]]:
    return [(p, "(?i)", str(s)) for p, s in specs]


def _context(pattern: str, context: str, with_: float, without: float):
    return [(pattern, "", f"CASE WHEN {_has('text', context)} THEN {with_} ELSE {without} END")]


_LENGTHS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in P.IBAN_LENGTHS.items()) + "}"
_MOVED = f"concat(substr({_DIGITS}, 5), substr({_DIGITS}, 1, 4))"
_MOD = f"list_reduce(list_transform(range(1, length({_MOVED}) + 1), lambda i: CASE WHEN ascii({_MOVED}[i]) < 58 THEN ascii({_MOVED}[i]) - 48 ELSE ascii({_MOVED}[i]) - 55 END), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END, 0)"
_CARD = f"""CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 AND {_luhn(_DIGITS)} THEN CASE WHEN
  ({_DIGITS} LIKE '4%' AND length({_DIGITS}) IN (13, 16, 19)) OR substr({_DIGITS}, 1, 2) IN ('51', '52', '53', '54', '55') OR (substr({_DIGITS}, 1, 2) IN ('34', '37') AND length({_DIGITS}) = 15)
  OR substr({_DIGITS}, 1, 4) IN ('6011', '6221', '6229') OR {_DIGITS} LIKE '65%' THEN 0.95 ELSE 0.80 END END"""
_TN_ID = f"""CASE WHEN length(v) = 8 THEN list_reduce([1, 2, 3, 4]::DOUBLE[], lambda a, i: CASE
  WHEN i = 1 THEN CASE WHEN v LIKE '0%' THEN a - 0.10 ELSE a END
  WHEN i = 2 THEN CASE WHEN {_has(_around(50), P.TN_ID_CONTEXT)} THEN least(0.98, a + 0.15) ELSE a END
  WHEN i = 3 THEN CASE WHEN replace(v, v[1], '') = '' THEN greatest(0.40, a - 0.30) ELSE a END
  ELSE CASE WHEN v LIKE '0%' THEN a ELSE least(0.99, a + 0.03) END END, CASE WHEN {_has('text', P.TN_ID_CONTEXT)} THEN 0.90::DOUBLE ELSE 0.65::DOUBLE END) END"""
_NIR_KEY = f"97 - substr({_BARE}, 1, 13)::BIGINT % 97 = substr({_BARE}, 14, 2)::BIGINT"


def _nir(base: float) -> str:
    s = f"least(0.99, {base} + CASE WHEN {_has('text', P.FR_NIR_CONTEXT)} THEN 0.08 ELSE 0 END)"
    return f"CASE WHEN length({_BARE}) = 15 AND (substr({_BARE}, 4, 2)::INT BETWEEN 1 AND 12 OR substr({_BARE}, 4, 2)::INT BETWEEN 20 AND 42) THEN CASE WHEN {_NIR_KEY} THEN least(0.99, {s} + 0.05) ELSE {s} END END"


def _company(n: int, with_: float, without: float) -> str:
    return f"CASE WHEN length({_BARE}) = {n} AND {_luhn(_BARE)} THEN CASE WHEN {_has('text', P.FR_COMPANY_CONTEXT)} THEN {with_} ELSE {without} END END"


def _specs() -> dict[str, list[tuple]]:
    """Per recognizer: (pattern, flags, score[, type])."""
    phone = r"CASE WHEN length(regexp_replace(v, '\D', '', 'g')) BETWEEN 7 AND 15 THEN {} END"
    tax = f"CASE WHEN {_has('text', P.TN_TAX_CONTEXT)} THEN 0.05 ELSE 0 END"
    return {
        "email": [(P.EMAIL, "", "0.95")],
        "phone": [(p, "", phone.format(s)) for p, s in P.PHONES],
        "credit_card": [(P.CARD, "", _CARD)],
        "iban": [(P.IBAN, "", f"CASE WHEN element_at({_LENGTHS}, substr({_DIGITS}, 1, 2))[1] = length({_DIGITS}) THEN CASE WHEN {_MOD} = 1 THEN 0.95 ELSE 0.70 END END")],
        "ip_address": [(p, "", f"CASE WHEN v NOT IN ({', '.join(map(_q, P.IGNORED_IPS))}) THEN {s} END") for p, s in ((P.IPV4, 0.90), (P.IPV6, 0.85))],
        "person_name": [(rf"\b{P.TITLES}\.?\s+{P.NAME}", "(?i)", "0.85"), (rf"\b{P.NAME_CONTEXTS}\s*[:=\-]?\s*{P.NAME}", "(?i)", "0.75")],
        "date_of_birth": [(p, "(?i)", f"CASE WHEN {_has(_around(50), P.BIRTH_CONTEXT)} THEN 0.85 END") for p in P.DATES],
        "tn_national_id": [(r"\d+", "", _TN_ID)],
        "tn_phone": _listed(P.TN_PHONES),
        "tn_matricule_fiscale": [(p, "(?i)", f"least(0.99, {s} + {tax})") for p, s in P.TN_TAX_IDS],
        "tn_address": [
            (P.TN_POSTAL, "(?i)", f"CASE WHEN substr(v, 1, 4)::INT BETWEEN 1000 AND 9999 THEN CASE WHEN {_has(_around(60), P.TN_LOCALITY)} THEN 0.95 ELSE 0.90 END END"),
            (P.TN_STREET, "(?i)", rf"least(0.95, 0.80 + CASE WHEN regexp_matches(v, '\b\d{{1,4}}\b') THEN 0.06 ELSE 0 END + CASE WHEN {_has('v', P.TN_LOCALITY)} THEN 0.06 ELSE 0 END)"),
        ],
        "fr_nir": [(p, "", _nir(s)) for p, s in P.FR_NIRS],
        "fr_company": [(P.FR_SIRET, "", _company(14, 0.95, 0.80), "FR_SIRET"), (P.FR_SIREN, "", _company(9, 0.90, 0.70), "FR_SIREN")],
        "fr_phone": _listed(P.FR_PHONES),
        "fr_address": [(P.FR_POSTAL, "", "CASE WHEN substr(v, 1, 2)::INT BETWEEN 1 AND 95 OR substr(v, 1, 3)::INT BETWEEN 971 AND 976 THEN 0.85 END"), (P.FR_STREET, "(?i)", "0.85")],
        "ma_cin": _context(P.MA_CIN, P.MA_CIN_CONTEXT, 0.92, 0.72),
        "ma_phone": _listed(P.MA_PHONES),
        "ma_ice": _context(P.MA_ICE, P.MA_ICE_CONTEXT, 0.95, 0.55),
    }


SPECS = _specs()
FOLD = f"list_reduce(xs, lambda acc, x: CASE WHEN len(acc) = 0 THEN [x] WHEN x.s >= acc[len(acc)].e THEN list_append(acc, x) WHEN x.score > acc[len(acc)].score THEN list_append(acc[1:len(acc) - 1], x) ELSE acc END, []::{STRUCT})"


def _rows(name: str, rank: int) -> str:
    """Spans (id, s, e, score, v, etype, loc, rank) of one recognizer, deduplicated, from CTE src."""
    r = next(x for x in [*RECOGNIZERS, *OPTIONAL] if x.name == name)
    parts = []
    for i, spec in enumerate(SPECS[name]):
        pattern, flags, score = spec[:3]
        etype = spec[3] if len(spec) > 3 else r.entity_types[0]
        hits = _hits(pattern, i, flags)
        if name == "person_name":
            inner = _re(P.NAME)
            hits = f"SELECT id, text, ord, regexp_extract(v, {inner}, 0) AS v, s + strpos(v, regexp_extract(v, {inner}, 0)) - 1 AS s FROM ({hits}) WHERE regexp_matches(v, {inner})"
        value = "trim(v)" if name in ("phone", "credit_card") else "v"
        parts.append(f"SELECT id, s::INT AS s, (s + length(v))::INT AS e, ({score})::DOUBLE AS score, {value} AS v, '{etype}' AS etype, '{r.locale}' AS loc, {rank} AS rank, ord FROM ({hits})")
    union = " UNION ALL ".join(parts)
    return f"SELECT id, unnest({FOLD}) AS x FROM (SELECT id, list({{s: s, e: e, score: score, v: v, etype: etype, loc: loc, rank: rank}} ORDER BY s, score DESC, rank, ord) AS xs FROM ({union}) WHERE score IS NOT NULL GROUP BY id)"


def recognize_sql(name: str, source: str = NOTES) -> str:
    return f"WITH src AS ({source}) SELECT id, x.etype AS entity_type, x.s AS \"start\", x.e AS \"end\", round(x.score, 6) AS score, x.v AS text FROM ({_rows(name, 0)})"


def resolved_ctes(source: str, names: list[str] | None = None) -> str:
    """CTEs src and resolved(id, xs): the resolved spans of each text with any."""
    chosen = [(k, r.name) for k, r in ranked([r for r in RECOGNIZERS if names is None or r.name in names])]
    union = " UNION ALL ".join(f"SELECT * FROM ({_rows(n, k)})" for k, n in chosen)
    return f"""src AS ({source}), found AS ({union}),
boosted AS (SELECT id, {{s: x.s, e: x.e, score: CASE WHEN x.loc = 'universal' THEN x.score ELSE least(1.0, x.score + 0.05) END, v: x.v, etype: x.etype, loc: x.loc, rank: x.rank}} AS x FROM found WHERE x.score >= {P.CONFIDENCE}),
resolved AS (SELECT id, {FOLD} AS xs FROM (SELECT id, list(x ORDER BY x.s, x.score DESC, x.rank) AS xs FROM boosted GROUP BY id))"""


NAMED = " ".join(["concat('{{SG_', replace(replace(upper(x.etype), ' ', '_'), '-', '_'), '_',", "substr(sha256(concat(session_id, ':', x.etype, ':', x.v)), 1, 12), '}}')"])


def masked_ctes(source: str, token: str = NAMED, spans: str = "xs") -> str:
    """CTEs up to masked(id, session_id, text, xs, masked_text)."""
    fold = f"""list_reduce(list_transform({spans}, lambda x: {{p0: x.s, nxt: x.s + length(x.v), t: {token}}}), lambda a, y: {{p0: 0, nxt: y.nxt, t: concat(a.t, substr(text, a.nxt + 1, y.p0 - a.nxt), y.t)}}, {{p0: 0, nxt: 0, t: ''}})"""
    return f"""{resolved_ctes(source)},
joined AS (SELECT src.id, session_id, text, coalesce(xs, []::{STRUCT}) AS xs FROM src LEFT JOIN resolved ON src.id = resolved.id),
masked AS (SELECT id, session_id, text, xs, CASE WHEN len({spans}) = 0 THEN text ELSE concat(({fold}).t, substr(text, ({fold}).nxt + 1)) END AS masked_text FROM joined)"""


SPANS = f"detected AS (SELECT src.id, session_id, x FROM (SELECT id, unnest(xs) AS x FROM resolved) r JOIN src ON r.id = src.id)"
VAULT = f"vault AS (SELECT session_id, x.etype AS entity_type, x.v AS value, any_value({NAMED}) AS token, any_value(sha256(concat(x.etype, ':', x.v))) AS value_hash, count(*) AS times FROM detected GROUP BY session_id, x.etype, x.v)"
_TYPES = "list_transform(xs, lambda x: x.etype)"
_WEIGHTS = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in P.WEIGHTS.items()) + "}"


def score_sql(types: str = _TYPES) -> str:
    base = f"coalesce(list_sum(list_transform({types}, lambda t: coalesce(element_at({_WEIGHTS}, t)[1], {P.OTHER_WEIGHT}))), 0)"
    for group, factor in P.CORRELATED:
        base += f" * CASE WHEN list_has_all({types}, [{', '.join(map(_q, group))}]) THEN {factor} ELSE 1 END"
    return f"least(1.0, {base} * CASE WHEN len(list_distinct({types})) >= 4 THEN 1.2 ELSE 1 END)::DOUBLE"


__all__ = ["DOCUMENTS", "NOTES", "SPECS", "masked_ctes", "recognize_sql", "resolved_ctes", "score_sql"]
