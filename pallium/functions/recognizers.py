"""Recognizers of personal data: each turns a text column into an array of spans. No shuffle, no Python at run time.

What depends on the whole text (keywords somewhere in it) is found once, not for each match. A recognizer whose matches
must hold something that a cheap scan can tell (an @, a few digits close together, a fragment of a keyword) asks for
that first; such a test never is false where the recognizer matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pallium.functions import patterns as P
from pallium.functions.spans import EMPTY, around, blocks_of, bound, digits, fold_sql, let, lit, luhn_sql, matches, mod97_sql, spans

IU = "(?iU)"
NOT_DIGITS, OUTER_BLANKS, BLANKS = r"(?U)\D", r"(?U)^\s+|\s+$", r"(?U)\s"


@dataclass(frozen=True)
class Recognizer:
    """`find(rank)` gives, as SQL over the text `t`, the spans before per-recognizer deduplication."""

    name: str
    entity_types: tuple[str, ...]
    locale: str
    priority: int
    find: Callable[[int], str]

    def sql(self, rank: int = 0) -> str:
        return fold_sql(self.find(rank))

    def recognize(self, text: Column, rank: int = 0) -> Column:
        return bound(text, "t", self.sql(rank))


def _has(value: str, pattern: str, flags: str = IU) -> str:
    return f"{value} RLIKE {lit(flags + pattern)}"


def _where(test: str, found: str) -> str:
    """`found` of texts that pass the test; no spans of others."""
    return f"CASE WHEN {test} THEN {found} ELSE cast(array() AS {EMPTY}) END"


FOUR_DIGITS = r"\p{Nd}{4}"
#: Five digits, each at most three characters behind the one before.
FIVE_DIGITS = _has("t", r"(?:\p{Nd}[^\p{Nd}]{0,3}+){5}", "")


def _fragments(fragments: list[str]) -> str:
    """Whether the text holds one of these in any case; `fragments` are upper case, and hold no i, whose case is not the same everywhere."""
    return let("upper", "upper(lower(t))", "(" + " OR ".join(f"contains(upper, {lit(x)})" for x in fragments) + ")")


def _joined(found: list[str]) -> str:
    return f"concat({', '.join(found)})"


def _found(pattern: str, found: str, flags: str = "(?U)") -> str:
    """`found`, an expression over the matches `hits` of a pattern, of texts that have some; what it needs of the text is not looked for in others."""
    return let("hits", matches("t", pattern, flags), _where("size(hits) > 0", found))


def _all_found(patterns: list[str], name: str, value: str, found: Callable[[str, int], str], flags: str = "(?U)") -> str:
    """The spans `found` of the matches of several patterns, with `name` for a `value` of the text that is looked for only if there are some."""
    all_hits = "array(" + ", ".join(matches("t", p, flags) for p in patterns) + ")"
    joined = _joined([found(f"hits[{i}]", i) for i in range(len(patterns))])
    return let("hits", all_hits, _where("exists(hits, h -> size(h) > 0)", let(name, value, joined)))


def _listed(entity: str, locale: str, specs: list[tuple[str, float]], flags: str = IU, test: str = "true"):
    def find(rank: int) -> str:
        return _where(test, _joined([spans(matches("t", p, flags), entity, locale, rank, i, s) for i, (p, s) in enumerate(specs)]))

    return find


def _email(rank: int) -> str:
    # starts only at the start of a run or where the last match ended: equal to a plain search, but linear
    p = r"(?:(?<![a-zA-Z0-9._%+\-])|\G)[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
    return _where("contains(t, '@')", spans(matches("t", p, ""), "EMAIL", "universal", rank, 0, 0.95))


def _phone(rank: int) -> str:
    n = f"length(regexp_replace(m.text, {lit(NOT_DIGITS)}, ''))"
    value = f"trim(regexp_replace(m.text, {lit(OUTER_BLANKS)}, ''))"
    return _where(FIVE_DIGITS, _joined([spans(matches("t", p), "PHONE", "universal", rank, i, f"CASE WHEN {n} BETWEEN 7 AND 15 THEN {s} END", value) for i, (p, s) in enumerate(P.PHONES)]))


def _card(rank: int) -> str:
    known = (
        "(d LIKE '4%' AND length(d) IN (13, 16, 19)) OR substring(d, 1, 2) IN ('51', '52', '53', '54', '55') OR (substring(d, 1, 2) IN ('34', '37') AND length(d) = 15) "
        "OR substring(d, 1, 4) IN ('6011', '6221', '6229') OR d LIKE '65%'"
    )
    score = let("d", digits("m.text"), f"CASE WHEN length(d) BETWEEN 13 AND 19 AND {luhn_sql('d')} THEN CASE WHEN {known} THEN 0.95 ELSE 0.80 END END")
    return _where(FIVE_DIGITS, spans(matches("t", P.CARD), "CREDIT_CARD", "universal", rank, 0, score, "trim(m.text)"))


def _iban(rank: int) -> str:
    lengths = "map(" + ", ".join(f"'{k}', {v}" for k, v in P.IBAN_LENGTHS.items()) + ")"
    fits = f"coalesce({lengths}[substring(d, 1, 2)] = length(d), false)"
    score = let("d", digits("m.text"), f"CASE WHEN {fits} THEN CASE WHEN {mod97_sql('d')} = 1 THEN 0.95 ELSE 0.70 END END")
    return _where(_has("t", r"[A-Z]{2}\p{Nd}{2}", ""), spans(matches("t", P.IBAN), "IBAN", "universal", rank, 0, score))


def _ip(rank: int) -> str:
    score = f"CASE WHEN m.text NOT IN ({', '.join(map(lit, P.IGNORED_IPS))}) THEN {{}} END"
    four = _where(_has("t", r"\p{Nd}\.\p{Nd}", ""), spans(matches("t", P.IPV4), "IP_ADDRESS", "universal", rank, 0, score.format(0.90)))
    six = _where(f"(contains(t, '::') OR {_has('t', '(?:[0-9a-fA-F]{1,4}:){7}', '')})", spans(matches("t", P.IPV6), "IP_ADDRESS", "universal", rank, 1, score.format(0.85)))
    return _joined([four, six])


def _inner_name(found: str) -> str:
    """Matches narrowed to the name in them, which is searched with regard to case; without one they go."""
    p = lit("(?U)" + P.NAME)
    begin = f"m.start + regexp_instr(m.text, {p}) - 1"
    narrow = let("name", f"regexp_extract(m.text, {p}, 0)", f"struct({begin} AS start, {begin} + length(name) AS `end`, name AS text)")
    return f"filter(transform({found}, m -> {narrow}), m -> m.text <> '')"


def _person(rank: int) -> str:
    titled = spans(_inner_name(matches("t", rf"\b{P.TITLES}\.?\s+{P.NAME}", IU)), "PERSON_NAME", "universal", rank, 0, 0.85)
    # a hit with the same span as a titled one loses in the fold, as its score is lower
    named = spans(_inner_name(matches("t", rf"\b{P.NAME_CONTEXTS}\s*[:=\-]?\s*{P.NAME}", IU)), "PERSON_NAME", "universal", rank, 1, 0.75)
    # what is left of a match is a name as it stands in the text, so there is none without such a name
    return _where(_has("t", P.NAME, "(?U)"), _joined([titled, named]))


def _birth(rank: int) -> str:
    near = f"CASE WHEN {_has(around('pages', 50), P.BIRTH_CONTEXT)} THEN 0.85 END"
    found = let("pages", blocks_of("t"), _joined([spans(matches("t", p, IU), "DATE_OF_BIRTH", "universal", rank, i, near) for i, p in enumerate(P.DATES)]))
    return _where(f"{_fragments(P.BIRTH_FRAGMENTS)} AND {_has('t', P.BIRTH_CONTEXT)}", found)


def _tn_id(rank: int) -> str:
    zero = "(m.text LIKE '0%')"
    s = f"CASE WHEN context THEN 0.90D ELSE 0.65D END - CASE WHEN {zero} THEN 0.10D ELSE 0.0D END"
    s = let("s", s, f"CASE WHEN {_has(around('pages', 50), P.TN_ID_CONTEXT)} THEN least(s + 0.15D, 0.98D) ELSE s END")
    s = let("s", s, "CASE WHEN replace(m.text, substring(m.text, 1, 1), '') = '' THEN greatest(s - 0.30D, 0.40D) ELSE s END")
    s = let("s", s, f"CASE WHEN {zero} THEN s ELSE least(s + 0.03D, 0.99D) END")
    found = spans("hits", "TN_NATIONAL_ID", "tn", rank, 0, s)
    return _where(FIVE_DIGITS, _found(P.TN_ID, let("context", _has("t", P.TN_ID_CONTEXT), let("pages", blocks_of("t"), found))))


def _tn_address(rank: int) -> str:
    postal = f"CASE WHEN cast(substring(m.text, 1, 4) AS int) BETWEEN 1000 AND 9999 THEN CASE WHEN {_has(around('pages', 60), P.TN_LOCALITY)} THEN 0.95 ELSE 0.90 END END"
    street = f"least(0.80D + CASE WHEN {_has('m.text', P.TN_NUMBER, '(?U)')} THEN 0.06D ELSE 0.0D END + CASE WHEN {_has('m.text', P.TN_LOCALITY)} THEN 0.06D ELSE 0.0D END, 0.95D)"
    coded = _found(P.TN_POSTAL, let("pages", blocks_of("t"), spans("hits", "TN_ADDRESS", "tn", rank, 0, postal)), IU)
    return _joined(
        [
            _where(_has("t", FOUR_DIGITS, ""), coded),
            _where(_fragments(P.TN_STREET_FRAGMENTS), spans(matches("t", P.TN_STREET, IU), "TN_ADDRESS", "tn", rank, 1, street)),
        ]
    )


def _tn_person(rank: int) -> str:
    def prefixed(prefix: str, order: int) -> str:
        narrow = let("name", f"regexp_replace(m.text, {lit('^(?U)' + prefix)}, '')", "struct(m.`end` - length(name) AS start, m.`end` AS `end`, name AS text)")
        score = "greatest(0.84D - CASE WHEN length(m.text) < 5 THEN 0.15D ELSE 0.0D END, 0.55D)"
        return spans(f"transform({matches('t', prefix + P.TN_NAME)}, m -> {narrow})", "PERSON_NAME", "tn", rank, order, score)

    ben = spans(matches("t", P.TN_BEN), "PERSON_NAME", "tn", rank, len(P.TN_PREFIXES), 0.72)
    return _joined([*[prefixed(p, i) for i, p in enumerate(P.TN_PREFIXES)], ben])


_BARE = f"regexp_replace(m.text, {lit(BLANKS)}, '')"


def _fr_nir(rank: int) -> str:
    def score(base: float) -> str:
        valid = "length(d) = 15 AND (cast(substring(d, 4, 2) AS int) BETWEEN 1 AND 12 OR cast(substring(d, 4, 2) AS int) BETWEEN 20 AND 42)"
        key = "97 - cast(substring(d, 1, 13) AS bigint) % 97 = cast(substring(d, 14, 2) AS bigint)"
        s = f"least({base}D + bonus, 0.99D)"
        return let("d", _BARE, f"CASE WHEN {valid} THEN CASE WHEN {key} THEN least({s} + 0.05D, 0.99D) ELSE {s} END END")

    bonus = f"CASE WHEN {_has('t', P.FR_NIR_CONTEXT)} THEN 0.08D ELSE 0.0D END"
    return _where(FIVE_DIGITS, _all_found([p for p, _ in P.FR_NIRS], "bonus", bonus, lambda hits, i: spans(hits, "FR_NIR", "fr", rank, i, score(P.FR_NIRS[i][1]))))


def _fr_company(rank: int) -> str:
    def score(n: int, with_: float, without: float) -> str:
        return let("d", _BARE, f"CASE WHEN length(d) = {n} AND {luhn_sql('d')} THEN CASE WHEN context THEN {with_} ELSE {without} END END")

    kinds = [("FR_SIRET", score(14, 0.95, 0.80)), ("FR_SIREN", score(9, 0.90, 0.70))]
    # a SIREN within a SIRET scores less and overlaps, so the fold drops it
    return _where(FIVE_DIGITS, _all_found([P.FR_SIRET, P.FR_SIREN], "context", _has("t", P.FR_COMPANY_CONTEXT), lambda hits, i: spans(hits, kinds[i][0], "fr", rank, i, kinds[i][1])))


def _fr_address(rank: int) -> str:
    code = "cast(substring(m.text, 1, {}) AS int)"
    postal = f"CASE WHEN {code.format(2)} BETWEEN 1 AND 95 OR {code.format(3)} BETWEEN 971 AND 976 THEN 0.85 END"
    return _joined([_where(FIVE_DIGITS, spans(matches("t", P.FR_POSTAL), "FR_ADDRESS", "fr", rank, 0, postal)), spans(matches("t", P.FR_STREET, IU), "FR_ADDRESS", "fr", rank, 1, 0.85)])


def _by_context(entity: str, locale: str, pattern: str, context: str, with_: float, without: float):
    def find(rank: int) -> str:
        return _where(FIVE_DIGITS, _found(pattern, let("context", _has("t", context), spans("hits", entity, locale, rank, 0, f"CASE WHEN context THEN {with_} ELSE {without} END"))))

    return find


def _tn_tax(rank: int) -> str:
    bonus = f"CASE WHEN {_has('t', P.TN_TAX_CONTEXT)} THEN 0.05D ELSE 0.0D END"
    scored = lambda hits, i: spans(hits, "TN_MATRICULE_FISCALE", "tn", rank, i, f"least({P.TN_TAX_IDS[i][1]}D + bonus, 0.99D)")
    return _where(FIVE_DIGITS, _all_found([p for p, _ in P.TN_TAX_IDS], "bonus", bonus, scored, IU))


#: In registry order, which settles ties of priority.
RECOGNIZERS = [
    Recognizer("email", ("EMAIL",), "universal", 40, _email),
    Recognizer("phone", ("PHONE",), "universal", 30, _phone),
    Recognizer("credit_card", ("CREDIT_CARD",), "universal", 45, _card),
    Recognizer("iban", ("IBAN",), "universal", 45, _iban),
    Recognizer("ip_address", ("IP_ADDRESS",), "universal", 35, _ip),
    Recognizer("person_name", ("PERSON_NAME",), "universal", 40, _person),
    Recognizer("date_of_birth", ("DATE_OF_BIRTH",), "universal", 45, _birth),
    Recognizer("tn_national_id", ("TN_NATIONAL_ID",), "tn", 75, _tn_id),
    Recognizer("tn_phone", ("TN_PHONE",), "tn", 80, _listed("TN_PHONE", "tn", P.TN_PHONES, test=FIVE_DIGITS)),
    Recognizer("tn_matricule_fiscale", ("TN_MATRICULE_FISCALE",), "tn", 85, _tn_tax),
    Recognizer("tn_address", ("TN_ADDRESS",), "tn", 60, _tn_address),
    Recognizer("fr_nir", ("FR_NIR",), "fr", 80, _fr_nir),
    Recognizer("fr_company", ("FR_SIRET", "FR_SIREN"), "fr", 75, _fr_company),
    Recognizer("fr_phone", ("FR_PHONE",), "fr", 80, _listed("FR_PHONE", "fr", P.FR_PHONES, test=FIVE_DIGITS)),
    Recognizer("fr_address", ("FR_ADDRESS",), "fr", 60, _fr_address),
    Recognizer("ma_cin", ("MA_CIN",), "ma", 75, _by_context("MA_CIN", "ma", P.MA_CIN, P.MA_CIN_CONTEXT, 0.92, 0.72)),
    Recognizer("ma_phone", ("MA_PHONE",), "ma", 80, _listed("MA_PHONE", "ma", P.MA_PHONES, test=FIVE_DIGITS)),
    Recognizer("ma_ice", ("MA_ICE",), "ma", 85, _by_context("MA_ICE", "ma", P.MA_ICE, P.MA_ICE_CONTEXT, 0.95, 0.55)),
]
#: Not selected by default.
OPTIONAL = [Recognizer("tn_person_name", ("PERSON_NAME",), "tn", 70, _tn_person)]


def pattern(name: str, entity_type: str, locale: str, priority: int, regex: str, score: float, ignore_case: bool = True) -> Recognizer:
    """A user's recognizer of one regular expression with a fixed score."""
    return Recognizer(name, (entity_type,), locale, priority, _listed(entity_type, locale, [(regex, score)], IU if ignore_case else "(?U)"))


@dataclass(frozen=True)
class PythonRecognizer:
    """A user's recognizer in Python, for what expressions cannot say: analyze(text) yields (entity_type, start, end, score).

    It runs on Arrow batches. If it raises for a text, that text has no spans of it, and its name among the errors.
    """

    name: str
    analyze: Callable[[str], Iterable[tuple[str, int, int, float]]]
    locale: str = "universal"
    priority: int = 50

    def apply(self, text: Column, rank: int) -> Column:
        """Struct (spans, error)."""
        analyze, locale = self.analyze, self.locale

        def run(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for t in texts:
                try:
                    found = [(int(s), -float(score), rank, 0, int(e), float(score), t[s:e], kind, locale) for kind, s, e, score in analyze(t)]
                    rows.append((found, False))
                except Exception:  # noqa: BLE001  whatever a user's code raises is an error of that row
                    rows.append(([], True))
            return pd.DataFrame(rows, columns=["spans", "error"])

        run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(run, f"spans {EMPTY}, error boolean")(text)


def select_recognizers(locales: list[str] = P.LOCALES, extra: list[Recognizer] = ()) -> list[Recognizer]:
    """Recognizers of these locales, in the order of the locales; unknown locales have none."""
    return [r for loc in locales for r in RECOGNIZERS if r.locale == loc] + list(extra)


def ranked(recognizers: list[Recognizer]) -> list[tuple[int, Recognizer]]:
    """(rank, recognizer), highest priority first, ties in the given order."""
    return list(enumerate(sorted(recognizers, key=lambda r: -r.priority)))
