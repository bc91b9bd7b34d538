"""Restoration of tokens in texts by a join with the vault.

Candidate tokens of a text are read with regular expressions, joined on (session_id, token), and come back to
their text as one map. So a hot session is spread over its tokens, and only the tokens a text names travel.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.functions.spans import bind
from pallium.operators.mask import normalize_type

# Forms of tokens that are recognised, strictest first.
EXACT = r"\{\{SG_([A-Z_]+)_([a-f0-9]{6,12})\}\}"
FUZZY = [
    r"[\{\[<\(]\{?\s*SG[_\s]+([A-Z_]+)[_\s]+([a-f0-9]{6,12})\s*\}?[\}\]>\)]",
    r"`\s*SG[_\s]+([A-Z_]+)[_\s]+([a-f0-9]{6,12})\s*`",
    r"[\"']SG[_\s]+([A-Z_]+)[_\s]+([a-f0-9]{6,12})[\"']",
]
BARE = r"\bSG[_\-\s]+([A-Z][A-Z_\-\s]+?)[_\-\s]+([a-f0-9]{6,12})\b"
TIERS = ("exact", "fuzzy_bracket", "bare_extraction")
PATTERNS = {"exact": [EXACT], "fuzzy_bracket": FUZZY, "bare_extraction": [BARE]}
RESULT = "restored_text string, tokens_restored int, tokens_not_found int, restored array<string>, strategies array<string>"


def canonical(kind: Column, suffix: Column) -> Column:
    return F.concat(F.lit("{{SG_"), normalize_type(kind), F.lit("_"), suffix, F.lit("}}"))


def candidate_tokens(text: Column, tiers: tuple[str, ...] = TIERS) -> Column:
    """Distinct canonical tokens that any of the tiers could read in the text; exact ones are looked up as they are written."""
    found = [F.regexp_extract_all(text, F.lit("(?i)" + EXACT), F.lit(0))]
    for tier in (t for t in tiers if t != "exact"):
        for p in PATTERNS[tier]:
            kinds, ends = (F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(g)) for g in (1, 2))
            found.append(F.zip_with(kinds, ends, canonical))
    return F.when(text.rlike("(?i)SG"), F.array_distinct(F.concat(*found))).otherwise(F.array().cast("array<string>"))


def _with_values(df: DataFrame, vault: DataFrame, text_col: str, session_col: str, tiers: tuple[str, ...]) -> DataFrame:
    """`df` with `values`, a map from each candidate token that its session knows to the value (column `value` of the vault).

    Only texts that may name a token are shuffled. Equal texts of a session share one map; Spark splits the join where one text has very many copies.
    """
    named = F.coalesce(F.col(text_col).rlike("(?i)SG"), F.lit(False))
    nothing = df.filter(~named).withColumn("values", F.create_map().cast("map<string,string>"))
    rows = df.filter(named).withColumn("_at", F.struct(F.col(session_col).alias("s"), F.unhex(F.sha2(F.col(text_col), 256)).alias("t")))
    asked = rows.select("_at", F.col(session_col).alias("session_id"), F.explode(candidate_tokens(F.col(text_col), tiers)).alias("token")).distinct()
    known = asked.join(vault.select("session_id", "token", "value").filter("value is not null and value <> ''"), ["session_id", "token"])
    maps = known.groupBy("_at").agg(F.map_from_entries(F.collect_set(F.struct("token", "value"))).alias("values"))
    found = rows.join(maps, "_at", "left").withColumn("values", F.coalesce("values", F.create_map().cast("map<string,string>"))).drop("_at")
    return found.unionByName(nothing)


def _exact(text: Column, values: Column) -> Column:
    """Tier 1 without Python: struct of RESULT."""
    p = "(?i)" + EXACT

    def built(x: Column) -> Column:
        put = F.transform(x["hits"], lambda t: F.coalesce(F.element_at(values, t), t))
        written = F.array_join(F.flatten(F.zip_with(x["gaps"], F.concat(put, F.array(F.lit(""))), lambda g, t: F.array(g, t))), "")
        counted = lambda found: F.struct(
            written.alias("restored_text"),
            F.coalesce(F.size(found), F.lit(0)).alias("tokens_restored"),
            F.coalesce(F.size(x["hits"]) - F.size(found), F.lit(0)).alias("tokens_not_found"),
            F.coalesce(F.array_distinct(found), F.array().cast("array<string>")).alias("restored"),
            F.when(F.size(found) > 0, F.array(F.lit("exact"))).otherwise(F.array().cast("array<string>")).alias("strategies"),
        )
        return bind(F.filter(x["hits"], lambda t: F.map_contains_key(values, t)), counted)

    return bind(F.struct(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("hits"), F.split(text, p, -1).alias("gaps")), built)


def _restorer(tiers: tuple[str, ...]):
    compiled = {t: [re.compile(p, re.IGNORECASE) for p in PATTERNS[t]] for t in tiers}

    def one(text: str, values: dict[str, str]) -> tuple:
        done: dict[str, str | None] = {}  # token -> the form in which it was restored; None: the exact one
        count = {"restored": 0, "missing": 0}
        used: list[str] = []
        for tier in tiers:
            for pattern in compiled[tier]:

                def put(m: re.Match, tier=tier) -> str:
                    if tier == "exact":
                        token, form = m.group(), None
                    else:
                        kind = re.sub(r"[\s\-]+", "_", m[1].strip()).upper()
                        token, form = f"{{{{SG_{kind}_{m[2]}}}}}", m.group()
                    if token not in values:
                        count["missing"] += tier == "exact"
                        return m.group()
                    if form is not None and token in done:
                        # a restored token stays where it is written otherwise; equal forms go together, counted once
                        return values[token] if done[token] == form else m.group()
                    done[token] = form
                    count["restored"] += 1
                    if tier not in used:
                        used.append(tier)
                    return values[token]

                text = pattern.sub(put, text)
        return text, count["restored"], count["missing"], sorted(done), used

    @F.pandas_udf(RESULT)
    def restored(texts: pd.Series, values: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0, [], []) if t is None else one(t, dict(v or {})) for t, v in zip(texts, values, strict=True)]
        return pd.DataFrame(rows, columns=["restored_text", "tokens_restored", "tokens_not_found", "restored", "strategies"])

    return restored


def restore(df: DataFrame, vault: DataFrame, text_col: str = "text", session_col: str = "session_id", tiers: tuple[str, ...] = TIERS, tokens_sent: str | None = None) -> DataFrame:
    """`df` plus restored_text, tokens_restored, tokens_not_found, restored, strategies, and completeness.

    The vault has session_id, token and value (unseal it after filtering). Exact tokens count at each
    occurrence. Later tiers skip tokens that an earlier one restored. `tokens_sent` names an array column;
    completeness is restored / sent (1 if nothing was sent; above 1 if tokens repeat), completeness_distinct
    counts each token once, unreplaced lists the tokens that never came back. Null texts stay null.
    """
    rows = _with_values(df, vault, text_col, session_col, tiers)
    result = _exact(F.col(text_col), F.col("values")) if tuple(tiers) == ("exact",) else _restorer(tuple(tiers))(F.col(text_col), F.col("values"))
    out = rows.withColumn("_r", result).select(*df.columns, "_r.*")
    sent = F.array_distinct(F.col(tokens_sent)) if tokens_sent else F.array().cast("array<string>")
    n = F.coalesce(F.size(sent), F.lit(0))
    return out.withColumns(
        {
            "tokens_sent_count": n,
            "completeness": F.when(n > 0, F.col("tokens_restored") / n).otherwise(1.0),
            "completeness_distinct": F.when(n > 0, F.size(F.array_intersect(sent, "restored")) / n).otherwise(1.0),
            "unreplaced": F.array_sort(F.array_except(sent, "restored")),
        }
    )


def restore_distinct(df: DataFrame, vault: DataFrame, text_col: str = "text", session_col: str = "session_id") -> DataFrame:
    """`df` plus restored_text and counts of distinct exact tokens that were restored or not found."""
    out = restore(df, vault, text_col, session_col, ("exact", "fuzzy_bracket"))
    tokens = F.array_distinct(F.regexp_extract_all(text_col, F.lit("(?i)" + EXACT), F.lit(0)))
    return out.select(*df.columns, "restored_text", F.size(F.array_intersect(tokens, "restored")).alias("distinct_restored"), F.size(F.array_except(tokens, "restored")).alias("distinct_not_found"))


def round_trip(masked: DataFrame, vault: DataFrame, text_col: str = "text", session_col: str = "session_id") -> DataFrame:
    """Rows of a masked table whose restored text differs from the original. Must be empty without redaction."""
    return restore(masked, vault, "masked_text", session_col, ("exact",)).filter(~F.col("restored_text").eqNullSafe(F.col(text_col)))
