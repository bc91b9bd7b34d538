"""Spans of regular expressions in texts, and folds over span arrays, as SQL expressions.

A span is a struct led by its sort key (start, score negated, rank, ord), so that sorting an array of spans
needs no comparator. Expressions are built as SQL text: one call makes a Column of it, where building the same by
Column methods takes thousands of calls to the JVM. Names of lambda variables differ from helper to helper, so they nest.

All work is linear in the length of a text and in its number of matches: arrays grow by blocks, not by elements, and
characters are found by blocks of the text, not from its start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,minus_score:double,rank:int,ord:int,end:int,score:double,text:string,entity_type:string,locale:string>"
EMPTY = f"array<{SPAN}>"
FIELDS = [f.split(":")[0] for f in SPAN.removeprefix("struct<").removesuffix(">").split(",")]
_MATCHES = "array<struct<start:int,end:int,text:string>>"
#: Elements that are folded before an array grows, and bits of the number of characters of a text's block.
FOLDED, BLOCK_BITS = 128, 9
#: Matches whose positions are measured one by one.
FEW = 8
#: A character that few texts hold.
MARK = r"'\u0001'"


def lit(text: str) -> str:
    """A string as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: Column, name: str, sql: str) -> Column:
    """The expression `sql`, in which `name` stands for `value`, computed once."""
    return F.call_function("transform", F.array(value), F.expr(f"{name} -> {sql}"))[0]


def bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(items: str, carry: str, kind: str, following: str, emitted: str, short: bool = True) -> str:
    """A fold of `items` (a variable) from the left: struct (carry, out), `out` an array (`kind`) of what the items let go.

    `following` and `emitted` (an array of `kind`) are expressions over a.carry and the item x. A fold copies all it has
    gathered at every step, so more than FOLDED items are folded by blocks: once for the carry at the start of each block, then each block by itself
    for what it lets go. So an item is copied a bounded number of times. Where hardly any are few, not `short` makes a smaller expression.
    """
    folded = f"struct({following} AS carry, concat(a.out, {emitted}) AS out)"
    few = f"aggregate({items}, struct({carry} AS carry, cast(array() AS {kind}) AS out), (a, x) -> {folded})"
    blocks = f"transform(sequence(0, cast((size({items}) - 1) div {FOLDED} AS int)), b -> slice({items}, {FOLDED} * b + 1, {FOLDED}))"
    last = f"aggregate(part, struct(element_at(done, -1) AS carry), (a, x) -> struct({following} AS carry), a -> a.carry)"
    carries = f"aggregate(blocks, array({carry}), (done, part) -> concat(done, array({last})))"
    gone = f"aggregate(part, struct(carries[k] AS carry, cast(array() AS {kind}) AS out), (a, x) -> {folded}, a -> a.out)"
    many = let("blocks", blocks, let("carries", carries, f"struct(element_at(carries, -1) AS carry, flatten(transform(blocks, (part, k) -> {gone})) AS out)"))
    return f"CASE WHEN size({items}) <= {FOLDED} THEN {few} ELSE {many} END" if short else many


def matches(t: str, pattern: str, flags: str = "(?U)") -> str:
    """Array of (start, end, text) of all matches, in code points; half-open.

    Positions come from the pieces between the matches: of few matches from all the pieces before, of more by a scan.
    A text without a match costs one search.
    """
    p = lit(flags + pattern)
    begin = "a.carry + length(x.gap)"
    pairs = "zip_with(f.hits, slice(f.gaps, 1, size(f.hits)), (h, g) -> struct(h AS hit, g AS gap))"
    laid = scan("pairs", "0", _MATCHES, f"{begin} + length(x.hit)", f"array(struct({begin} AS start, {begin} + length(x.hit) AS `end`, x.hit AS text))", short=False)
    begins = "transform(f.hits, (h, i) -> length(array_join(slice(f.gaps, 1, i + 1), '')) + length(array_join(slice(f.hits, 1, i), '')))"
    few = f"zip_with({begins}, f.hits, (n, h) -> struct(n AS start, n + length(h) AS `end`, h AS text))"
    # a pattern to split by is compiled anew for each text, but not one character
    gaps = f"CASE WHEN contains({t}, {MARK}) THEN split({t}, {p}, -1) ELSE split(regexp_replace({t}, {p}, {MARK}), {MARK}, -1) END"
    found = let("f", f"struct(regexp_extract_all({t}, {p}, 0) AS hits, {gaps} AS gaps)", f"CASE WHEN size(f.hits) <= {FEW} THEN {few} ELSE {let('pairs', pairs, f'({laid}).out')} END")
    return f"CASE WHEN {t} RLIKE {p} THEN {found} ELSE cast(array() AS {_MATCHES}) END"


def spans(found: str, entity: str, locale: str, rank: int, order: int, score: str | float, value: str = "m.text") -> str:
    """Spans of matches; score and value are expressions over the match m. A null score drops the match."""
    scored = f"transform({found}, m -> struct(m.start AS start, m.`end` AS `end`, cast({score} AS double) AS score, {value} AS text))"
    return (
        f"transform(filter({scored}, s -> s.score IS NOT NULL), s -> struct(s.start AS start, -s.score AS minus_score, {rank} AS rank, {order} AS ord, "
        f"s.`end` AS `end`, s.score AS score, s.text AS text, {lit(entity)} AS entity_type, {lit(locale)} AS locale))"
    )


def fold_sql(found: str) -> str:
    """Left to right by (start, score descending, rank): an overlapping span replaces the last one kept only with a higher score."""
    following = "CASE WHEN a.carry IS NULL OR x.start >= a.carry.`end` OR x.score > a.carry.score THEN x ELSE a.carry END"
    emitted = f"CASE WHEN x.start >= a.carry.`end` THEN array(a.carry) ELSE cast(array() AS {EMPTY}) END"
    folded = scan("sorted", f"cast(NULL AS {SPAN})", EMPTY, following, emitted)
    return let("sorted", f"sort_array({found})", f"CASE WHEN size(sorted) <= 1 THEN sorted ELSE {let('z', folded, 'concat(z.out, array(z.carry))')} END")


def fold_overlaps(found: Column) -> Column:
    return bound(found, "spans", fold_sql("spans"))


def blocks_of(t: str) -> str:
    """The text in blocks, for cut(): one pass over it."""
    return f"regexp_extract_all({t}, '(?s).{{1,{1 << BLOCK_BITS}}}', 0)"


def cut(blocks: str, begin: str, end: str) -> str:
    """Characters [begin, end) of a text, from the blocks they lie in."""
    first = f"shiftright({begin}, {BLOCK_BITS})"
    whole = f"array_join(slice({blocks}, {first} + 1, greatest(shiftright({end} - 1, {BLOCK_BITS}) - {first} + 1, 0)), '')"
    return f"substring({whole}, ({begin}) % {1 << BLOCK_BITS} + 1, {end} - ({begin}))"


def around(blocks: str, n: int) -> str:
    """The match m with n characters before and after it."""
    return cut(blocks, f"greatest(m.start - {n}, 0)", f"(m.`end` + {n})")


def digits(v: str) -> str:
    blank = lit(r"(?U)[\s\-]")
    return f"regexp_replace({v}, {blank}, '')"


def luhn_sql(number: str) -> str:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    # every second figure is looked up where it stands if doubled: 5 as 1, 1 as 2, 6 as 3; other characters count nothing
    doubled = f"transform(split(reverse({number}), ''), (d, i) -> locate(d, CASE WHEN i % 2 = 0 THEN '0123456789' ELSE '0516273849' END))"
    return f"aggregate({doubled}, 0, (sum, d) -> CASE WHEN d > 1 THEN sum + d - 1 ELSE sum END) % 10 = 0"


def mod97_sql(iban: str) -> str:
    """The ISO 13616 remainder, letter by letter: 1 for a valid number."""
    moved = f"concat(substring({iban}, 5, 40), substring({iban}, 1, 4))"
    values = f"transform(filter(split(upper({moved}), ''), c -> c <> ''), c -> CASE WHEN c RLIKE '[0-9]' THEN cast(c AS int) ELSE ascii(c) - 55 END)"
    return f"aggregate({values}, 0, (rest, v) -> CASE WHEN v < 10 THEN rest * 10 + v ELSE rest * 100 + v END % 97)"


def luhn(number: Column) -> Column:
    return bound(number, "n", luhn_sql("n"))


def mod97(iban: Column) -> Column:
    return bound(iban, "n", mod97_sql("n"))
