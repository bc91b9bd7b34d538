"""Sample texts of each recognizer, and the folds."""

import pytest
from pyspark.sql import functions as F

from pallium.functions.recognizers import OPTIONAL, RECOGNIZERS, PythonRecognizer, pattern, ranked, select_recognizers
from pallium.functions.spans import luhn, mod97
from pallium.operators.detect import detect, detections
from pallium.operators.mask import mask, split_failed

CASES = [
    ("email", "contact user@a.com or admin@b.org", ["user@a.com", "admin@b.org"]),
    ("email", "a@b.co_x@d.ee", ["a@b.co", "_x@d.ee"]),
    ("email", "no mail here", []),
    ("phone", "call +1 743 555 3824 now", ["+1 743 555 3824"]),
    ("credit_card", "card 4111 1111 1111 1111 ok", ["4111 1111 1111 1111"]),
    ("credit_card", "card 4111 1111 1111 1112 bad", []),
    ("iban", "FR7612345987650123456789014", ["FR7612345987650123456789014"]),
    ("iban", "XX7612345987650123456789014", []),
    ("ip_address", "from 192.168.10.42 and 127.0.0.1", ["192.168.10.42"]),
    ("ip_address", "Python version 3.11.5", []),
    ("person_name", "The weather is nice today in Paris", []),
    ("date_of_birth", "Date of birth: 15/03/1990", ["15/03/1990"]),
    ("date_of_birth", "The meeting is on 15/03/2024", []),
    ("date_of_birth", "تاريخ الميلاد 15/03/1990", ["15/03/1990"]),
    ("tn_national_id", "CIN 12345678 and 123456789", ["12345678"]),
    ("tn_phone", "+216 98 765 432", ["+216 98 765 432"]),
    ("tn_matricule_fiscale", "MF 1234567A/P/000", ["1234567A/P/000"]),
    ("tn_address", "1001 Tunis", ["1001 Tunis"]),
    ("fr_nir", "185057800608436", ["185057800608436"]),
    ("fr_company", "732 829 320 00074", ["732 829 320 00074"]),
    ("fr_phone", "+33 6 12 34 56 78", ["+33 6 12 34 56 78"]),
    ("ma_cin", "CIN AB123456", ["AB123456"]),
    ("ma_ice", "ICE 001234567890123", ["001234567890123"]),
    ("tn_person_name", "السيد Mohamed Ben Salah", ["Mohamed Ben Salah"]),
]


def test_samples(spark):
    for name in {c[0] for c in CASES}:
        r = next(x for x in [*RECOGNIZERS, *OPTIONAL] if x.name == name)
        rows = [(i, c[1]) for i, c in enumerate(CASES) if c[0] == name]
        out = spark.createDataFrame(rows, "i int, text string").select("i", F.transform(r.recognize(F.col("text")), lambda s: s["text"]).alias("found"), r.recognize(F.col("text")).alias("s"), "text")
        for row in out.collect():
            assert row.found == CASES[row.i][2], CASES[row.i]
            assert all(row.text[s.start : s.end].strip() == s.text for s in row.s)


def test_long_and_odd_texts(spark):
    text = "x" * 100_000 + " test@example.com " + "y" * 100_000
    rows = [(0, text), (1, ""), (2, None), (3, "a"), (4, "🎉日本 مرحبا")]
    got = {r.id: r for r in detect(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert [s.text for s in got[0].spans] == ["test@example.com"] and got[0].spans[0].start == 100_001
    assert all(not got[i].spans for i in (1, 2, 3, 4))


def test_fold_depends_on_order(spark):
    # the second replaces the first, the third the second, though the first and third do not touch
    specs = [pattern("a", "A", "universal", 50, "aaaaabbbbb", 0.8), pattern("b", "B", "universal", 50, "bbbbbccccc", 0.9), pattern("c", "C", "universal", 50, "cccccddddd", 0.95)]
    out = detections(detect(spark.createDataFrame([(1, "aaaaabbbbbcccccddddd")], "id int, text string"), locales=[], extra=specs), ["id"]).collect()
    assert [r.entity_type for r in out] == ["C"]


def test_ranks_and_locales(caplog):
    assert [r.name for _, r in ranked(select_recognizers())][:3] == ["tn_matricule_fiscale", "ma_ice", "tn_phone"]
    assert {r.locale for r in select_recognizers(["fr", "xx"])} == {"fr"}


@pytest.mark.parametrize("number,good", [("4111111111111111", True), ("4111111111111112", False), ("73282932000074", True)])
def test_luhn(spark, number, good):
    assert spark.range(1).select(luhn(F.lit(number))).first()[0] is good


def test_mod97(spark):
    assert spark.range(1).select(mod97(F.lit("GB82WEST12345698765432"))).first()[0] == 1


def test_python_recognizers_fail_closed(spark):
    def shout(text):
        if "!" in text:
            raise ValueError(text)
        return [("SHOUT", m, m + 3, 0.9) for m in [text.find("ABC")] if m >= 0]

    df = spark.createDataFrame([(1, "x ABC a@b.com"), (2, "! ABC a@b.com"), (3, None)], "id int, text string")
    out = {r.id: r for r in detect(df, python=[PythonRecognizer("shout", shout)]).collect()}
    assert [s.entity_type for s in out[1].spans] == ["SHOUT", "EMAIL"] and out[1].errors == []
    assert [s.entity_type for s in out[2].spans] == ["EMAIL"] and out[2].errors == ["shout"]
    ok, bad = split_failed(mask(detect(df.withColumn("session_id", F.lit("s")), python=[PythonRecognizer("shout", shout)])), ["id"])
    assert {r.id for r in ok.collect()} == {1, 3} and [(r.id, r.reason) for r in bad.collect()] == [(2, "recognizer failed")]
