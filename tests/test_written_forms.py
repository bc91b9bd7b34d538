"""Every written form of what the recognizers know, with values and scores written by hand."""

import pytest

from pallium.functions.recognizers import OPTIONAL, RECOGNIZERS
from pallium.operators.detect import detect
from pyspark.sql import functions as F

#: recognizer, text, {value: score}
FORMS = [
    ("email", "a.b+c%d@x-y.co.uk, A_9@B.ORG; no@dot", {"a.b+c%d@x-y.co.uk": 0.95, "A_9@B.ORG": 0.95}),
    ("phone", "+44 20 7946 0958", {"+44 20 7946 0958": 0.85}),
    ("phone", "+1-743-555-3824", {"+1-743-555-3824": 0.85}),
    ("phone", "+49(30)1234567", {"+49(30)1234567": 0.85}),
    ("phone", "(021) 555 6666 and (0211)-555-6666", {"(021) 555 6666": 0.80, "(0211)-555-6666": 0.80}),
    ("phone", "555 6666, +12", {}),
    ("credit_card", "4111-1111-1111-1111", {"4111-1111-1111-1111": 0.95}),
    ("credit_card", "4222222222222", {"4222222222222": 0.95}),  # Visa of 13 digits
    ("credit_card", "5500 0000 0000 0004", {"5500 0000 0000 0004": 0.95}),  # Mastercard
    ("credit_card", "3782 822463 10005", {"3782 822463 10005": 0.95}),  # American Express
    ("credit_card", "6011111111111117 6500000000000002", {"6011111111111117": 0.95, "6500000000000002": 0.95}),  # one run of digits, but a number ends at a border
    ("credit_card", "6011111111111117; 6500000000000002", {"6011111111111117": 0.95, "6500000000000002": 0.95}),
    ("credit_card", "3530111333300000", {"3530111333300000": 0.80}),  # passes Luhn, of no listed issuer
    ("iban", "GB82 WEST 1234 5698 7654 32", {"GB82 WEST 1234 5698 7654 32": 0.95}),
    ("iban", "DE89370400440532013000", {"DE89370400440532013000": 0.95}),
    ("iban", "TN59 1000 6035 1835 9847 8831", {"TN59 1000 6035 1835 9847 8831": 0.95}),
    ("iban", "DE89370400440532013001", {"DE89370400440532013001": 0.70}),  # wrong check digits
    ("iban", "DE8937040044053201300", {}),  # wrong length
    ("ip_address", "10.0.0.255 256.1.1.1", {"10.0.0.255": 0.90}),
    ("ip_address", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", {"2001:0db8:85a3:0000:0000:8a2e:0370:7334": 0.85}),
    ("ip_address", "0.0.0.0 127.0.0.1 255.255.255.255 10.1.2.3", {"10.1.2.3": 0.90}),
    ("person_name", "Dr. Marie Curie spoke", {"Marie Curie": 0.85}),
    ("person_name", "Mme. Anne de Villiers", {"Anne de Villiers": 0.85}),
    ("person_name", "Mme Anne de Villiers", {"Mme Anne de Villiers": 0.85}),  # names are searched in the whole match, so a title without a dot comes along
    ("person_name", "Client: Mohamed Salah", {"Mohamed Salah": 0.75}),
    ("person_name", "signed by Jean Dupont", {"Jean Dupont": 0.75}),
    ("date_of_birth", "born on 1990-03-15", {"1990-03-15": 0.85}),
    ("date_of_birth", "née le 15 mars 1990", {"15 mars 1990": 0.85}),
    ("date_of_birth", "DOB: March 15, 1990", {"March 15, 1990": 0.85}),
    ("date_of_birth", "date de naissance 15.03.90", {"15.03.90": 0.85}),
    ("date_of_birth", "geburtsdatum " + "x" * 60 + " 15.03.1990", {}),  # the keyword is too far away
    ("tn_national_id", "12345678", {"12345678": 0.68}),
    ("tn_national_id", "CIN 12345678", {"12345678": 0.99}),  # 0.90 + 0.15, at most 0.98, + 0.03, at most 0.99
    ("tn_national_id", "CIN: 01234567", {"01234567": 0.95}),  # 0.90 - 0.10 + 0.15
    ("tn_national_id", "22222222", {"22222222": 0.43}),  # 0.65 - 0.30, at least 0.40, + 0.03
    ("tn_phone", "+216 98 765 432", {"+216 98 765 432": 0.98}),
    ("tn_phone", "00216-98-765-432", {"00216-98-765-432": 0.98}),
    ("tn_phone", "216 22 333 444", {"216 22 333 444": 0.90}),
    ("tn_phone", "98 765 432 and 71-234-567", {"98 765 432": 0.75, "71-234-567": 0.75}),
    ("tn_phone", "88 765 432", {}),
    ("tn_matricule_fiscale", "1234567A/P/000", {"1234567A/P/000": 0.98}),
    ("tn_matricule_fiscale", "1234567AP000", {"1234567AP000": 0.85}),
    ("tn_matricule_fiscale", "matricule fiscal 1234567A", {"1234567A": 0.75}),
    ("tn_address", "2000 Sfax", {"2000 Sfax": 0.90}),
    ("tn_address", "appt 4, 2000 Sfax", {"2000 Sfax": 0.95}),
    ("tn_address", "0999 Sfax", {}),
    ("tn_address", "Avenue Farhat Hached", {"Avenue Farhat Hached": 0.80}),
    ("tn_address", "شارع الحبيب بورقيبة", {"شارع الحبيب بورقيبة": 0.86}),
    ("fr_nir", "1 85 05 78 006 084 91", {"1 85 05 78 006 084 91": 0.95}),  # a right key: + 0.05
    ("fr_nir", "185057800608436", {"185057800608436": 0.90}),
    ("fr_nir", "NIR 185057800608491", {"185057800608491": 0.99}),
    ("fr_nir", "185137800608491", {}),  # month 13
    ("fr_company", "73282932000074", {"73282932000074": 0.80}),
    ("fr_company", "SIREN 732 829 320", {"732 829 320": 0.90}),
    ("fr_company", "732 829 321", {}),
    ("fr_phone", "0033 6 12 34 56 78", {"0033 6 12 34 56 78": 0.98}),
    ("fr_phone", "06.12.34.56.78", {"06.12.34.56.78": 0.88}),
    ("fr_phone", "01 23 45 67 89", {"01 23 45 67 89": 0.88}),
    ("fr_address", "75002 Paris", {"75002 Paris": 0.85}),
    ("fr_address", "97400 Saint-denis", {"97400 Saint-denis": 0.85}),  # overseas
    ("fr_address", "96000 Nulle", {}),
    ("fr_address", "12, allée des Roses", {"12, allée des Roses": 0.85}),
    ("ma_cin", "AB123456", {"AB123456": 0.72}),
    ("ma_cin", "CNIE K12345", {"K12345": 0.92}),
    ("ma_phone", "+212 612 34 56 78", {"+212 612 34 56 78": 0.98}),
    ("ma_phone", "00212-612-345678", {"00212-612-345678": 0.98}),
    ("ma_phone", "0612.34.56.78", {"0612.34.56.78": 0.88}),
    ("ma_ice", "001234567890123", {"001234567890123": 0.55}),
    ("ma_ice", "identifiant commun 001234567890123", {"001234567890123": 0.95}),
    *[("tn_person_name", f"{p} Mohamed Ben Salah", {"Mohamed Ben Salah": 0.84}) for p in ("Mr", "Mme", "Monsieur", "Madame", "Dr.", "Pr")],
    *[("tn_person_name", f"{p} محمد بن صالح", {"محمد بن صالح": 0.84}) for p in ("السيد", "السيدة", "الاستاذ", "الدكتور")],
    ("tn_person_name", "Ben Youssef", {"Ben Youssef": 0.72}),
    ("tn_person_name", "Dr Ali", {"Ali": 0.69}),  # a short name: - 0.15
]


@pytest.fixture(scope="module")
def found(spark):
    by_name = {r.name: r for r in [*RECOGNIZERS, *OPTIONAL]}
    out = {}
    for name in dict.fromkeys(f[0] for f in FORMS):
        rows = [(i, f[1]) for i, f in enumerate(FORMS) if f[0] == name]
        for r in spark.createDataFrame(rows, "i int, text string").select("i", "text", by_name[name].recognize(F.col("text")).alias("s")).collect():
            assert all(r.text[s.start : s.start + len(s.text)] == s.text for s in r.s)
            out[r.i] = {s.text: round(s.score, 6) for s in r.s}
    return out


@pytest.mark.parametrize("i", range(len(FORMS)), ids=[f"{f[0]}-{f[1][:24]}" for f in FORMS])
def test_written_form(found, i):
    assert found[i] == FORMS[i][2]


def test_forms_win_over_each_other(spark):
    """Which of several recognizers keeps a place: the higher score, after 0.05 more for those of a country."""
    cases = {
        "+216 98 765 432": ["TN_PHONE"], "0612345678": ["FR_PHONE"], "CIN 12345678": ["TN_NATIONAL_ID"], "+33 6 12 34 56 78": ["FR_PHONE"],
        "ICE 001234567890123": ["MA_ICE"], "4111 1111 1111 1111": ["CREDIT_CARD"], "SIRET 732 829 320 00074": ["FR_SIRET"], "1234567A/P/000": ["TN_MATRICULE_FISCALE"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    got = {r.text: [s.entity_type for s in r.spans] for r in detect(df).collect()}
    assert got == cases
