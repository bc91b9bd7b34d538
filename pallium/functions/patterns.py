"""Fixed values of the recognizers: expressions, keywords, tables and scores.

Fixed values: these must equal the published behaviour of the recognizers for right results. Expressions are
in Java's dialect with Unicode classes; `for_re2` gives the form without them for other engines.
"""

from __future__ import annotations

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONES = [
    (r"\+\d{1,3}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{2,4}[\s\-]?\d{2,4}[\s\-]?\d{0,4}", 0.85),
    (r"\(\d{2,4}\)[\s\-]?\d{3,4}[\s\-]?\d{3,4}", 0.80),
]
CARD = r"\b(?:\d[ \-]?){13,19}\b"
IBAN = r"\b[A-Z]{2}\d{2}[\s\-]?[\dA-Z]{4}[\s\-]?(?:[\dA-Z]{4}[\s\-]?){1,7}[\dA-Z]{1,4}\b"
IBAN_LENGTHS = {
    "AL": 28, "AD": 24, "AT": 20, "AZ": 28, "BH": 22, "BY": 28, "BE": 16, "BA": 20, "BR": 29, "BG": 22, "CR": 22, "HR": 21,
    "CY": 28, "CZ": 24, "DK": 18, "DO": 28, "TL": 23, "EG": 29, "SV": 28, "EE": 20, "FO": 18, "FI": 18, "FR": 27, "GE": 22,
    "DE": 22, "GI": 23, "GR": 27, "GL": 18, "GT": 28, "HU": 28, "IS": 26, "IQ": 23, "IE": 22, "IL": 23, "IT": 27, "JO": 30,
    "KZ": 20, "XK": 20, "KW": 30, "LV": 21, "LB": 28, "LY": 25, "LI": 21, "LT": 20, "LU": 20, "MK": 19, "MT": 31, "MR": 27,
    "MU": 30, "MC": 27, "MD": 24, "ME": 22, "NL": 18, "NO": 15, "PK": 24, "PS": 29, "PL": 28, "PT": 25, "QA": 29, "RO": 24,
    "LC": 32, "SM": 27, "ST": 25, "SA": 24, "RS": 22, "SC": 31, "SK": 24, "SI": 19, "ES": 24, "SD": 18, "SE": 24, "CH": 21,
    "TN": 24, "TR": 26, "UA": 29, "AE": 23, "GB": 22, "VA": 22, "VG": 24, "MA": 28,
}
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b"
IGNORED_IPS = ["0.0.0.0", "127.0.0.1", "255.255.255.255", "::1"]
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Eng|Mme|Mlle|M\.|Maître|Si|Sra|Sidi|Lalla|Hajj|Hajja)"
NAME_CONTEXTS = r"(?:name|nom|اسم|client|customer|employee|patient|contact|debtor|creditor|borrower|user|subscriber|applicant|candidate|owner|beneficiary|signataire|signed by|from|to|dear|cher|chère|attn)"
NAME = r"([A-ZÀ-ÿ][a-zà-ÿ]+(?:\s+(?:ben|el|al|de|du|van|von|di|le|la|ibn|bint|ould|ait|ou)?(?:\s+)?[A-ZÀ-ÿ][a-zà-ÿ]+){1,3})"
BIRTH_CONTEXT = r"(?:date\s+(?:of\s+)?birth|birth\s*date|dob|d\.o\.b|born\s+(?:on)?|née?\s+le|date\s+de\s+naissance|تاريخ\s*الميلاد|تاريخ\s*الولادة|fecha\s+de\s+nacimiento|data\s+di\s+nascita|geburtsdatum|birthday)"
#: Upper-case parts of the keywords above without the letter i: every text with such a keyword holds one of them.
BIRTH_FRAGMENTS = ["RTH", "DOB", "D.O.B", "BORN", "NÉ", "NA", "GEBURTSDATUM", "تاريخ"]
MONTHS = r"(?:january|february|march|april|may|june|july|august|september|october|november|december|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)"
DATES = [
    r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})",
    r"(\d{4}[/\-]\d{1,2}[/\-]\d{1,2})",
    rf"(\d{{1,2}}\s+{MONTHS}\s+\d{{2,4}})",
    rf"({MONTHS}\s+\d{{1,2}},?\s+\d{{2,4}})",
]

TN_ID = r"(?<!\d)(\d{8})(?!\d)"
TN_ID_CONTEXT = r"\bCIN\b|carte\s+d'identit[eé]|identit[eé]\s+nationale|num[eé]ro\s+national|رقم\s+بطاقة|بطاقة\s+التعريف|مواطن|n°\s*national|national\s*id"
TN_PHONES = [
    (r"(?:\+216|00216)[\s\-]?[2-9]\d[\s\-]?\d{3}[\s\-]?\d{3}", 0.98),
    (r"\b216[\s\-]?[2-9]\d[\s\-]?\d{3}[\s\-]?\d{3}\b", 0.90),
    (r"\b(?:[2459]\d|7[0-9]|3[0-9])[\s\-]?\d{3}[\s\-]?\d{3}\b", 0.75),
]
TN_TAX_IDS = [(r"\b\d{7}[A-Z]/[A-Z]/\d{3}\b", 0.98), (r"\b\d{7}[A-Z][A-Z]\d{3}\b", 0.85), (r"\b\d{7}[A-Z]\b", 0.70)]
TN_TAX_CONTEXT = r"\bMF\b|matricule\s+fiscale?|identifiant\s+fiscal|معرف\s+جبائي|رقم\s+الأداء"
TN_GOVERNORATES = "Tunis|Ariana|Ben Arous|Manouba|Nabeul|Zaghouan|Bizerte|Béja|Jendouba|Le Kef|Siliana|Sousse|Monastir|Mahdia|Sfax|Kairouan|Kasserine|Sidi Bouzid|Gabès|Médenine|Tataouine|Gafsa|Tozeur|Kébili"
TN_POSTAL = rf"\b(\d{{4}})\s+({TN_GOVERNORATES})\b"
TN_LOCALITY = r"\bdelegation\b|\bimmeuble\b|\bappt\b|\bappartement\b|\bcite\b|\bcit[eé]\b|\blot\b|\blotissement\b|\broute\s+de\b|\bzone\s+industrielle\b|حي|نهج|شارع|طريق|عمارة|شقة|ولاية"
TN_STREET = r"(?:rue|avenue|av\.|boulevard|blvd|impasse|lotissement|cité|résidence|حي|شارع|نهج)[\s\w\-\',éèêëàâîïôùûü]{3,60}(?:,\s*\d{4}\s*[A-Za-zéèêëàâîïôùûü\s]+)?"
#: As BIRTH_FRAGMENTS, of the streets' first words.
TN_STREET_FRAGMENTS = ["RUE", "AVENUE", "AV.", "BOULEVARD", "BLVD", "MPASSE", "SSEMENT", "TÉ", "DENCE", "حي", "شارع", "نهج"]
TN_NUMBER = r"\b\d{1,4}\b"
TN_PREFIXES = [r"\bM(?:r|me|onsieur|adame)\.?\s+", r"\bMme\.?\s+", r"\bDr\.?\s+", r"\bPr\.?\s+", r"\bالسيد\s+", r"\bالسيدة\s+", r"\bالاستاذ\s+", r"\bالدكتور\s+"]
TN_NAME = r"(?:[A-Z][a-z]{2,}(?:\s+(?:Ben|ben|Bin|bin|Ibn|ibn)\s+[A-Z][a-z]{2,})?(?:\s+[A-Z][a-z]{2,})?|[ء-ي]{2,}(?:\s+(?:بن|ابن|بن\s+علي|عبد)\s+[ء-ي]{2,})?(?:\s+[ء-ي]{2,})?)"
TN_BEN = r"\bBen\s+[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})?\b"

FR_NIRS = [(r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2,3}\s?\d{3}\s?\d{3}\s?\d{2}\b", 0.90), (r"\b[12]\d{14}\b", 0.80)]
FR_NIR_CONTEXT = r"\bNIR\b|num[eé]ro\s+de\s+s[eé]curit[eé]\s+sociale|s[eé]curit[eé]\s+sociale|num[eé]ro\s+INSEE|\bINSEE\b|immatriculation"
FR_SIRET = r"\b(\d{3}[\s]?\d{3}[\s]?\d{3}[\s]?\d{5})\b"
FR_SIREN = r"\b(\d{3}[\s]?\d{3}[\s]?\d{3})\b"
FR_COMPANY_CONTEXT = r"\bSIRET\b|\bSIREN\b|registre\s+du\s+commerce|\bRCS\b|immatriculation|num[eé]ro\s+d'entreprise"
FR_PHONES = [(r"(?:\+33|0033)[\s\-]?[1-9](?:[\s.\-]?\d{2}){4}", 0.98), (r"\b0[1-9](?:[\s.\-]?\d{2}){4}\b", 0.88)]
FR_POSTAL = r"\b(\d{5})\s+([A-ZÀ-Ü][a-zà-ÿ\-]+(?:\s+[a-zà-ÿ\-]+){0,3})\b"
FR_STREET = r"\d{1,4}[\s,]+(?:rue|avenue|boulevard|place|allée|impasse|chemin|route|passage|quai|cours)[\s\w\-\',éèêëàâîïôùûü]{3,60}(?:,\s*\d{5}\s*[A-Za-zéèêëàâîïôùûü\s\-]+)?"

MA_CIN = r"\b([A-Z]{1,2}\d{5,6})\b"
MA_CIN_CONTEXT = r"\bCIN\b|\bCNIE\b|carte\s+d'identit[eé]|carte\s+nationale|بطاقة\s+التعريف\s+الوطنية|رقم\s+البطاقة|national\s*id"
MA_PHONES = [(r"(?:\+212|00212)[\s\-]?[5-7]\d{2}[\s\-]?\d{2}[\s\-]?\d{2}[\s\-]?\d{2}", 0.98), (r"\b0[5-7]\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}\b", 0.88)]
MA_ICE = r"\b(\d{15})\b"
MA_ICE_CONTEXT = r"\bICE\b|identifiant\s+commun|identifiant\s+d'entreprise|المعرف\s+المشترك\s+للمقاولة|رقم\s+المقاولة"

#: Sensitivity by entity type; other types weigh OTHER_WEIGHT.
WEIGHTS = {
    "TN_NATIONAL_ID": 0.40, "FR_NIR": 0.40, "MA_CIN": 0.40, "PERSON_NAME": 0.15, "DATE_OF_BIRTH": 0.20, "CREDIT_CARD": 0.35, "IBAN": 0.30,
    "TN_COMPANY_ID": 0.15, "FR_SIRET": 0.15, "MA_ICE": 0.15, "EMAIL": 0.10, "PHONE": 0.10, "TN_PHONE": 0.10, "FR_PHONE": 0.10,
    "MA_PHONE": 0.10, "TN_ADDRESS": 0.15, "FR_ADDRESS": 0.15, "IP_ADDRESS": 0.08,
}
OTHER_WEIGHT = 0.10
#: Types that identify more together, and by how much.
CORRELATED = [
    (["PERSON_NAME", "TN_NATIONAL_ID"], 1.5),
    (["FR_NIR", "PERSON_NAME"], 1.5),
    (["MA_CIN", "PERSON_NAME"], 1.5),
    (["EMAIL", "PERSON_NAME", "PHONE"], 1.3),
    (["DATE_OF_BIRTH", "PERSON_NAME"], 1.4),
    (["CREDIT_CARD", "PERSON_NAME"], 1.4),
]

CONFIDENCE, LOCALE_BOOST, SENSITIVE = 0.7, 0.05, 0.9
LOCALES = ["universal", "tn", "fr", "ma"]


def for_re2(pattern: str, ignore_case: bool = False) -> str:
    """The expression for RE2: Unicode word characters spelt out, no capture groups' meaning changed."""
    out = pattern.replace(r"[\s\w\-\',", r"[\s\p{L}\p{M}\p{Nd}_\-',").replace(r"\'", "'")
    return ("(?i)" if ignore_case else "") + out
