"""Texts, requests and logs derived from the given tables by SQL that Spark and other engines share."""

from __future__ import annotations

_K = "c_custkey"


def _pad(value: str, n: int) -> str:
    return f"lpad(cast({value} as string), {n}, '0')"


_NIR = f"concat('185', {_pad(f'1 + {_K} % 12', 2)}, '78006', {_pad(f'{_K} % 1000', 3)})"

#: Identifiers of a customer, of all kinds that the recognizers know.
ITEMS = [
    f"concat('CIN ', {_pad(f'({_K} * 7919) % 100000000', 8)})",
    f"concat('tel +216 98 ', {_pad(f'({_K} * 31) % 1000', 3)}, ' ', {_pad(f'({_K} * 17) % 1000', 3)})",
    f"concat('MF ', {_pad(f'({_K} * 104729) % 10000000', 7)}, 'A/P/000')",
    f"concat('Avenue Habib Bourguiba ', cast({_K} % 200 as string), ', ', cast(1000 + {_K} % 9000 as string), ' Tunis')",
    f"concat('NIR ', {_NIR}, {_pad(f'97 - cast({_NIR} as bigint) % 97', 2)})",
    f"concat('SIRET 732 829 320 000', {_pad(f'{_K} % 100', 2)})",
    f"concat('mobile +33 6 12 34 ', {_pad(f'{_K} % 100', 2)}, ' 78')",
    f"concat('lives at ', cast({_K} % 90 as string), ' rue de la Paix, 75002 Paris')",
    f"concat('carte nationale AB', {_pad(f'({_K} * 13) % 1000000', 6)})",
    f"concat('call 06', {_pad(f'({_K} * 97) % 100000000', 8)})",
    f"concat('ICE ', {_pad(f'{_K} * 1000003', 15)})",
    f"concat('mail user', cast({_K} % 400 as string), '@example.com')",
    f"concat('iban FR76123459876501234567890', {_pad(f'{_K} % 100', 2)})",
    f"concat('card 4111 1111 1111 ', {_pad(f'1100 + {_K} % 40', 4)})",
    f"concat('from 10.', cast({_K} % 256 as string), '.3.4')",
    "'signed Dr Jean Dupont'",
    f"concat('Date of birth: ', {_pad(f'1 + {_K} % 28', 2)}, '/03/1990')",
    f"concat('phone (555) 123-', {_pad(f'{_K} % 10000', 4)})",
]


def _item(shift: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(ITEMS))
    return f"CASE ({_K} + {shift}) % {len(ITEMS)} {cases} END"


#: id, session_id, text: a note of three identifiers for each customer.
NOTES = f"SELECT {_K} AS id, concat('s', cast({_K} % 50 as string)) AS session_id, concat('Note: ', {_item(0)}, ' ; ', {_item(5)}, ' ; ', {_item(11)}) AS text FROM customer"
DOCUMENTS = "SELECT doc_id AS id, source AS session_id, text FROM documents"
#: Audit events: what each user event stands for.
AUDIT = """SELECT event_id, epoch_s AS ts,
  CASE event_id % 4 WHEN 0 THEN 'TEXT_MASKED' WHEN 1 THEN 'TEXT_RESTORED' WHEN 2 THEN 'SESSION_ENDED' ELSE 'REQUEST_MASKED' END AS event,
  concat('u', cast(user_id as string)) AS session_id, event_id % 5 AS entity_count, event_id % 3 AS tokens_restored, value AS duration,
  CASE WHEN event_id % 11 = 0 THEN 'error' ELSE 'success' END AS status"""
