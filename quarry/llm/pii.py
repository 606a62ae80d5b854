"""Personal data: patterns propose spans, checksums confirm, context scores.

Base kinds: email, ip, card (Luhn) and phone in international form.  Added by
the method: ``iban`` (mod 97), ``ssn`` and ``local_phone``.  Each proposal has
a prior by kind; a checksum that holds lifts it to certainty, one that fails
drops it; context words within ``WINDOW`` code points before or behind raise
it (``call``, ``tel``) or lower it (``order``, ``version``).  Added spans need
``THRESHOLD``; base spans always stay, with their score.

An IBAN proposal takes following upper-case words along, so its end is
settled by its country's length.  Every pattern is linear in the text (runs are entered at their start only).

Defined cases: a null or empty text has no spans; repeated rows each give
their spans; an empty table gives an empty result.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame

from quarry.llm.spans import Span, scan, touches

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
WINDOW = 40
THRESHOLD = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# fixed values: characters of an IBAN by country (ISO 13616 registry)
IBAN_LENGTH = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}.items() for c in codes.split()}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")
_ANY_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")

# fixed values: context words by kind that raise a score, and words that lower any
RAISE = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "host", "address", "server", "login"},
    "card": {"card", "visa", "mastercard", "amex", "payment", "credit", "debit"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "sms", "whatsapp"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "sms", "whatsapp"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
LOWER = {"order", "invoice", "isbn", "version", "part", "serial", "model", "example"}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.6, "phone": 0.7, "local_phone": 0.4, "iban": 0.5, "ssn": 0.4}
CHECKED = 0.35  # gain of a checksum that holds


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: first four to the end, letters as 10 to 35, remainder 1."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(text: str, a: int, b: int) -> int | None:
    """End of the IBAN at the start of a proposal, which may reach into the
    words behind it: at its country's length, or, of an unlisted country, the
    last end between groups for which mod 97 holds."""
    spaces = [i for i in range(a, b) if text[i] == " "]
    n = IBAN_LENGTH.get(text[a:a + 2])
    for end in [b, *reversed(spaces)]:
        if n in (None, end - a - sum(i < end for i in spaces)) and mod97(text[a:end]):
            return end
    return None


def ibans(text: str) -> list[tuple[int, int]]:
    """Non-overlapping IBANs; a proposal is at most some 50 characters."""
    out, pos = [], 0
    while m := _IBAN.search(text, pos):
        end = _iban_end(text, m.start(), m.end())
        if end:
            out.append((m.start(), end))
        pos = end or m.start() + 1
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, read outwards from each @ sign."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done:
            a = at
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            m = _DOMAIN.match(text, at + 1) if a < at else None
            if m:
                out.append((a, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return out


def _small_parts(m: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.split("."))


def _rate(kind: str, text: str, a: int, b: int, checked: bool) -> float:
    near = set(_WORD.findall(text[max(0, a - WINDOW):a].lower())) | set(_WORD.findall(text[b:b + WINDOW].lower()))
    p = PRIOR[kind] + CHECKED * checked + 0.3 * bool(near & RAISE[kind]) - 0.2 * bool(near & LOWER)
    return min(1.0, max(0.0, p))


def personal(text: str) -> list[Span]:
    """All spans of a text, with scores."""
    base: list[tuple[str, int, int, bool]] = []
    added: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        base += [("email", a, b, False) for a, b in emails(text)]
    if _ANY_DIGIT.search(text):
        base += [("ip", m.start(), m.end(), False) for m in _IP.finditer(text) if _small_parts(m.group())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    base.append(("card", m.start(), m.end(), True))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    base.append(("phone", m.start(), m.end(), False))
        added += [("iban", a, b, True) for a, b in ibans(text)]
        added += [("ssn", m.start(), m.end(), False) for m in _SSN.finditer(text)]
        added += [("local_phone", m.start(), m.end(), False) for m in _LOCAL_PHONE.finditer(text)]
    out = [(k, a, b, _rate(k, text, a, b, c)) for k, a, b, c in base]
    meets = touches([(a, b) for _, a, b, _ in base])
    for k, a, b, c in added:
        if not meets(a, b):
            s = _rate(k, text, a, b, c)
            if s >= THRESHOLD:
                out.append((k, a, b, s))
    return out


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, score) for every row."""
    return scan(docs, personal, id_col, text_col)
