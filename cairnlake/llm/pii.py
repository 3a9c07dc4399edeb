"""Personal data and secrets: patterns propose spans, checks confirm them, nearby words adjust the score.

The four base kinds follow fixed patterns and stay whatever the context says. The further kinds are kept if
their score reaches ``MIN_SCORE``. A score starts from what the check of the kind proves: Luhn for cards, mod-97 and the country's
length for accounts, number ranges for social security numbers, entropy for secrets. Words within ``NEAR`` characters raise or
lower it, the more the nearer they are. Spans of the further kinds overlap neither base spans nor
each other: the higher score wins, then the longer span, then the first.

Every search is linear in the length of a text, whatever it holds.

Defined results: null and empty texts have no spans; repeated rows are searched row by row; very long texts are searched
whole; ties of score and length go to the first span; an empty table gives an empty result; other columns are ignored by ``find``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cairnlake.llm.common import slices

BASE = ("email", "ip", "card", "phone")
SECRETS = ("private_key", "token", "secret")
MORE = ("iban", "card_short", "phone_local", "ssn", *SECRETS)
MIN_SCORE = 0.5
#: Characters on each side of a span in which context words count, and what one beside the span adds or takes.
NEAR, WEIGHT = 48, 0.4
#: What a span scores before its context is read.
PRIOR = {"email": 0.95, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.8, "card_short": 0.35, "phone_local": 0.25, "ssn": 0.3, "private_key": 1.0, "token": 0.95, "secret": 0.7}

# The base patterns.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_KEY_HEAD = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
_KEY_TAIL = re.compile(r"-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
_ASSIGNED = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|auth[_-]?key|credentials?)["']?\x20{0,3}(?:=>|:=|=|:)\x20{0,3}(["']?)([A-Za-z0-9+/_=.~!@#$%^&*-]{8,512})\1""")

# Published forms of access tokens.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,80}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,64}|eyJ[A-Za-z0-9_-]{8,512}\.eyJ[A-Za-z0-9_-]{8,1024}\.[A-Za-z0-9_-]{8,512})(?![A-Za-z0-9_-])")
_TOKEN_SIGNS = ("AKIA", "ASIA", "gh", "xox", "AIza", "sk_live_", "eyJ")

# Length of an international account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_FOR = {
    "email": r"e-?mail|contact|write to|correo|courriel",
    "ip": r"ip|address|host|server|client|login|from|adresse",
    "card": r"card|visa|amex|mastercard|karte|carte|tarjeta|cvv|credit|expir\w+",
    "phone": r"phone|tel|telephone|mobile|call|fax|telefon|téléphone|teléfono|whatsapp",
    "iban": r"iban|bic|swift|account|konto|compte|cuenta|bank|transfer",
    "card_short": r"card|visa|amex|mastercard|diners|karte|carte|tarjeta|cvv|credit|expir\w+",
    "phone_local": r"phone|tel|telephone|mobile|call|fax|telefon|téléphone|teléfono|whatsapp",
    "ssn": r"ssn|social security|national id|tax id|taxpayer",
    "secret": r"key|login|credential\w*|auth\w*|bearer|private|prod\w*",
}
_FOR["token"] = _FOR["private_key"] = _FOR["secret"]
_AGAINST = r"version|release|build|isbn|issn|doi|part|serial|order|invoice|ticket|room|chapter|section|page|example|sample|dummy|fake|placeholder|commit|sha1?|checksum|digest|hash|changeme"
_WORDS = {kind: (re.compile(rf"(?i)\b(?:{said})\b"), re.compile(rf"(?i)\b(?:{_AGAINST})\b")) for kind, said in _FOR.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an account number without spaces."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def entropy(s: str) -> float:
    """Bits for each character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ so that prose without any costs nothing."""
    done, at = 0, text.find("@")
    since = 0
    while at >= 0:
        low = max(done, since)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        since = at + 1
        at = text.find("@", max(since, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers with dots between, leftmost and not overlapping, no part above 255.

    Chains of numbers are read whole and cut into fours, which is where a search from left to right stops.
    """
    if "." not in text:
        return
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def _digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "") if s.isascii() else s


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four base kinds, by kind as listed, then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", a, b) for a, b in _addresses(text)]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised by the nearest word that speaks for it and lowered by the nearest that speaks against it."""
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    total = PRIOR[kind]
    for words, sign in zip(_WORDS[kind], (1, -1), strict=True):
        gaps = [len(before) - m.end() for m in words.finditer(before)] + [m.start() for m in words.finditer(after)]
        if gaps:
            total += sign * WEIGHT * (1 - min(gaps) / (2 * NEAR))
    return round(min(1.0, max(0.0, total)), 3)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the further kinds that their own check does not refute."""
    if _DIGIT.search(text):
        for m in _IBAN.finditer(text):
            s = m[0].replace(" ", "")
            if IBAN_LENGTH.get(s[:2]) == len(s) and mod97(s):
                yield "iban", *m.span()
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 29 and 13 <= len(d := _digits(m[0])) <= 15 and luhn(d):
                yield "card_short", *m.span()
        for m in _LOCAL_PHONE.finditer(text):
            yield "phone_local", *m.span()
        if "-" in text:
            for m in _SSN.finditer(text):
                if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                    yield "ssn", *m.span()
    if "PRIVATE KEY" in text:
        heads = list(_KEY_HEAD.finditer(text))
        for m, following in zip(heads, [*(x.start() for x in heads[1:]), len(text)], strict=True):
            tail = _KEY_TAIL.search(text, m.end(), following)
            yield "private_key", m.start(), tail.end() if tail else m.end()
    if any(x in text for x in _TOKEN_SIGNS):
        for m in _TOKEN.finditer(text):
            yield "token", *m.span()
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            value = m[2]
            quoted = bool(m[1])
            if entropy(value) >= (2.5 if quoted else 3.0) and (quoted or _DIGIT.search(value)):
                yield "secret", *m.span(2)


def more_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Spans of the further kinds that reach MIN_SCORE and overlap no other span, by kind, then start."""
    scored = [(s, kind, a, b) for kind, a, b in _proposed(text) if (s := score(text, kind, a, b)) >= MIN_SCORE]
    if not scored:
        return []
    taken = [(a, b) for _, a, b in base]
    out = []
    for s, kind, a, b in sorted(scored, key=lambda x: (-x[0], x[2] - x[3], x[2], MORE.index(x[1]))):
        out.append((kind, a, b, s))
    return sorted(_apart(out, taken), key=lambda x: (MORE.index(x[0]), x[1]))


def _apart(spans: list[tuple[str, int, int, float]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
    """In the given order, the spans that overlap neither ``taken`` nor an earlier one."""
    ends = sorted({x for a, b in taken for x in (a, b)} | {x for _, a, b, _ in spans for x in (a, b)})
    place = {x: k for k, x in enumerate(ends)}
    busy = bytearray(len(ends))
    for a, b in taken:
        busy[place[a] : place[b]] = b"\1" * (place[b] - place[a])
    out = []
    for x in spans:
        a, b = place[x[1]], place[x[2]]
        if not any(busy[a:b]):
            busy[a:b] = b"\1" * (b - a)
            out.append(x)
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_more", pa.int64()), ("n_secret", pa.int64()), ("n_found", pa.int64()), ("found", pa.list_(_SPAN))])
_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long, n_secret long, n_found long, found array<struct<kind: string, start: int, end: int, score: double>>"


def find(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, their digest, all spans as text and as structs with scores.

    ``n_more`` counts the spans of the further kinds, ``n_secret`` those of them that are secrets, ``n_found`` all spans. Offsets are code points, the end exclusive.
    """

    def one(text: str | None) -> tuple:
        text = text or ""
        base = base_spans(text)
        more = more_spans(text, base)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        every = ",".join(filter(None, [said, ",".join(f"{k}:{a}:{b}" for k, a, b, _ in more)]))
        counts = [sum(x[0] == k for x in base) for k in BASE]
        totals = len(more), sum(x[0] in SECRETS for x in more), len(base) + len(more)
        return *counts, hashlib.sha256(said.encode()).hexdigest(), every, *totals, [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in [(k, a, b, score(text, k, a, b)) for k, a, b in base] + more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [one(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array([r[k] for r in rows], _OUT.field(k + 1).type) for k in range(10))], schema=_OUT)

    return docs.select("doc_id", "text").mapInArrow(run, _DDL)
