"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Spans are in code points, end exclusive. Every pattern is written so that a search is linear in the
text: digit runs are possessive and start at their first digit, and mail addresses are grown from each
``@`` to both sides instead of being tried at every letter.

Defined cases: a null text is empty and has no spans; each row is judged by itself, so repeated rows
repeat their result; spans never overlap across the added kinds, and a base span always stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone", "credential", "secret")

# Fixed values of the contract: the base patterns, in possessive or anchored form where that matches the same.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|auth[_-]?key|token|secret|password|passwd|pwd)\b[\"']? {0,3}[:=] {0,3}[\"']?([A-Za-z0-9_+/=.!@#$%^*-]{8,})")

# Formats of credentials and national numbers that their issuers publish, by a text that each of them holds.
_CREDENTIALS = [
    ("AKIA", re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("ASIA", re.compile(r"(?<![A-Za-z0-9])ASIA[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("AIza", re.compile(r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9])")),
    *((f"gh{k}_", re.compile(rf"(?<![A-Za-z0-9])gh{k}_[A-Za-z0-9]{{36,}}+")) for k in "oprsu"),
    ("github_pat_", re.compile(r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{22,}+")),
    ("glpat-", re.compile(r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}+")),
    ("xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+")),
    ("_live_", re.compile(r"(?<![A-Za-z0-9])[rs]k_live_[A-Za-z0-9]{16,}+")),
    ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    (
        "PRIVATE KEY-----",
        re.compile(
            r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:\s{1,4}(?:Proc-Type|DEK-Info):[^\n]{0,200}+)*+(?:\s{1,4}[A-Za-z0-9+/=]{16,}+)*+"
            r"(?:\s{0,4}[A-Za-z0-9+/=]{0,15}\s{0,4}-----END [A-Z ]{0,24}PRIVATE KEY-----)?"
        ),
    ),
]
_DIGIT, _TWO_DIGITS = re.compile("[0-9]"), re.compile("[0-9]{2}")
_CPF = re.compile(r"(?<![0-9.-])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9.-])")
_NIR = re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])")
_NINO = re.compile(r"(?<![A-Za-z0-9])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D](?![A-Za-z0-9])")
_DNI = re.compile(r"(?<![A-Za-z0-9])[0-9XYZ][0-9]{7}-?[A-Z](?![A-Za-z0-9])")
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

#: Words that make a kind likelier when they stand within ``NEAR`` characters before a span.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "insurance", "cpf", "dni", "nie", "nino", "national id"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "credential": ("key", "token", "secret", "credential"),
    "secret": ("key", "token", "secret", "password"),
}
NEAR = 48
#: What a pattern alone, a passed checksum and a context word are worth.
PRIOR = {
    "email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6,
    "iban": 0.3, "national_id": 0.4, "local_phone": 0.4, "credential": 0.7, "secret": 0.7,
}
CHECKED, NEARBY, THRESHOLD = 0.4, 0.2, 0.6


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def cpf(number: str) -> bool:
    """Both check digits of eleven digits, the repeated digit apart."""
    d = [int(c) for c in number]
    check = lambda n: sum(x * w for x, w in zip(d, range(n + 1, 1, -1))) * 10 % 11 % 10  # noqa: B905, E731
    return len(set(d)) > 1 and check(9) == d[9] and check(10) == d[10]


def nir(number: str) -> bool:
    """Thirteen digits and 97 less their remainder."""
    return 97 - int(number[:13]) % 97 == int(number[13:])


def dni(number: str) -> bool:
    """Eight digits (the first may be X, Y or Z) and a letter for their remainder."""
    first = str("XYZ".index(number[0])) if number[0] in "XYZ" else number[0]
    return _DNI_LETTERS[int(first + number[1:8]) % 23] == number[-1]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their ``@``: the local part is the whole run of its characters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        end = (m := _DOMAIN.match(text, at + 1)) and m.end()
        if end and start < at:
            yield start, end
            free = end
        # characters looked at once are not looked at again: the next local part begins after this @
        free = max(free, at + 1)
        at = text.find("@", at + 1 if not end or start == at else end)


def _candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, checksum passed)"""
    if "@" in text:
        yield from (("email", s, e, False) for s, e in _emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                yield "ip", m.start(), m.end(), False
        for m in _CARD.finditer(text):
            if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                yield "card", m.start(), m.end(), True
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    yield "phone", m.start(), m.end(), False
    if _TWO_DIGITS.search(text):  # as every number below holds
        for m in _IBAN.finditer(text):
            if 15 <= len(account := m[0].replace(" ", "")) <= 34 and mod97(account):
                yield "iban", m.start(), m.end(), True
        for kind, pattern in (("national_id", _NATIONAL), ("national_id", _NINO), ("local_phone", _LOCAL_PHONE)):
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end(), False
        for pattern, passes in ((_CPF, cpf), (_NIR, nir)):
            for m in pattern.finditer(text):
                if passes(_digits(m[0])):
                    yield "national_id", m.start(), m.end(), True
        for m in _DNI.finditer(text):  # one letter in 23 fits by chance, so a word nearby has to speak for it as well
            if dni(m[0]):
                yield "national_id", m.start(), m.end(), False
    for part, pattern in _CREDENTIALS:
        if part in text:
            for m in pattern.finditer(text):
                yield "credential", m.start(), m.end(), False
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            # a shorter value is a word of prose unless letters and digits are mixed
            if len(m[1]) >= 16 or (re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])):
                yield "secret", m.start(1), m.end(1), False


def _apart(found: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Spans that overlap none of the taken ranges; both are in the order of their starts, and walked once."""
    out = []
    k, reach = 0, 0  # ranges that begin before the span ends, and how far they reach
    for s in found:
        while k < len(taken) and taken[k][0] < s.end:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= s.start:
            out.append(s)
    return out


def find(text: str | None) -> list[Span]:
    """Spans by kind as listed, then by start."""
    if not text:
        return []
    base: list[Span] = []
    added: list[Span] = []
    for kind, start, end, checked in _candidates(text):
        before = text[max(0, start - NEAR) : start].lower()
        near = any(word in before for word in CONTEXT[kind])
        score = round(min(1.0, PRIOR[kind] + CHECKED * checked + NEARBY * near), 2)
        if kind in BASE:
            base.append(Span(kind, start, end, score))
        elif score >= THRESHOLD:
            added.append(Span(kind, start, end, score))
    taken = sorted((s.start, s.end) for s in base)
    for kind in ADDED:
        own: list[Span] = []  # in order and apart from each other, of overlapping ones the first and longest
        for s in sorted((s for s in added if s.kind == kind), key=lambda s: (s.start, -s.end)):
            if not own or s.start >= own[-1].end:
                own.append(s)
        free = _apart(own, taken)
        base += free
        taken = sorted(taken + [(s.start, s.end) for s in free])
    order = {k: n for n, k in enumerate(BASE + ADDED)}
    return sorted(base, key=lambda s: (order[s.kind], s.start))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (joined where they overlap) replaced by its kind in brackets."""
    if not spans:
        return text
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans found in the whole text, with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        )
        for batch in batches:
            found = [[s._asdict() for s in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {_SPAN}")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span masked; ``n_chars``, if there, follows the new text."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t, find(t)) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = StructType(list(docs.schema.fields))
    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def _joined(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            digests, texts, totals = [], [], []
            for t in batch.column(1):
                found = find(t.as_py())
                base = [s for s in found if s.kind in BASE]
                for k in BASE:
                    counts[k].append(sum(s.kind == k for s in base))
                digests.append(sha256(_joined(base).encode()).hexdigest())
                texts.append(_joined(found))
                totals.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(totals, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_spans bigint")
