"""Personal data: patterns propose, validators confirm, nearby words adjust the score (operator 8).

Base kinds (email, ip, card, phone) are decided by their pattern and validator alone and
always stay. The method adds kinds that need more: ``iban`` is confirmed by mod-97 and
``national_id`` (3-2-4 digits, with the ranges never issued left out) only counts with a
context word near it. Each span has a score: the kind's prior, raised by context words
within CONTEXT characters and lowered by words that speak against it.

All patterns are searched in time linear in the text, however long it is: digit runs are
entered at their start only, and an address is found from its "@" outwards.

Cases: a null text is an empty one (no spans); repeated rows are judged each; an empty
table gives an empty result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches, fresh

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id")
KINDS = BASE + ADDED

#: Score of a confirmed span before its context is read, and the least score of an added span.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.9, "national_id": 0.35}
LEAST, RAISE, LOWER, CONTEXT = 0.5, 0.3, 0.4, 48
FOR = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "adresse", "dirección"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "identity", "ausweis", "nif"),
}
AGAINST = ("version", "order", "invoice", "isbn", "sku", "ticket")

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping addresses, each grown leftwards from its "@"."""
    free = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in ADDRESS.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        if 15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code):
            yield m.span()


def national_ids(text: str) -> Iterator[tuple[int, int]]:
    for m in NATIONAL.finditer(text):
        yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": ibans, "national_id": national_ids}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in WORD.findall(text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT])}
    total = PRIOR[kind] + RAISE * bool(near.intersection(FOR[kind])) - LOWER * bool(near.intersection(AGAINST))
    return min(1.0, max(0.0, total))


def find(text: str) -> list[Span]:
    """All spans of a text by kind, then start. Offsets are code points, the end exclusive."""
    out, digits = [], DIGIT.search(text) is not None
    for kind in KINDS:
        if ("@" not in text if kind == "email" else not digits):
            continue
        for start, end in FINDERS[kind](text):
            s = score(text, kind, start, end)
            if kind in BASE or s >= LEAST:
                out.append(Span(kind, start, end, s))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span written as its kind; where spans overlap, one mark stands for all."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at:s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def _spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([[s._asdict() for s in find(t.as_py() or "")] for t in texts], pa.list_(SPAN))


def _summary(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        counts, shas, every = [], [], []
        for text in texts:
            found = find(text.as_py() or "")
            base = [s for s in found if s.kind in BASE]
            counts.append([sum(s.kind == k for s in base) for k in BASE])
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(found))
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
        yield pa.StructArray.from_arrays([*columns, pa.array(shas, pa.string()), pa.array(every, pa.string())],
                                         [*(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def _redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if t is None else redacted(t, find(t)) for t in (x.as_py() for x in texts)], pa.string())


def spans():
    """Column function: text -> array of its spans."""
    return F.arrow_udf("array<struct<kind: string, start: int, end: int, score: double>>")(_spans)


def summary():
    """Column function: text -> counts and digest of the base spans, and all spans written out."""
    counts = ", ".join(f"n_{k}: bigint" for k in BASE)
    return F.arrow_udf(f"struct<{counts}, base_sha256: string, spans: string>")(_summary)


def redact():
    """Column function: text -> text with its spans replaced by their kind; null stays null."""
    return F.arrow_udf("string")(_redact)


def report(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """doc_id, counts, base_sha256 and spans of every row."""
    bounded_batches(docs.sparkSession)
    text = F.col(text) if isinstance(text, str) else text
    found = fresh("pii")
    return docs.select("doc_id", summary()(text.cast("string")).alias(found)).select("doc_id", f"{found}.*")
