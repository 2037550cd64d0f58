"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Each pattern is written so that a text of any length takes time in proportion: runs of one class are taken whole,
since no shorter piece of a run could match where the whole does not. A span's score is a number of points:
those of its kind, more for a right checksum, more or fewer for words that stand in the code points before it.
Spans of the base kinds are always kept; others from ``KEEP`` points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.llm.texts import chunks

# Kinds in the order of the output, and the words that speak for or against a kind.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
SPEAKS_FOR = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|karte|carte|tarjeta|visa|credit",
    "phone": r"phone|\btel\b|call|mobile|telefon|appel|llam",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security",
}
SPEAKS_AGAINST = r"version|release|isbn|order|invoice|build|\bid\b"
POINTS = {"email": 80, "ip": 60, "card": 50, "phone": 60, "iban": 30, "ssn": 30}
CHECKED, FOR, AGAINST, KEEP = 30, 20, 30, 50
NEARBY = 40                       # code points before a span in which words count

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", re.ASCII)
_SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII)
_FOR = {k: re.compile(v, re.ASCII) for k, v in SPEAKS_FOR.items()}
_AGAINST = re.compile(SPEAKS_AGAINST, re.ASCII)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the account number, its first four characters put last and letters as 10 to 35, leaves 1 over 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            floor = m.end()
            yield start, floor


def _proposed(text: str) -> Iterator[tuple[str, int, int, bool, bool]]:
    """(kind, start, end, base, checked) of all spans that a pattern proposes and no check refutes."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end, True, False
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or "0") < 256 for p in (q.lstrip("0") for q in m[0].split("."))):
            yield "ip", m.start(), m.end(), True, False
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19:
            if luhn(digits):
                yield "card", m.start(), m.end(), True, True
        elif len(digits) > 19:                 # numbers that stand side by side: each for itself
            at = m.start()
            for part in re.split("[ -]", m[0]):
                if 13 <= len(part) <= 19 and part[0] in "3456" and luhn(part):
                    yield "card", at, at + len(part), False, True
                at += len(part) + 1
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", m.start(), m.end(), True, False
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end(), False, True
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end(), False, False


def find_spans(text: str) -> list[tuple[str, int, int, int, bool]]:
    """(kind, start, end, score, base) by start, then kind; start and end in code points, end exclusive."""
    found = []
    for kind, start, end, base, checked in _proposed(text):
        before = text[max(0, start - NEARBY):start].translate(_LOWER)
        score = POINTS[kind] + CHECKED * checked + FOR * bool(_FOR[kind].search(before)) - AGAINST * bool(_AGAINST.search(before))
        if base or score >= KEEP:
            found.append((kind, start, end, min(100, max(0, score)), base))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind:string,start:int,end:int,score:int,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.int32()), ("base", pa.bool_())]))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans of each row of (doc_id, text): kind, start, end, score (0 to 100) and base, in order of start.

    Kinds email, ip, card (12 to 19 digits that pass Luhn) and phone are the base ones; ``card`` beside other numbers, ``iban``
    (mod 97) and ``ssn`` are kept from ``KEEP`` points. A null or empty text has no spans. Repeated rows and null ids
    give a row each. Spans of one kind do not overlap, spans of different kinds may. Other columns are left out.
    """
    def run(batches):
        for batch in batches:
            col = batch.column(1)
            for part in chunks(col):
                spans = [find_spans(t) if t else [] for t in col.slice(part.lo, part.hi - part.lo).to_pylist()]
                rows = [[dict(zip(("kind", "start", "end", "score", "base"), s)) for s in found] for found in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.hi - part.lo), pa.array(rows, _ARROW)],
                                                 ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the hash of the base spans, and all spans as text."""
    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [number(k) for k in KINDS[:4]]
    return personal_data(docs).select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
                                      shown(F.col("spans")).alias("spans"))
