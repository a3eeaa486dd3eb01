"""Operator 4: personal data by pattern, validator and context.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for account
numbers, ranges and digit counts for addresses, phones and social security numbers), and words near a span raise or lower its
score. Each text is read once, whole, on the worker that has it; nothing is shuffled. The scans are
linear in the text: patterns start where a run starts, and e-mail addresses are sought from the @.

Defined cases: null or empty text has no spans; a null doc_id is kept; repeated rows give repeated
results; an empty table gives an empty result; other columns pass through redact() as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import table, text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")

# Score of a confirmed span, and words that speak for or against each kind.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.2}
FOR = {
    "email": {"mail", "email", "contact", "kontakt", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "adresse", "client", "login"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte", "payment"},
    "phone": {"phone", "tel", "call", "telefon", "mobile", "fax", "teléfono", "téléphone"},
    "iban": {"iban", "account", "konto", "bank", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security"},
}
AGAINST = {"ip": {"version", "release", "section"}, "card": {"isbn", "order", "tracking"}, "phone": {"version"}, "ssn": {"part", "order"}}
NEAR = 48  # characters on either side
GAIN, LOSS = 0.3, 0.2
#: Spans of at least this score are replaced by redact(); every confirmed base span has it.
REDACT_FROM = 0.4


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(number: str) -> bool:
    turned = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def assignable(number: str) -> bool:
    """Whether a social security number AAA-GG-SSSS lies outside the ranges that are never given out."""
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(last, at + 1))


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, kind by kind."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not re.search("[0-9]", text):
        return
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        if assignable(m[0]):
            yield "ssn", *m.span()


def find(text: str) -> list[Span]:
    """Spans by kind, then start; code points, end exclusive."""
    out = []
    for kind, a, b in _proposed(text):
        near = set(_WORD.findall(f"{text[max(0, a - NEAR):a]} {text[b:b + NEAR]}".lower()))
        score = SCORE[kind] + GAIN * bool(near & FOR[kind]) - LOSS * bool(near & AGAINST.get(kind, set()))
        out.append(Span(kind, a, b, round(min(1.0, score), 2)))
    return out


def replaced(text: str, spans: list[Span], least: float = REDACT_FROM) -> str:
    """text with [KIND] for each span of that score; of overlapping spans the first names the whole stretch."""
    parts, last = [], 0
    for s in sorted((s for s in spans if s.score >= least), key=lambda s: (s.start, -s.end)):
        if s.start >= last:
            parts += [text[last:s.start], f"[{s.kind.upper()}]"]
        last = max(last, s.end)
    return "".join([*parts, text[last:]])


_ROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[s._asdict() for s in find(t.as_py())] for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, _ROW.field("spans").type)], schema=_ROW)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_find, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def _redact(batches: Iterable[pa.RecordBatch], with_length: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t and replaced(t, find(t)) for t in (x.as_py() for x in b.column("text"))]
        b = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, b.schema.field("text").type))
        if with_length:
            k = b.schema.get_field_index("n_chars")
            n = pa.array([None if t is None else len(t) for t in texts], b.schema.field(k).type)
            b = b.set_column(k, b.schema.field(k), n)
        yield b


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of their texts replaced and n_chars, if there, counted anew; a null text stays null."""
    with_length = "n_chars" in docs.columns
    return docs.mapInArrow(lambda it: _redact(it, with_length), docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return spans.select(
        "doc_id", *map(n, KINDS), F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda x: x["score"])).alias("max_score"),
    )
