"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words move their score.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping per kind, and always stay.  The
method adds spans that the patterns miss: card numbers and phone numbers inside longer chains of digits, phone numbers
without a country code, spelt-out email addresses, IBANs (mod 97), French and Spanish identity numbers (mod 97, mod 23)
and US social security numbers.  An added span needs its checksum, a score of ``MIN_SCORE`` and a place that no other span
takes; spans with a higher score choose first.

The score starts at a value per proposal and rises or falls by ``CONTEXT_STEP`` for a word of the kind, or a word that
speaks against it (an order number, a version), among the words around the span.

Defined results: a null or empty text has no spans; positions count code points, ends are exclusive; base spans of
different kinds may overlap; equal scores choose by start, then by the longer span, then by kind; repeated rows are judged
one by one; a text of any length is read in linear time; columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.text_blocks import appended, fresh, row_slices, with_fields

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "nir", "dni", "ssn")
MIN_SCORE = 0.5
CONTEXT_STEP = 0.3
BEFORE, AFTER = 48, 24  # code points around a span that are read for context
# Start values: by kind for base spans, by proposal for the others.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.8}
WHOLE_GROUP, SPLIT_GROUPS, CUT_PHONE, LOCAL_PHONE, SPELT_EMAIL, CHECKED, UNCHECKED = 0.6, 0.3, 0.6, 0.3, 0.6, 0.7, 0.3
# Words around a span, in English, German, French and Spanish.
FOR = {
    "email": {"mail", "email", "contact", "kontakt", "correo", "courriel", "write"},
    "ip": {"ip", "host", "server", "address", "adresse", "login", "client"},
    "card": {"card", "credit", "visa", "mastercard", "amex", "karte", "kreditkarte", "carte", "tarjeta", "paid"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "handy", "téléphone", "teléfono", "móvil"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "nir": {"nir", "sécurité", "sociale", "insee"},
    "dni": {"dni", "nif", "documento", "identidad"},
    "ssn": {"ssn", "social", "security", "insurance", "taxpayer"},
}
AGAINST = {"order", "isbn", "serial", "version", "invoice", "ticket", "bestellung", "rechnung", "commande", "facture",
           "pedido", "factura"}
# Length of an IBAN by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22,
                "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
ISSUERS = ("3", "4", "5", "6", "2")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]++")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?0?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,5}(?![0-9]|[.-][0-9])")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,5}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(
    rf"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()
) + r")(?![A-Za-z0-9])")
_NIR = re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?[0-9]{2} ?[0-9][0-9AB] ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])")
_DNI = re.compile(r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORDS = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType()),
])


def digits(text: str) -> str:
    return "".join(_GROUP.findall(text))


def luhn(number: str) -> bool:
    """The Luhn checksum: every second digit from the right counts double, by its digits."""
    total = sum(map(int, number[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])
    return total % 10 == 0


def is_card(number: str) -> bool:
    return 13 <= len(number) <= 19 and luhn(number)


def is_iban(number: str) -> bool:
    """The first four characters go to the end, letters count from 10, and the rest modulo 97 is 1."""
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def is_nir(number: str) -> bool:
    """13 digits and a key of 97 minus their rest; the Corsican departments 2A and 2B count as 19 and 18."""
    body = number[:-2].replace("2A", "19").replace("2B", "18")
    return body.isdigit() and 97 - int(body) % 97 == int(number[-2:])


def is_dni(number: str) -> bool:
    return DNI_LETTERS[int(number[:8]) % 23] == number[-1]


def is_ssn(number: str) -> bool:
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards.

    All starts before one @ meet the same domain, so the leftmost start is the begin of the run, or the end of the
    address before it.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _CHAIN.finditer(text) if is_card(digits(m.group())))


def phones(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15)


BASE_FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def _chained_cards(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Cards among the groups of a chain that is no card as a whole; several groups need an issuer's first digit, and context."""
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() <= 13 or is_card(digits(chain.group())):
            continue
        groups = [(m.start(), m.group()) for m in _GROUP.finditer(text, *chain.span())]
        for i, (start, first) in enumerate(groups):
            number = ""
            for j in range(i, min(i + 19, len(groups))):
                number += groups[j][1]
                if len(number) > 19:
                    break
                if is_card(number) and (j == i or first[0] in ISSUERS):
                    yield "card", start, groups[j][0] + len(groups[j][1]), WHOLE_GROUP if j == i else SPLIT_GROUPS


def _cut_phones(text: str) -> Iterator[tuple[str, int, int, float]]:
    """International numbers that run on into other digits: the groups that fit into 15 digits."""
    for m in _PHONE.finditer(text):
        total, end = 0, 0
        for group in _GROUP.finditer(text, *m.span()):
            if total + len(group.group()) > 15:
                break
            total, end = total + len(group.group()), group.end()
        if total >= 9 and end < m.end():
            yield "phone", m.start(), end, CUT_PHONE


def _matches(kind: str, pattern: re.Pattern, text: str, score: float, check: Callable[[str], bool], drop: str = " ") -> Iterator[tuple[str, int, int, float]]:
    for m in pattern.finditer(text):
        if check(m.group().replace(drop, "")):
            yield kind, *m.span(), score


def proposals(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, start score) of confirmed spans beyond the base."""
    if "at)" in text or "at]" in text:
        yield from _matches("email", _SPELT, text, SPELT_EMAIL, bool)
    if not _DIGIT.search(text):
        return
    yield from _chained_cards(text)
    if "+" in text:
        yield from _cut_phones(text)
    yield from _matches("phone", _LOCAL_PHONE, text, LOCAL_PHONE, lambda x: 9 <= len(digits(x)) <= 15)
    yield from _matches("iban", _IBAN, text, CHECKED, is_iban)
    yield from _matches("nir", _NIR, text, CHECKED, is_nir)
    yield from _matches("dni", _DNI, text, CHECKED, is_dni, "-")
    yield from _matches("ssn", _SSN, text, UNCHECKED, is_ssn)


def in_context(text: str, kind: str, start: int, end: int, score: float) -> float:
    around = set(_WORDS.findall(f"{text[max(0, start - BEFORE) : start]} {text[end : end + AFTER]}".lower()))
    moved = score + CONTEXT_STEP * bool(around & FOR[kind]) - CONTEXT_STEP * bool(around & AGAINST)
    return round(min(1.0, max(0.0, moved)), 2)


def find(text: str | None, min_score: float = MIN_SCORE) -> list[Span]:
    """All spans of a text, by kind as in ``KINDS``, then by start."""
    if not text:
        return []
    spans = [
        Span(kind, a, b, in_context(text, kind, a, b, BASE_SCORE[kind]), True)
        for kind, found in BASE_FINDERS.items() for a, b in found(text)
    ]
    added = [Span(kind, a, b, in_context(text, kind, a, b, s), False) for kind, a, b, s in proposals(text)]
    added = sorted({s for s in added if s.score >= min_score}, key=lambda s: (-s.score, s.start, -s.end, KINDS.index(s.kind)))
    taken = bytearray(len(text))
    for s in spans:
        taken[s.start : s.end] = b"\1" * (s.end - s.start)
    for s in added:
        if 1 not in taken[s.start : s.end]:
            taken[s.start : s.end] = b"\1" * (s.end - s.start)
            spans.append(s)
    return sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def with_spans(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> tuple[DataFrame, str]:
    """``docs`` plus an array of (kind, start, end, score, base); the name of that column comes second."""
    name = fresh(docs, "pii_spans")
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, text):
                found = [[s._asdict() for s in find(t, min_score)] for t in rows.column(text).to_pylist()]
                yield appended(rows, {name: pa.array(found, pa.list_(span))})

    return docs.mapInArrow(run, with_fields(docs, T.StructField(name, T.ArrayType(SPAN)))), name


def count(spans: str, kind: str) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def listed(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE, mark: str = "[{}]") -> DataFrame:
    """``docs`` with the name of the kind in place of each span; overlapping spans become one mark of the first kind."""
    columns = docs.columns
    found, name = with_spans(docs, text, min_score)

    def covered(t: str | None, spans: list[dict]) -> str | None:
        if not spans:
            return t
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                out += [t[at : s["start"]], mark.format(s["kind"].upper())]
            at = max(at, s["end"])
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, text):
                pairs = zip(rows.column(text).to_pylist(), rows.column(name).to_pylist(), strict=True)
                new = pa.array([covered(t, s) for t, s in pairs], rows.schema.field(text).type)
                yield pa.RecordBatch.from_arrays([new if c == text else rows.column(c) for c in columns], names=columns)

    return found.mapInArrow(run, docs.schema)
