"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Every kind's pattern is searched from left to right without overlap and without retries: a proposal that fails its check
is dropped, and the search goes on behind it. Checks are Luhn (cards), mod-97 (IBANs), ranges (IP parts, social
security numbers) and numbers of digits (phones). A proposal's score, in hundredths, starts at its kind's; words of
its kind within NEAR code points add CONTEXT, words that speak against it take as much away. Spans of the BASE kinds
are kept whatever their score, those of the added kinds from LEAST on, so unlikely numbers leave clean documents alone.

The search takes time linear in a text: e-mail addresses are found from their @ back, as a pattern tried at each
letter of a long word would take the square; runs of digits are entered at their start only.

Defined cases: a null text counts as empty; spans are in code points with the end exclusive, and those of different
kinds may overlap; null or repeated keys give a row each; whole texts are searched; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitflow.plans.shared import bound_batches, free_name

#: Kinds in their order; spans of the first four always stay.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Hundredths: where a confirmed proposal starts, what context adds or takes, and what an added kind needs.
START = {"email": 90, "ip": 60, "card": 70, "phone": 60, "iban": 80, "ssn": 40}
CONTEXT, LEAST = 30, 70
#: Code points before and after a span in which context words count.
NEAR = 40

# Context words, and the lengths of IBANs by country.
FOR = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "client", "login"),
    "card": ("card", "credit", "debit", "visa", "mastercard", "amex", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer", "tin"),
}
AGAINST = ("version", "isbn", "issn", "sku", "order", "invoice", "serial", "build", "release", "sample", "dummy")
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

IBAN = "|".join(f"{country}[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}" for country, length in IBAN_LENGTHS.items())
SSN = r"[0-9]+(?:-[0-9]+)+"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run is entered at its start: what fails there fails at each of its digits
_SEARCHED = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": re.compile(IBAN),
    "ssn": re.compile(r"(?<![0-9])[0-9]++(?:-[0-9]++)++"),
}
_NO_DIGIT = re.compile(r"[^0-9]+")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_FOR = {kind: re.compile(rf"\b(?:{'|'.join(words)})\b", re.IGNORECASE | re.ASCII) for kind, words in FOR.items()}
_AGAINST = re.compile(rf"\b(?:{'|'.join(AGAINST)})\b", re.IGNORECASE | re.ASCII)

SPAN = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("text", T.StringType()), ("score", T.IntegerType()), ("base", T.BooleanType()))])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.int32()), ("base", pa.bool_())]))


def luhn(digits: str) -> bool:
    """From the right every second digit counts twice, less nine from ten on; the sum is a multiple of ten."""
    twice = sum(int(d) * 2 - (9 if d > "4" else 0) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35: one more than a multiple of 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _holds(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a proposal passes its kind's check."""
    found = text[start:end]
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))
    if kind == "iban":
        apart = not (start and _ALNUM.match(text, start - 1)) and not _ALNUM.match(text, end)
        return apart and mod97(found.replace(" ", ""))
    if kind == "ssn":
        parts = found.split("-")
        return [len(p) for p in parts] == [3, 2, 4] and parts[0] not in ("000", "666") and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000"
    digits = _NO_DIGIT.sub("", found)
    return 10 <= len(digits) <= 15 if kind == "phone" else 14 <= len(digits) <= 19 and luhn(digits)


def score(kind: str, text: str, start: int, end: int) -> int:
    """Hundredths: the kind's start, adjusted by words nearby."""
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    found = START[kind] + CONTEXT * bool(_FOR[kind].search(near)) - CONTEXT * bool(_AGAINST.search(near))
    return min(100, max(0, found))


def spans_of(text: str) -> list[tuple[str, int, int, str, int, bool]]:
    """(kind, start, end, text, score, base) of a whole text, by start, then kind."""
    found = []
    for order, kind in enumerate(KINDS):
        proposed = _emails(text) if kind == "email" else (m.span() for m in _SEARCHED[kind].finditer(text))
        for start, end in proposed:
            if kind == "email" or _holds(kind, text, start, end):
                points, base = score(kind, text, start, end), kind in BASE
                if base or points >= LEAST:
                    found.append((start, order, (kind, start, end, text[start:end], points, base)))
    return [span for _, _, span in sorted(found)]


@F.arrow_udf(T.ArrayType(SPAN))
def _find(texts: pa.Array) -> pa.Array:
    fields = _ARROW.value_type
    return pa.array([[dict(zip(fields.names, s, strict=True)) for s in spans_of(t.as_py() or "")] for t in texts], _ARROW)


@F.arrow_udf(T.StringType())
def _redact(texts: pa.Array) -> pa.Array:
    return pa.array([None if not t.is_valid else redacted(t.as_py()) for t in texts], pa.string())


def redacted(text: str) -> str:
    """The text with each span as [KIND]; spans that overlap become one, named after the first."""
    parts, done = [], 0
    for kind, start, end, *_ in spans_of(text):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def _possible(text: Column) -> Column:
    """The text where it may hold a span: each kind has a digit or an @. Other texts don't travel to Python."""
    return F.when(text.rlike("[0-9@]"), text)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans, array<struct<kind, start, end, text, score, base>> by start, then kind, for every row of docs."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").alias(key), _find(_possible(F.col(f"`{text}`"))).alias(free_name("spans", [key])))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by its kind in brackets; texts without one, and nulls, stay as they are."""
    bound_batches(docs.sparkSession)
    own = F.col(f"`{text}`")
    return docs.select(*[F.coalesce(_redact(_possible(own)), own).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
