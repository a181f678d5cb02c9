"""Personal data: patterns propose, checksums confirm, context words adjust the score (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptloom.llm.store import id_text, strings

# Kinds in the order in which spans are listed; the base ones first.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
# Characters of an email's local part; patterns of the other kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
# Words that raise the score of a kind when they stand close before it.
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|telefon|call|fax|mobile|handy|portable)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
}
# Score of a confirmed proposal by itself, what context adds, and what is needed to be reported.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national": 0.4}
CONTEXT_GAIN, CONTEXT_CHARS, REPORTED = 0.2, 40, 0.5


def luhn(digits: str) -> bool:
    """Luhn's check over decimal digits."""
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def mod97(code: str) -> bool:
    """The account number check: country and check digits last, letters as numbers, remainder 1."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that long runs stay linear."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1  # no local part holds an @
        at = text.find("@", low)


def _digits(text: str) -> str:
    return "".join([c for c in text if c in "0123456789"])


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()


def find_spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text: kind, start, end (code points, end exclusive), score, base."""

    def score(kind: str, start: int, prior: str) -> float:
        near = CONTEXT[kind].search(text, max(0, start - CONTEXT_CHARS), start)
        return round(min(1.0, PRIOR[prior] + (CONTEXT_GAIN if near else 0)), 3)

    base = [(k, s, e, score(k, s, k), True) for k, s, e in base_spans(text)]
    added = []
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            added.append(("iban", *m.span(), score("iban", m.start(), "iban"), False))
    for m in NATIONAL.finditer(text):
        added.append(("phone", *m.span(), score("phone", m.start(), "national"), False))
    free = [a for a in added if a[3] > REPORTED and not any(a[1] < b[2] and b[1] < a[2] for b in base)]
    return sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1]))


def pii_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every whole text with its spans: id, spans array<struct<kind, start, end, score, base>>.

    One narrow pass. NULL and empty texts have no spans; repeated rows stay repeated.
    """
    source = id_text(documents, id_column, text_column)
    kind = source.schema["id"].dataType.simpleString()
    item = pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]
    )
    names = [f.name for f in item]

    def scan(batches):
        for batch in batches:
            spans = [[dict(zip(names, s, strict=True)) for s in find_spans(t)] for t in strings(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(item))], ["id", "spans"])

    return source.mapInArrow(
        scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"
    )


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for kind, start, end, _, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(documents: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data replaced; NULL texts stay NULL."""
    schema = documents.schema

    def scan(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if length_column in batch.schema.names:
                at = batch.schema.get_field_index(length_column)
                sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                batch = batch.set_column(at, batch.schema.field(at), sizes.cast(batch.schema.field(at).type))
            yield batch

    return documents.mapInArrow(scan, schema)
