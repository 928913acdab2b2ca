"""Personal data: regular expressions propose spans, validators confirm them, and
words nearby raise or lower a score.

Base kinds (email, ip, card, phone) keep every span that their validator passes.
The method adds: card-like and account numbers that pass mod-97 (iban), and
national id numbers (ssn) whose score, from nearby context words, is at least
KEEP_SCORE. Spans are code points, the end exclusive, leftmost and not
overlapping within a kind; a match that its validator fails is dropped and the
search goes on behind it.

Null texts count as empty; empty texts have no spans and the digest of an empty
string. Repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import table, text_chunks

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
KEEP_SCORE = 0.6
#: Characters before and after a span in which context words count.
WINDOW = 40
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "pay", "cvv", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = ("order", "invoice", "version", "isbn", "serial", "part")
#: Score of a confirmed span before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.45}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# tried at the first digit of a run only, and never for less than the run: no other start or end can match
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10 over the rotated account number."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As _EMAIL.finditer, tried only where an @ is: a local part is the whole run
    before its @, so no other start can match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Confirmed spans of the four base kinds."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        found["email"] = list(_emails(text))
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """Confidence of a confirmed span, from the words within WINDOW characters."""
    near = set(re.findall(r"[^\W\d_]+", f"{text[max(0, start - WINDOW):start]} {text[end:end + WINDOW]}".lower()))
    s = PRIOR[kind] + 0.2 * any(w in near for w in CONTEXT[kind]) - 0.2 * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, s)), 2)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score), by kind as listed, then start."""
    text = text or ""
    out = [(k, a, b, score(text, k, a, b)) for k, spans in base_spans(text).items() for a, b in spans]
    if _DIGIT.search(text):
        for kind, pattern, valid in (("iban", _IBAN, mod97), ("ssn", _SSN, lambda _: True)):
            for m in pattern.finditer(text):
                if valid(m[0]) and (s := score(text, kind, *m.span())) >= KEEP_SCORE:
                    out.append((kind, *m.span(), s))
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest, spans and scores of each row's personal data."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    spans = find_spans(text)
                    base = [s for s in spans if s[0] in BASE]
                    n = [sum(s[0] == k for s in base) for k in BASE]
                    rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), [s[3] for s in spans]))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.float64())]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
