"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors, ASCII letters of either case alike: at-signs, plus signs, digits, URL schemes and cues such as
"token". From each anchor a small deterministic parser expands to the borders of the span and validates it; digits anchor network
addresses and card numbers. A parser never starts where the one before of its kind has read, so a text is read a bounded number of
times whatever it holds. Everything happens in one pass where a text is read, without a shuffle.

Spans are (kind, start, end) in code points. Base kinds: email, ip, card, phone, each leftmost and non-overlapping within its kind.
The method adds: url, secret (the value after a credential cue) and iban (with its check digits).

Defined results: a null text is an empty one and has no spans; texts of any length are read whole; spans of different kinds may overlap; null and repeated ids give a row each; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

Span = tuple[str, int, int]
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
_SECRET = re.compile(r"""[\x20"']{0,2}[:=][\x20]?["']?([A-Za-z0-9+/_.-]{16,})""")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}")
#: What announces a value to hide.
CUES = ("api_key", "apikey", "api-key", "secret", "token", "password", "passwd", "access_key")
SCHEMES = ("http://", "https://", "ftp://")
_FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


@lru_cache(1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), *[(d, "digit") for d in "0123456789"], *[(s, "scheme") for s in SCHEMES], *[(c, "cue") for c in CUES], ("iban", "iban")]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) if d < "5" else 2 * int(d) - 9) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _email(text: str, at: int, after: int) -> Span | None:
    """Left over the characters of a local part, but not into the email before; right over a name with a dot."""
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1)
    return ("email", start, domain.end()) if start < at and domain else None


def _iban(text: str, at: int) -> Span | None:
    """The longest run after the cue whose check digits hold."""
    m = _IBAN.search(text, at, at + 48)
    if not m or text[at : m.start()].strip(" :=#"):
        return None
    for end in range(m.end(), m.start() + 14, -1):
        code = text[m.start() : end].replace(" ", "")
        if text[end - 1] != " " and 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return "iban", m.start(), end
    return None


def find_spans(text: str) -> list[Span]:
    """All spans, by kind as listed in ``KINDS`` and then by start."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    end = dict.fromkeys(KINDS, 0)

    def take(span: Span | None) -> None:
        if span and span[1] >= end[span[0]]:
            out[span[0]].append(span)
            end[span[0]] = span[2]

    for last, (kind, size) in _anchors().iter(text.translate(_FOLD)):
        start = last - size + 1
        if kind == "digit":
            # a match that fails its check still uses its characters up
            if start >= end["ip"]:
                m = _IP.match(text, start)
                end["ip"] = (m or _RUN.match(text, start)).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out["ip"].append(("ip", start, m.end()))
            if start >= end["card"]:
                m = _CARD.match(text, start)
                end["card"] = m.end() if m else start + 1
                digits = m[0].replace(" ", "").replace("-", "") if m else ""
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(("card", start, m.end()))
        elif kind == "at":
            take(_email(text, start, end["email"]))
        elif kind == "plus":
            if start >= end["phone"] and (m := _PHONE.match(text, start)):
                end["phone"] = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    out["phone"].append(("phone", start, m.end()))
        elif kind == "scheme":
            if start >= end["url"] and (m := _URL.match(text, last + 1)):
                take(("url", start, last + 1 + len(m[0].rstrip(".,;:!?)'"))))
        elif kind == "cue":
            if start >= end["secret"] and (m := _SECRET.match(text, last + 1)):
                take(("secret", m.start(1), m.end(1)))
        else:
            take(_iban(text, last + 1))
    return [s for k in KINDS for s in out[k]]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Put ``<KIND>`` for each span; where spans overlap, their union is replaced under the first one's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row a document with counts by base kind and the digest of its spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            found = [find_spans(t or "") for t in batch.column(1).to_pylist()]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS]
            digests = [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests), pa.array([written(s) for s in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced. A null text stays null."""
    at = docs.columns.index("text")

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else redact(t, find_spans(t)) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(hide, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(common.table(spark, sf_dir, "documents"))
