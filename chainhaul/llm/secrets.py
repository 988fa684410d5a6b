"""Secret scans with multipart credential linking.

Base spans come from three patterns.  Beside them, parts of credentials are
found that mean little alone: long mixed-class strings (``mixed``), endpoints
(``endpoint``: web addresses and host names with a port) and user names in
assignments (``user``).  Within a scope, ``SCOPE`` characters to either side,
an interval join brings parts together.  A weak part is reported only when a
complementary part, one that shares no character with it, lies in its scope: a
mixed string beside an access identifier, a user name or an endpoint; an
endpoint or user name beside an assignment or a mixed string.

Rows and cases: a null or empty text has no spans.  Repeated rows give repeated
results.  Offsets count code points, ends are exclusive.  The whole text is
read, however long; the join walks sorted spans and holds one document's spans.
Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCOPE = 200
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "mixed", "endpoint", "user")
#: Which kinds make which weak kind credible.
COMPLEMENTS = {"mixed": ("access", "user", "endpoint"), "endpoint": ("assign", "mixed"), "user": ("assign", "mixed")}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_MIXED = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}")
_ADDRESS = re.compile(r"https?://[^\s\"'<>]+", re.A)
#: A host name is what stands before a port: found from the port on, so that no text is read again and again.
_PORT = re.compile(r":([0-9]{2,5})\b", re.A)
_HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+", re.A)
_HOST_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789-.")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_USER = re.compile(r"""(?:user(?:name)?|login|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", re.A | re.I)

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_weak long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    out = []
    if "=" in text or ":" in text:
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def _endpoints(text: str) -> list[tuple[int, int]]:
    """Web addresses, and host names with a port outside of them; no two overlap."""
    out = [m.span() for m in _ADDRESS.finditer(text)]
    hosts, done, k = [], 0, 0
    for m in _PORT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _HOST_CHARACTERS:
            start -= 1
        if (empty := text.rfind("..", start, m.start())) >= 0:
            start = empty + 2
        while start < m.start() and (text[start] == "." or (text[start] in _WORD) == (start > 0 and text[start - 1] in _WORD)):
            start += 1  # to a word's bound
        while k < len(out) and out[k][1] <= start:
            k += 1
        if _HOST.fullmatch(text, start, m.start()) and (k == len(out) or out[k][0] >= m.end()):
            hosts.append((start, m.end()))
            done = m.end()
    return sorted(out + hosts)


def _weak_parts(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in _MIXED.finditer(text):
        s = m.group()
        if any(c.islower() for c in s) and any(c.isupper() for c in s) and any(c.isdigit() for c in s):
            out.append((m.start(), 3, m.end()))
    if ":" in text:
        out += [(start, 4, end) for start, end in _endpoints(text)]
    if "=" in text or ":" in text:
        out += [(m.start(), 5, m.end()) for m in _USER.finditer(text)]
    return out


def linked(base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """Weak parts with a complementary part in their scope that shares no character with them: an interval join over sorted ends.

    Of a kind, the part that ends last before a weak one and the part that begins first after it are the nearest.
    """
    if not weak:
        return []
    begins: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for start, kind, end in [*base, *weak]:
        begins.setdefault(kind, []).append(start)
        ends.setdefault(kind, []).append(end)
    for own in (*begins.values(), *ends.values()):
        own.sort()
    kept = []
    for start, kind, end in weak:
        for other in map(KINDS.index, COMPLEMENTS[KINDS[kind]]):
            if other in begins:
                k, n = bisect_right(ends[other], start), bisect_left(begins[other], end)
                if k and ends[other][k - 1] >= start - scope or n < len(begins[other]) and begins[other][n] <= end + scope:
                    kept.append((start, kind, end))
                    break
    return kept


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_text(text: str | None, scope: int = SCOPE) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, of one text."""
    text = text or ""
    base = base_spans(text)
    weak = linked(base, _weak_parts(text), scope)
    return base, sorted(base + weak)


def _scan(batches: Iterator[pa.RecordBatch], scope: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: list[list[int]] = [[], [], []]
        sha, spans, weak = [], [], []
        for text in batch.column(1):
            base, every = scan_text(text.as_py(), scope)
            for k in range(3):
                n[k].append(sum(x[1] == k for x in base))
            sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
            weak.append(len(every) - len(base))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(weak, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_weak"])


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row a document: counts of base spans, their digest, all spans, weak ones among them."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda it: _scan(it, scope), SCHEMA)


def _redact(batches: Iterator[pa.RecordBatch], scope: int, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(at).to_pylist():
            if text:
                done, pieces = 0, []
                for start, kind, end in scan_text(text, scope)[1]:
                    if end > done:
                        pieces += [text[done : max(start, done)], f"[{KINDS[kind]}]" if start >= done else ""]
                        done = end
                text = "".join([*pieces, text[done:]])
            out.append(text)
        columns = list(batch.columns)
        columns[at] = pa.array(out, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The same rows and columns; each span's characters give way to its kind in brackets."""
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _redact(it, scope, at), docs.schema)
