"""Token counts by section, attributed by character offsets.

A document is encoded once, whole; each token's character span comes from the
lengths of the tokens.  Sections (lines; a line feed belongs to the line it
ends) are spans too, and both meet in an interval join over sorted bounds.  A
token that crosses a boundary goes by an explicit rule: ``start`` (the section
of its first character), ``most`` (the section that holds most of its bytes,
the first if equal) or ``share`` (to each section its share of the bytes).

Rows and cases: a null or empty text has no tokens and no sections.  A token of
part of a character counts where the character begins.  Repeated rows give
repeated results.  Special tokens in a text are ordinary text.  Extra columns
are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import buffers

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("start", "most", "share")
SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>"


@cache
def encoder(folder: str, vocabulary: str):
    """(encoding, bytes of each token), loaded once a process."""
    import public_tokenizers
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, k in ranks.items():
        sizes[k] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens by section, and how many cross a boundary; ends: of tokens, bounds: ends of sections, in bytes."""
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends, "left")
    crossing = np.flatnonzero(last > first)
    out = np.bincount(first, minlength=len(bounds)).astype(np.float64)
    if rule != "start":
        for t in crossing.tolist():
            own = np.arange(first[t], last[t] + 1)
            low = np.concatenate([[0], bounds])[own]
            share = (np.minimum(bounds[own], ends[t]) - np.maximum(low, starts[t])) / (ends[t] - starts[t])
            out[first[t]] -= 1
            if rule == "share":
                out[own] += share
            else:
                out[own[share.argmax()]] += 1
    return out, len(crossing)


def _count(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, rule: str) -> Iterator[pa.RecordBatch]:
    encoding, sizes = encoder(folder, vocabulary)
    for batch in batches:
        data, offs = buffers(batch.column(1))
        n, sections, crossing, by = [], [], [], []
        for row in range(len(batch)):
            raw = data[offs[row] : offs[row + 1]]
            ids = np.array(encoding.encode_ordinary(raw.tobytes().decode()), dtype=np.int64)
            bounds = np.flatnonzero(raw == 10) + 1
            if len(raw) and (not len(bounds) or bounds[-1] < len(raw)):
                bounds = np.append(bounds, len(raw))
            own, over = attribute(np.cumsum(sizes[ids]), bounds, rule) if len(raw) else (np.zeros(0), 0)
            n.append(len(ids))
            sections.append(len(bounds) if len(raw) else 0)
            crossing.append(over)
            by.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, sections, crossing)), pa.array(by, pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])


def count(docs: DataFrame, rule: str = "start", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a document: its tokens, in all and by section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda it: _count(it, folder, vocabulary, rule), SCHEMA)
