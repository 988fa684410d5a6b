"""Removal of repeated passages by seeds and extension.

Seeds: every run of ``LENGTH`` words holds a winnowed anchor, the ``SEED``-word
gram with the least hash among its ``LENGTH - SEED + 1`` grams (every one that
ties).  Equal runs hold equal anchors, so a run can only repeat if one of its
anchors occurs twice.  Documents are joined on anchors through their counts: a
bitmap of the anchors that repeat goes to all texts; what it lets through by
chance costs time only.  Extension: around each repeated anchor the document is
extended both ways to all runs of ``LENGTH`` words that hold the anchor; runs
met again, anywhere, are repeats, and the union of overlapping repeats of a
document is its maximal repeats of at least ``LENGTH`` words.

A task that meets a run twice among the texts it holds knows it to be a repeat;
it sends the run on once, whatever its number of occurrences, and of copies of a
text only one is extended.  So a run, however frequent, has a row a task (and
not one an occurrence) where runs meet.

Rows and cases: a null, empty or short text has no run and loses nothing.  A
run repeated inside one document counts.  Documents of equal text are one in
the search, and all their runs repeat.  Runs are judged on the input alone.  Extra
columns are dropped.  A very long text is a chunk of its own.  Equal runs always
meet; different ones are taken as equal with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bitmap, cut, marked
from .text import Chunk, as_long, chunks, gram_hashes, repeat_ranges

LENGTH = 35
SEED = 16
#: Bits of the bitmap for each repeated anchor, and least and most bits in all.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 22, 1 << 28
#: Anchors or runs, and texts, that a task holds before it sends them on.
HELD, TEXTS = 1 << 20, 1 << 17
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<first:int,last:int>>"


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def winnow(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Places of the least grams, all that tie, in each run of ``width`` grams that begins at a valid place.

    A place is one if its gram equals the greatest of the least grams of the runs around it.
    """
    if not len(valid):
        return valid
    least = np.zeros(len(grams) + width - 1, dtype=np.uint64)
    least[valid + width - 1] = _slide(grams, width, np.minimum)[valid]
    return np.flatnonzero(_slide(least, width, np.maximum) == grams)


def _seeds(c: Chunk, words: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, their places) of a chunk's texts."""
    grams = gram_hashes(words, seed)
    at = winnow(grams, repeat_ranges(c.woffs[:-1], np.maximum(c.counts - length + 1, 0)), length - seed + 1)
    return grams[at], at


def _anchors(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(anchor, n): of the texts that a task holds at once, n is 2 at most."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["anchor", "n"])

    for batch in batches:
        for c in chunks(batch.column(0)):
            held.append(_seeds(c, c.word_hashes(), length, seed)[0])
            size += len(held[-1])
            if size >= HELD:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()


def _runs(batches: Iterator[pa.RecordBatch], shared, length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: 0: (run, doc, first = last) met once here; 1: (doc, first, last) of consecutive runs met here again; 2: such a run, once."""
    held: list[tuple[np.ndarray, ...]] = []
    seen: dict[int, int] = {}  # texts held, and whether one came again
    size = 0

    def rows(kind: int, run: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(run), kind, dtype=np.int32)), pa.array(as_long(run)), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["kind", "run", "doc", "first", "last"])

    def sent() -> Iterator[pa.RecordBatch]:
        run, doc, at = (np.concatenate([x[k] for x in held]) for k in range(3))
        copied = np.array([d for d, again in seen.items() if again], dtype=np.int64)
        _, back, n = np.unique(run, return_inverse=True, return_counts=True)
        often = (n[back] > 1) | np.isin(doc, copied)
        alone = np.flatnonzero(~often)
        yield rows(0, run[alone], doc[alone], at[alone], at[alone])
        marks = np.unique(run[often])
        yield rows(2, marks, np.zeros(len(marks), dtype=np.int64), np.zeros(len(marks)), np.zeros(len(marks)))
        doc, at = doc[often], at[often]
        if len(at):
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
            first, last = np.flatnonzero(new), np.flatnonzero(np.concatenate([new[1:], [True]]))
            yield rows(1, np.zeros(len(first), dtype=np.uint64), doc[first], at[first], at[last])

    for batch in batches:
        docs = batch.column(0).to_numpy()
        for c in chunks(batch.column(1)):
            fresh = np.zeros(c.rows, dtype=bool)
            for r, d in enumerate(docs[c.first : c.first + c.rows].tolist()):
                fresh[r] = d not in seen
                seen[d] = int(not fresh[r])
            words = c.word_hashes()
            anchors, at = _seeds(c, words, length, seed)
            row = np.searchsorted(c.woffs, at, "right") - 1
            known = marked(shared.value, anchors) & fresh[row]
            low = np.maximum(at - (length - seed), c.woffs[:-1][row])
            high = np.minimum(at, (c.woffs[1:] - length)[row])
            starts = np.unique(repeat_ranges(low[known], np.maximum(high - low + 1, 0)[known]))
            # a run whose own anchor, its least gram, is met nowhere else can't be met elsewhere
            if len(starts):
                starts = starts[marked(shared.value, _slide(gram_hashes(words, seed), length - seed + 1, np.minimum)[starts])]
            row = np.searchsorted(c.woffs, starts, "right") - 1
            held.append((gram_hashes(words, length)[starts], docs[c.first + row], starts - c.woffs[row]))
            size += len(starts)
            if size >= HELD or len(seen) >= TEXTS:
                yield from sent()
                held, size = [], 0
                seen.clear()
    if held:
        yield from sent()


def _remove(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, sha, kept, spans = [], [], [], [], []
        for text, starts in zip(batch.column(2), batch.column(3), strict=True):
            words = (text.as_py() or "").encode().split()
            found = []
            if starts.is_valid and len(starts):
                first, last = (starts.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(first, kind="stable")
                first, ends = first[order], np.maximum.accumulate(last[order] + length)
                new = np.concatenate([[True], first[1:] > ends[:-1]])
                found = list(zip(first[new].tolist(), ends[np.concatenate([new[1:], [True]])].tolist(), strict=True))
            rest, done = [], 0
            for a, b in found:
                rest += words[done:a]
                done = b
            rest = b" ".join(rest + words[done:])
            n.append(len(words))
            removed.append(sum(b - a for a, b in found))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode() if texts else None)
            spans.append([{"first": a, "last": b} for a, b in found] if texts else None)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, texts: bool = True) -> DataFrame:
    """One row a document: word counts, the digest of what is kept, and with ``texts`` that text and the removed spans."""
    docs = docs.select(F.xxhash64("text").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = docs.where(F.col("text").isNotNull())
    anchors = held.select("text").mapInArrow(lambda it: _anchors(it, length, seed), "anchor long, n int")
    twice = cut(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * twice.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(twice, bits))
    runs = cut(held.select("doc", "text").mapInArrow(lambda it: _runs(it, shared, length, seed), "kind int, run long, doc long, first int, last int"))
    shared.unpersist()
    again = runs.where("kind <> 1").groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select(F.col("run").alias("r"))
    found = runs.where("kind = 0").join(again, F.col("run") == F.col("r")).select("doc", "first", "last").unionByName(runs.where("kind = 1").select("doc", "first", "last"))
    repeats = cut(found.groupBy(F.col("doc").alias("d")).agg(F.collect_set(F.struct("first", "last")).alias("places")))
    return docs.join(repeats, F.col("doc") == F.col("d"), "left").select("doc", "doc_id", "text", "places").mapInArrow(lambda it: _remove(it, length, texts), SCHEMA)
