"""Language identification: words first, then ever shorter character n-grams.

A known word adds its log frequency in each language.  An unseen word adds the
mean, over its characters, of the log frequency of the longest known n-gram
that begins there (four characters, else three, two, one).  The language with
the largest sum wins; ties go to the smaller name.

The classifier is fitted on a bounded sample of labelled rows: about
``SAMPLE_ROWS`` of them (all, if there are fewer), chosen by a hash of doc_id and text.
Words and n-grams seen less than ``LEAST`` times in the sample (a parameter of
the model, the same at every size) are left to the backoff.

Rows and cases: a null text or one without a letter is ``und`` with score 0, as
is every text if no language could be learned.  Words are taken without
punctuation at their ends, A-Z lower-cased; words without letters don't count.
Repeated rows give repeated results.  Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Chunk, Lookup, as_long, buffers, chunks, repeat_ranges

SAMPLE_ROWS = 20_000
GRAMS = 4
LEAST = 2
ALPHA = 0.5
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LETTERLIKE = np.zeros(256, dtype=bool)
_LETTERLIKE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bare_words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of words that hold a letter, without punctuation at the ends."""
    start, end, row = c.start.copy(), c.end.copy(), c.row_of_word()
    has = np.concatenate([[0], np.cumsum(_LETTERLIKE[c.data])])
    keep = has[end] > has[start]
    start, end, row = start[keep], end[keep], row[keep]
    todo = np.arange(len(end))
    while len(todo := todo[_PUNCT[c.data[end[todo] - 1]]]):
        end[todo] -= 1
    todo = np.arange(len(start))
    while len(todo := todo[_PUNCT[c.data[start[todo]]]]):
        start[todo] += 1
    return start, end, row


def _grams(c: Chunk, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, hashes, place, word) for n from GRAMS down to 1: the n-grams of whole characters inside the words.

    place: the number of the character at which the n-gram begins.
    """
    pos = repeat_ranges(start, end - start + 1)
    word = np.repeat(np.arange(len(start)), end - start + 1)
    last = pos == end[word]
    begins = last.copy()
    begins[~last] = (c.data[pos[~last]] & 0xC0) != 0x80
    pos, word, last = pos[begins], word[begins], last[begins]
    for n in range(GRAMS, 0, -1):
        ok = np.flatnonzero((word[:-n] == word[n:]) & ~last[:-n])
        yield n, c.range_hash(prefix, pos[ok], pos[ok + n]), ok, word[ok]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, lang, key, n): kind 0 words, else the length of n-grams, these over the words of a chunk once each."""
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for c in chunks(batch.column(0)):
            start, end, row = _bare_words(c)
            prefix = c.prefix(lower=True)
            h = c.range_hash(prefix, start, end)
            lang = code[c.first + row]
            for k, name in enumerate(names):
                own = np.flatnonzero(lang == k)
                if not len(own):
                    continue
                keys, at, n = np.unique(h[own], return_index=True, return_counts=True)
                found = [(0, keys, n)]
                found += [(size, *np.unique(g, return_counts=True)) for size, g, _, _ in _grams(c, prefix, start[own[at]], end[own[at]])]
                for kind, keys, n in found:
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array([name] * len(keys), pa.string()), pa.array(as_long(keys)), pa.array(n.astype(np.int64))], names=["kind", "lang", "key", "n"])


class Model:
    """Log frequencies of words and of n-grams by language."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, {}
        for kind, (keys, n) in counts.items():
            total = n.sum(axis=0) + ALPHA * (len(keys) + 1)
            self.tables[kind] = (Lookup(keys), np.log((n + ALPHA) / total), np.log(ALPHA / total))

    def sums(self, c: Chunk) -> np.ndarray:
        """Sum of log frequencies: a row a document, a column a language."""
        start, end, row = _bare_words(c)
        prefix = c.prefix(lower=True)
        h = c.range_hash(prefix, start, end)
        lookup, logs, _ = self.tables[0]
        at = lookup.find(h)
        values = np.zeros((len(h), len(self.langs)))
        known = at >= 0
        values[known] = logs[at[known]]
        unseen = np.flatnonzero(~known)
        if len(unseen):
            _, first, back = np.unique(h[unseen], return_index=True, return_inverse=True)
            values[unseen] = self._backoff(c, prefix, start[unseen[first]], end[unseen[first]])[back]
        return np.stack([np.bincount(row, weights=values[:, k], minlength=c.rows) for k in range(len(self.langs))], axis=1)

    def _backoff(self, c: Chunk, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, chars, done = np.zeros((len(start), len(self.langs))), np.zeros(len(start)), None
        for n, h, place, word in _grams(c, prefix, start, end):
            if done is None:
                done = np.zeros(int(end.sum() - start.sum()) + 2 * len(start), dtype=bool)
            lookup, logs, least = self.tables[n]
            todo = np.flatnonzero(~done[place])
            at = lookup.find(h[todo])
            hit = at >= 0 if n > 1 else np.ones(len(at), dtype=bool)
            todo, at = todo[hit], at[hit]
            values = np.where((at >= 0)[:, None], logs[at] if len(logs) else least, least)
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(word[todo], weights=values[:, k], minlength=len(start))
            chars += np.bincount(word[todo], minlength=len(start))
            done[place[todo]] = True
        return out / np.maximum(chars, 1)[:, None]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, least: int = LEAST) -> Model | None:
    """Learn from text and lang of about ``sample_rows`` rows of (doc_id, text, lang)."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = labelled.count()
    share = min(1.0, sample_rows / max(1, rows))
    place = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("langid"))
    sample = labelled if share >= 1 else labelled.where(place < F.lit(int(-(2**63) + share * 2**64)))
    counted = sample.select("text", "lang").mapInArrow(_count, "kind int, lang string, key long, n long")
    counted = counted.groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("kind") == 1))
    got = counted.toArrow()
    langs = sorted(set(got["lang"].unique().to_pylist()))
    if not langs:
        return None
    kind, key, n = (got[x].to_numpy() for x in ("kind", "key", "n"))
    lang = np.searchsorted(np.array(langs), got["lang"].to_numpy(zero_copy_only=False).astype(str))
    counts = {}
    for k in range(GRAMS + 1):
        own = kind == k
        keys, back = np.unique(key[own].view(np.uint64), return_inverse=True)
        table = np.zeros((len(keys), len(langs)))
        np.add.at(table, (back, lang[own]), n[own])
        counts[k] = keys, table
    return Model(langs, counts)


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
        data, offs = buffers(batch.column(2))
        for c in chunks(batch.column(2)) if model else ():
            sums = model.sums(c)
            letters = np.concatenate([[0], np.cumsum(_LETTERLIKE[c.data] & (c.data < 128))])
            high = np.concatenate([[0], np.cumsum(c.data >= 128)])
            best = sums.argmax(axis=1)
            share = np.exp(sums - sums.max(axis=1, keepdims=True))
            share = share.max(axis=1) / share.sum(axis=1)
            sure = letters[c.offs[1:]] > letters[c.offs[:-1]]
            maybe = high[c.offs[1:]] > high[c.offs[:-1]]
            for r in range(c.rows):
                if sure[r] or maybe[r] and any(x.isalpha() for x in c.row_bytes(r).decode("utf-8", "replace")):
                    pred[c.first + r], score[c.first + r] = model.langs[best[r]], share[r]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lambda it: _predict(it, shared), SCHEMA)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the rows that aren't held out, predict all."""
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample_rows))
