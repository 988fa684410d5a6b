"""Toxic spans and document scores from a linear-chain conditional random field.

Two states, clean and toxic; a token's features are its word, its first four
and six bytes and its last three (A-Z lower-cased, punctuation at the ends left
out).  Labels come by document, so tokens are labelled first: in a toxic
document, those words are toxic that have, or begin with what has, its contexts
(words with the distinct words before them, so that copies of a document don't
count again) in toxic documents far more often than chance allows.  The field is fitted by gradient ascent on the forward-backward
marginals.  A document's score comes from its marginals of the toxic state, by
a logistic curve over the largest, their sum and their sum for each hundred
tokens, fitted on the same rows; tokens of 0.5 or more make the offending spans.

The fit uses a bounded sample of labelled rows that aren't held out, about
``SAMPLE_ROWS`` of them chosen by a hash of doc_id and text; scoring reads every
whole text.

Rows and cases: a null or empty text scores what no toxic token does (next to 0) and has no span.  Of several
labels of a document the largest counts; null labels don't.  Without a toxic or
without a clean row in the sample every score is 0.  Repeated rows score alike.
Extra columns are dropped by ``score`` and kept by ``reject``.  Offsets count
code points, ends are exclusive.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import _bare_words
from .store import cut
from .text import Chunk, Lookup, chunks, mix

SAMPLE_ROWS = 2_400
THRESHOLD = 0.3
#: Lengths in bytes of the beginnings that may be toxic as such, and their least toxic share of contexts.
STEMS, STEM_SHARE = (4, 5, 6, 7, 8), 0.95
#: Clean documents for each toxic one in the gradient; all count in the choice of toxic words.
CLEAN_TO_TOXIC = 2
ROUNDS = 40
RATE = 0.5
L2 = 1e-4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans string"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Tokens:
    """Feature hashes, rows and byte ranges of a chunk's tokens."""

    def __init__(self, c: Chunk):
        self.start, self.end, self.row = _bare_words(c)
        self._chunk, self._prefix = c, c.prefix(lower=True)
        self.word = c.range_hash(self._prefix, self.start, self.end)
        self.begins = np.concatenate([[True], self.row[1:] != self.row[:-1]]) if len(self.row) else np.zeros(0, dtype=bool)

    def head(self, n: int) -> np.ndarray:
        return self._chunk.range_hash(self._prefix, self.start, np.minimum(self.start + n, self.end))

    def features(self) -> list[np.ndarray]:
        tail = self._chunk.range_hash(self._prefix, np.maximum(self.end - 3, self.start), self.end)
        return [self.word, self.head(4), self.head(6), tail]


def forward_backward(x: np.ndarray, begins: np.ndarray, pi: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(r, s): forward and backward odds of the second state at each token.

    x: emission odds; begins: tokens that start a document; pi, a: start and
    transition weights.  Tokens lie in lanes that advance together: products of
    each lane's matrices first, then the states between lanes, then all tokens.
    """
    n = len(x)
    width = max(1, int(np.sqrt(n)))
    lanes = -(-n // width)
    grid, first = np.ones(lanes * width), np.zeros(lanes * width, dtype=bool)
    grid[:n], first[:n] = x, begins
    first[n:] = True  # padding: documents of their own
    grid, first = np.ascontiguousarray(grid.reshape(lanes, width).T), np.ascontiguousarray(first.reshape(lanes, width).T)
    m00, m10 = np.where(first, pi[0], a[0, 0]), np.where(first, pi[0], a[1, 0])
    m01, m11 = np.where(first, pi[1], a[0, 1]) * grid, np.where(first, pi[1], a[1, 1]) * grid
    p = [np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)]
    for k in range(width):
        p = [p[0] * m00[k] + p[1] * m10[k], p[0] * m01[k] + p[1] * m11[k], p[2] * m00[k] + p[3] * m10[k], p[2] * m01[k] + p[3] * m11[k]]
        total = p[0] + p[1] + p[2] + p[3]
        p = [q / total for q in p]
    before, after = np.ones(lanes), np.ones(lanes)
    for k in range(1, lanes):
        u = before[k - 1]
        before[k] = (p[1][k - 1] + u * p[3][k - 1]) / (p[0][k - 1] + u * p[2][k - 1])
    for k in range(lanes - 2, -1, -1):
        v = after[k + 1]
        after[k] = (p[2][k + 1] + p[3][k + 1] * v) / (p[0][k + 1] + p[1][k + 1] * v)
    r, s = np.empty((width, lanes)), np.empty((width, lanes))
    u, v = before, after
    for k in range(width):
        u = r[k] = (m01[k] + u * m11[k]) / (m00[k] + u * m10[k])
    for k in range(width - 1, -1, -1):
        s[k] = v
        v = (m10[k] + m11[k] * v) / (m00[k] + m01[k] * v)
    return r.T.ravel()[:n], s.T.ravel()[:n]


class Field:
    """Weights of the conditional random field: a table for each kind of feature, its last weight for unknown ones."""

    def __init__(self, keys: list[np.ndarray]):
        self.tables = [Lookup(k) for k in keys]
        self.weights = [np.zeros(len(k) + 1) for k in keys]
        self.start, self.trans = np.array([0.0, -3.0]), np.array([[0.0, -3.0], [0.0, -1.0]])

    def places(self, features: list[np.ndarray]) -> list[np.ndarray]:
        return [table.find(f).astype(np.int32) for table, f in zip(self.tables, features, strict=True)]

    def odds(self, places: list[np.ndarray]) -> np.ndarray:
        return np.exp(np.clip(sum(w[at] for w, at in zip(self.weights, places, strict=True)), -30, 30))

    def marginals(self, t: Tokens) -> np.ndarray:
        if not len(t.word):
            return np.zeros(0)
        r, s = forward_backward(self.odds(self.places(t.features())), t.begins, np.exp(self.start), np.exp(self.trans))
        return r * s / (1 + r * s)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Weights of the logistic curve, by Newton's steps with a weak pull to zero."""
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
            w += np.clip(step, -3, 3)
        self.curve = w

    def train(self, parts: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> None:
        """Gradient ascent (each step scaled by past gradients) on the log likelihood of labelled tokens.

        parts: (places of features, begins of documents, labels) of tokens.
        """
        weights = [*self.weights, self.start, self.trans]
        past = [np.full(w.shape, 1e-6) for w in weights]
        for _ in range(rounds):
            grads = [-L2 * w for w in weights]
            for places, begins, gold in parts:
                x, pi, a = self.odds(places), np.exp(self.start), np.exp(self.trans)
                r, s = forward_backward(x, begins, pi, a)
                m = r * s / (1 + r * s)
                d = gold - m
                for g, idx in zip(grads, places):  # -1, an unknown feature, is the last place
                    g += np.bincount(idx % len(g), weights=d, minlength=len(g))
                b = np.flatnonzero(begins)
                grads[-2] += [(1 - gold[b]).sum() - (1 - m[b]).sum(), gold[b].sum() - m[b].sum()]
                i = np.flatnonzero(~begins)
                u, v = r[i - 1], x[i] * s[i]
                w = np.stack([np.full(len(i), a[0, 0]), a[0, 1] * v, a[1, 0] * u, a[1, 1] * u * v])
                w = (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)
                seen = np.bincount((gold[i - 1] * 2 + gold[i]).astype(np.int64), minlength=4).reshape(2, 2)
                grads[-1] += seen - w
            for w, g, h in zip(weights, grads, past, strict=True):
                h += g * g
                w += RATE * g / np.sqrt(h)


def toxic_keys(key: np.ndarray, word: np.ndarray, toxic: np.ndarray, begins: np.ndarray, least: float) -> np.ndarray:
    """Keys (words, or their beginnings) whose contexts, word and word before, are toxic beyond chance, over all keys tested."""
    if not len(word):
        return word
    before = np.concatenate([[np.uint64(0)], word[:-1]])
    with np.errstate(over="ignore"):
        pair = mix(np.where(begins, np.uint64(1), before)) * np.uint64(31) + word
    order = np.lexsort((toxic, pair, key))
    context = np.stack([key, pair, toxic.astype(np.uint64)], axis=1)[order]
    context = context[np.concatenate([[True], (context[1:] != context[:-1]).any(axis=1)])]
    keys, first = np.unique(context[:, 0], return_index=True)
    bad = np.add.reduceat(context[:, 2].astype(np.float64), first)
    n = np.diff(np.concatenate([first, [len(context)]])).astype(np.float64)
    p = context[:, 2].mean()
    if not 0 < p < 1:
        return keys[:0]
    q = np.clip(bad / n, 1e-12, 1 - 1e-12)
    excess = n * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p)))
    return keys[(q > max(least, p)) & (excess > np.log(len(keys) / 0.01))]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field | None:
    """Learn from about ``sample_rows`` labelled documents; the join takes the sampled labels to the texts.

    Rows are chosen, and ordered, by a hash of doc_id and text, so that the rows
    of one doc_id are a sample too and reruns agree.  One task fits the field
    (the sample is bounded), away from the driver.
    """
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("is_toxic"))
    labels = cut(labels.where(~held_out(F.col("label_id"))))
    # twice the wanted share of labels goes to the texts; the rows found, copies of a doc_id too, are thinned to the bound
    first = F.xxhash64(F.col("label_id").cast("string"), F.lit("toxicity"))
    chosen = labels.where(below(first, 2 * sample_rows, labels.count()))
    joined = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    found = cut(joined.select(F.xxhash64("label_id", "text", F.lit("row")).alias("place"), (F.col("is_toxic") > 0).alias("is_toxic"), "doc_id", "text").dropDuplicates(["place"]))
    sample = found.where(below(F.col("place"), sample_rows, found.count())).select(F.lit(0).alias("one"), "place", "is_toxic", "doc_id", "text")
    fitted = sample.groupBy("one").applyInArrow(_fitted, "field binary").collect()
    return pickle.loads(fitted[0].field) if fitted else None


def below(place: Column, wanted: int, rows: int) -> Column:
    """Whether a 64-bit hash is among the least share ``wanted`` of ``rows``."""
    share = wanted / max(1, rows)
    return F.lit(True) if share >= 1 else place < F.lit(int(-(2**63) + share * 2**64))


def _fitted(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("place", "ascending"), ("doc_id", "ascending")])
    column = rows["text"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    field = learn(column, rows["is_toxic"].to_numpy(zero_copy_only=False).astype(bool))
    return pa.table({"field": pa.array([pickle.dumps(field)], pa.binary())})


def learn(column: pa.Array, labels_of: np.ndarray) -> Field | None:
    """The field of labelled texts. Only features are kept of a chunk, so memory follows the sample's tokens."""
    if not len(labels_of) or labels_of.all() or not labels_of.any():
        return None
    whole: list[list[np.ndarray]] = [[], [], []]
    for c in chunks(column):
        t = Tokens(c)
        for kept, x in zip(whole, (t.word, labels_of[c.first + t.row], t.begins), strict=True):
            kept.append(x)
    word, bad, begins = map(np.concatenate, whole)
    del whole
    seeds = [Lookup(toxic_keys(word, word, bad, begins, 0.5))]
    for n in STEMS:
        seeds.append(Lookup(toxic_keys(np.concatenate([Tokens(c).head(n) for c in chunks(column)]), word, bad, begins, STEM_SHARE)))
    del word, bad, begins
    if not any(len(x.keys) for x in seeds):
        return None
    # the gradient: all toxic documents, and some clean ones for each
    clean = np.flatnonzero(~labels_of)
    use = labels_of.copy()
    use[clean[: CLEAN_TO_TOXIC * int(labels_of.sum())]] = True
    gold_of, parts = labels_of[use], []
    for c in chunks(column.filter(pa.array(use))):
        t = Tokens(c)
        if len(t.word):
            hit = seeds[0].find(t.word) >= 0
            for n, look in zip(STEMS, seeds[1:], strict=True):
                hit |= (look.find(t.head(n)) >= 0) & (t.end - t.start >= n)
            parts.append((t.features(), t.begins, (hit & gold_of[c.first + t.row]).astype(np.float64)))
    keys = []
    for k in range(4):
        key, n = np.unique(np.concatenate([f[k] for f, _, _ in parts]), return_counts=True)
        keys.append(key[n > 1])
    field = Field(keys)
    parts = [(field.places(f), begins, gold) for f, begins, gold in parts]
    field.train(parts)
    del parts
    rows = [aggregates(t, field.marginals(t), c.rows) for c in chunks(column) for t in [Tokens(c)]]
    field.calibrate(np.concatenate(rows), labels_of.astype(np.float64))
    return field


def aggregates(t: Tokens, m: np.ndarray, rows: int) -> np.ndarray:
    """Of each row: 1, the largest marginal, and logarithms of their sum and of their sum for each hundred tokens."""
    total, n = np.bincount(t.row, weights=m, minlength=rows), np.bincount(t.row, minlength=rows)
    most = np.zeros(rows)
    if len(m):
        first = np.flatnonzero(t.begins)
        most[t.row[first]] = np.maximum.reduceat(m, first)
    return np.stack([np.ones(rows), most, np.log1p(total), np.log1p(100 * total / np.maximum(n, 1))], axis=1)


def _scored(column: pa.Array, field: Field | None) -> tuple[np.ndarray, list[str]]:
    score, spans = np.zeros(len(column)), [""] * len(column)
    for c in chunks(column) if field else ():
        t = Tokens(c)
        m = field.marginals(t)
        score[c.first : c.first + c.rows] = 1 / (1 + np.exp(-np.clip(aggregates(t, m, c.rows) @ field.curve, -30, 30)))
        hot = np.flatnonzero(m >= 0.5)
        if len(hot):
            chars = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
            new = np.concatenate([[True], (np.diff(hot) > 1) | t.begins[hot[1:]]])
            a, b = hot[new], hot[np.concatenate([new[1:], [True]])]
            rows, zero = t.row[a], chars[c.offs[t.row[a]]]
            for row, x, y in zip((c.first + rows).tolist(), (chars[t.start[a]] - zero).tolist(), (chars[t.end[b]] - zero).tolist(), strict=True):
                spans[row] += f",{x}:{y}" if spans[row] else f"{x}:{y}"
    return score, spans


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score, spans = _scored(batch.column(2), shared.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(spans, pa.string())], names=["doc_id", "held_out", "score", "predicted", "spans"])


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, spans; learnt from documents not held out."""
    field = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text"), labels.select("doc_id", "toxic"), sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lambda it: _score(it, shared), SCHEMA)


def _keep(batches: Iterator[pa.RecordBatch], shared, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_scored(batch.column(at), shared.value)[0] < THRESHOLD))


def reject(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score below the threshold, all columns; learnt from documents not held out."""
    field = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text"), labels.select("doc_id", "toxic"), sample_rows)
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index("text")
    return docs.mapInArrow(lambda it: _keep(it, shared, at), docs.schema)
