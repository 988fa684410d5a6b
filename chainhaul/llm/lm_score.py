"""Language-model scoring with a weighted backoff automaton.

Counts of words and of n-grams come from all training documents.  Every n-gram
of two and three words that occurs ``LEAST`` times is an arc, whatever share of
the corpus it is, so the model grows with the corpus.  It is held in tables
keyed by 64-bit hashes: scoring meets them in one join by buckets of keys, with
additive weights.
Leaving a state h by its failure arc adds bow(h); an n-gram hw that is an arc
adds what its log probability differs from that way.  So a document's score is
the sum, over all its words and n-grams, of one weight each.

What bounds memory: words and n-grams that make up at least ``WORD_SHARE`` and
``GRAM_SHARE`` of all training tokens are held by every worker (at most
1 / share of each), all others are joined; bitmaps of fixed size keep n-grams
that cannot be arcs out of the counts and the join.  Neither changes a result.
Tasks hold a fixed number of n-grams or lookups before they send them on, and
buckets grow in number with the corpus, not in size (up to ``MOST_BUCKETS``).

Smoothing: the root gives log10((c + 0.5) / (N + 0.5 (V + 1))).  A higher state
h gives a seen word w (c(hw) - D) / c(h); its failure arc has the weight that
makes the state's probabilities sum to one, (D n(h) + the unseen part) over
what the lower state leaves to unseen words.

``fit`` builds an ``Automaton`` of what one worker can hold (n-grams above a
share), to walk it token by token; ``score`` does not use it.

Rows and cases: a null or empty text is its end token alone.  Repeated rows are
scored alike (and counted in training as often as they occur).  An empty
training part gives N = 0 and the root formula.  Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bitmap, cut, discard, marked, once, thinned
from .text import Chunk, Lookup, as_long, chunks, mix

WORD_SHARE = 5e-7
GRAM_SHARE = 3e-7
#: N-grams that occur less often are no arcs.
LEAST = 2
ORDER = 3
DISCOUNT = 0.75
LANE = 512
#: The key of the end token; no word's hash but by a chance of 2**-64.
END = np.uint64(0x5EED0FE0DD0C0E4D)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens_of(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a chunk's tokens, each document's words and then its end, and the documents' offsets."""
    offs = c.woffs + np.arange(c.rows + 1)
    out = np.empty(int(offs[-1]), dtype=np.uint64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[offs[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = c.word_hashes(lower=True)
    return out, offs


class _Counter:
    """Counts of 64-bit keys, merged now and then; further columns that a key determines go with it."""

    def __init__(self):
        self.parts, self.held, self.limit = [], 0, 1 << 20

    def add(self, keys: np.ndarray, *more: np.ndarray) -> None:
        if len(keys):
            keys, at, n = np.unique(keys, return_index=True, return_counts=True)
            self._push((keys, n, *(x[at] for x in more)))

    def _push(self, part) -> None:
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > self.limit:
            self._merge()
            self.limit = max(1 << 20, 2 * self.held)

    def _merge(self) -> None:
        keys, n, *more = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts, self.held = [(keys[first], np.add.reduceat(n, first), *(x[order[first]] for x in more))], len(first)

    def batches(self, size: int = 1 << 17) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            keys, n, *more = self.parts[0]
            for k in range(0, len(keys), size):
                own = more or [keys]
                yield pa.RecordBatch.from_arrays([*(pa.array(as_long(x[k : k + size])) for x in own), pa.array(n[k : k + size].astype(np.int64))], names=["left", "right", "n"] if more else ["key", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for batch in batches:
        for c in chunks(batch.column(0)):
            counter.add(tokens_of(c)[0])
    yield from counter.batches()


#: Bits of a word's number in the key of an n-gram; the share of n-grams keeps numbers below 2**BITS.
BITS = 21


def gram_keys(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams of numbered words that begin at the given places."""
    out = words[at]
    for k in range(1, n):
        out = out << BITS | words[at + k]
    return out.astype(np.uint64)


def _count_grams(batches: Iterator[pa.RecordBatch], shared, n: int) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams whose two (n-1)-grams are frequent enough: no other can be."""
    (words, shorter), counter = shared.value, _Counter()
    for batch in batches:
        for c in chunks(batch.column(0)):
            tokens, offs = tokens_of(c)
            number = words.find(tokens)
            left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(tokens))
            ok = number >= 0
            for k in range(1, n):
                ok[: len(ok) - k] &= number[k:] >= 0
            at = np.flatnonzero(ok & (left >= n))
            if shorter is not None and len(at):
                at = at[(shorter.find(gram_keys(number, at, n - 1)) >= 0) & (shorter.find(gram_keys(number, at + 1, n - 1)) >= 0)]
            counter.add(gram_keys(number, at, n))
    yield from counter.batches()


class Automaton:
    """States, arcs with weights, failure arcs.

    State 0 is the root; states are frequent n-grams of at most ORDER - 1
    words.  An arc's key mixes its state and the word; ``to`` is its end.
    """

    def __init__(self, total: int, distinct: int, words: tuple[np.ndarray, np.ndarray], grams: list[tuple[np.ndarray, np.ndarray]]):
        """words: keys and counts; grams: for n = 2, 3, ...: the words' numbers (a row an n-gram) and counts."""
        self.total, self.distinct = total, distinct
        self.words, self.counts = Lookup(words[0]), words[1]
        self.base = np.log10((words[1] + 0.5) / (total + 0.5 * (distinct + 1)))
        order = len(grams) + 1
        ids = [g for g, _ in grams]
        counts = [words[1], *(n for _, n in grams)]
        # states: what comes before the last word of an n-gram
        self.state: dict[tuple[int, ...], int] = {(): 0}
        for g in ids:
            for row in map(tuple, np.unique(g[:, :-1], axis=0).tolist()):
                self.state.setdefault(row, len(self.state))
        n = len(self.state)
        self.fail, self.bow = np.zeros(n, dtype=np.int64), np.zeros(n)
        for row, s in self.state.items():
            rest = row[1:]
            while rest not in self.state:
                rest = rest[1:]
            self.fail[s] = self.state[rest]
        number = [{tuple(r): k for k, r in enumerate(x.tolist())} for x in ids]

        def count(row: tuple[int, ...]) -> int:
            return int(words[1][row[0]]) if len(row) == 1 else int(counts[len(row) - 1][number[len(row) - 2][row]])

        logp: dict[tuple[int, int], float] = {}

        def lower(s: int, w: int) -> float:
            """Log probability of w at state s, through failure arcs."""
            add = 0.0
            while s:
                if (s, w) in logp:
                    return add + logp[s, w]
                add, s = add + self.bow[s], int(self.fail[s])
            return add + float(self.base[w])

        arcs, to = [], []
        for size in range(2, order + 1):
            own = ids[size - 2]
            by = np.lexsort(own.T[::-1])
            rows, got = own[by].tolist(), counts[size - 1][by]
            k = 0
            while k < len(rows):
                head, e = tuple(rows[k][:-1]), k
                while e < len(rows) and tuple(rows[e][:-1]) == head:
                    e += 1
                s, c = self.state[head], count(head)
                seen, below = 0.0, 0.0
                for row, g in zip(rows[k:e], got[k:e].tolist(), strict=True):
                    p = (g - DISCOUNT) / c
                    seen += p
                    below += 10.0 ** lower(int(self.fail[s]), row[-1])
                    logp[s, row[-1]] = float(np.log10(p))
                self.bow[s] = np.log10(max(1.0 - seen, 1e-9) / max(1.0 - below, 1e-9))
                k = e
        rows_of = list(self.state)
        for (s, w), p in logp.items():
            nxt = (*rows_of[s], w)[-(order - 1) :]
            while nxt not in self.state:
                nxt = nxt[1:]
            arcs.append((s, w, p))
            to.append(self.state[nxt])
        keys = np.array([a[0] for a in arcs], dtype=np.uint64) << np.uint64(32) | np.array([a[1] for a in arcs], dtype=np.uint64)
        self.arcs, self.arc_log, self.arc_to = Lookup(keys), np.array([a[2] for a in arcs]), np.array(to, dtype=np.int64)
        self.root_to = np.array([self.state.get((w,), 0) for w in range(len(words[0]))], dtype=np.int64)
        self.depth = order
        del self.state

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New states and log probabilities; a rare word (-1) adds failure weights only."""
        state, out = state.copy(), np.zeros(len(state))
        new = np.where(word >= 0, self.root_to[word] if len(self.root_to) else 0, 0)
        todo = np.flatnonzero(state > 0)
        settled = np.zeros(len(state), dtype=bool)
        while len(todo):
            s, w = state[todo], word[todo]
            at = np.full(len(todo), -1)
            known = w >= 0
            at[known] = self.arcs.find(s[known].astype(np.uint64) << np.uint64(32) | w[known].astype(np.uint64))
            hit = at >= 0
            done = todo[hit]
            out[done] += self.arc_log[at[hit]]
            new[done] = self.arc_to[at[hit]]
            settled[done] = True
            todo, s = todo[~hit], s[~hit]
            out[todo] += self.bow[s]
            state[todo] = self.fail[s]
            todo = todo[state[todo] > 0]
        root = ~settled & (word >= 0)
        out[root] += self.base[word[root]]
        return new, out

    def walk(self, word: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log probability of each token, left to right; begins: tokens that start a document."""
        n = len(word)
        lanes = -(-n // LANE)
        grid = np.full(lanes * LANE, -1)
        grid[:n] = word
        reset = np.zeros(lanes * LANE, dtype=bool)
        reset[begins] = True
        grid, reset = grid.reshape(lanes, LANE), reset.reshape(lanes, LANE)
        state = np.zeros(lanes, dtype=np.int64)
        for k in range(LANE - self.depth, LANE):  # what the words before a lane leave
            state[reset[:, k]] = 0
            state, _ = self.step(state, grid[:, k])
        state = np.concatenate([[0], state[:-1]])
        out = np.zeros((lanes, LANE))
        for k in range(LANE):
            state[reset[:, k]] = 0
            state, out[:, k] = self.step(state, grid[:, k])
        return out.ravel()[:n]


#: Bits of the filters that hold the n-grams of one length that may occur again, and those that do.
FILTER_BITS = 1 << 26
#: Tokens of training for each bucket of keys while n-grams are counted and while they are looked up, least and most buckets; n-grams that a task holds before it writes packs, and lookups.
BUCKET, LOOKED_UP, LEAST_BUCKETS, MOST_BUCKETS, HELD, ASKED = 1 << 20, 1 << 22, 24, 1 << 18, 1 << 20, 1 << 18
#: Lookups of a pack, so that an Arrow batch of packs stays small; rows that a task sums up before it sends them on.
PACK, SUMMED = 1 << 7, 1 << 18
#: Bytes of a key in a pack.
KEY_BYTES = 7


def _buckets(tokens: int, each: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, tokens // each))


def _turn(n: int) -> int:
    return 6 * n - 11


def _joined(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Keys of n-grams from those of their first and last n - 1 words; _key does the same."""
    t = np.uint64(_turn(n))
    return left ^ (right << t | right >> (np.uint64(64) - t))


def _key(n: int) -> Column:
    return F.col("left").bitwiseXOR(F.shiftleft("right", _turn(n)).bitwiseOR(F.shiftrightunsigned("right", 64 - _turn(n))))


def _grams(tokens: np.ndarray, offs: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 2, 3, ...: the places where n-grams begin, and the keys of n - 1 and of n words from each place."""
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(tokens))
    keys = tokens
    for n in range(2, order + 1):
        shorter, keys = keys, keys.copy()
        keys[:-1] = _joined(shorter[:-1], shorter[1:], n)
        yield np.flatnonzero(left >= n), shorter, keys


def _prints(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 bits more) of keys."""
    h = mix(keys)
    return (h % np.uint64(buckets)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32)


def _placed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 56 bits more) of keys: from 256 buckets on, both tell the whole key, and 60 bits of it or more below."""
    h = mix(keys)
    more = h // np.uint64(buckets)
    return (h - more * np.uint64(buckets)).astype(np.int64), more & np.uint64((1 << 8 * KEY_BYTES) - 1)


def _joint(bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
    return bucket.astype(np.uint64) << np.uint64(32) | prints.astype(np.uint64)


def _split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The columns by bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [x[order] for x in columns]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, dtype=np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), tuple(x[a:b] for x in columns)


def _packs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int32()) for k in range(len(names) - 1)), pa.array([r[-1] for r in rows], pa.binary())], names=names)


def _print_packs(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, n, packed bits) of the n-grams of this task, once each, or twice if they occur again in what it holds."""
    held: list[list[np.ndarray]] = [[] for _ in range(order - 1)]
    size = 0

    def written() -> pa.RecordBatch:
        rows = []
        for n, parts in enumerate(held, 2):
            keys, times = np.unique(np.concatenate(parts), return_counts=True)
            keys = np.concatenate([keys, keys[times > 1]])
            rows += [(b, n, x.tobytes()) for b, (x,) in _split(*_prints(keys, buckets))]
        return _packs(rows, ["bucket", "size", "data"])

    for batch in batches:
        for c in chunks(batch.column(0)):
            for own, (at, _, keys) in zip(held, _grams(*tokens_of(c), order), strict=True):
                own.append(keys[at])
                size += len(at)
            if size >= HELD:
                yield written()
                held, size = [[] for _ in range(order - 1)], 0
    if size:
        yield written()


def _again(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(size, word, bits) of the bitmaps of what occurs twice; packs come sorted by bucket and n."""
    here, parts = None, []

    def found() -> pa.RecordBatch:
        prints, times = np.unique(np.concatenate(parts), return_counts=True)
        prints = prints[times > 1]
        place = np.sort((mix(_joint(np.full(len(prints), here[0]), prints)) % np.uint64(bits)).astype(np.int64))
        word = place >> 6
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, dtype=np.int64)
        value = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first) if len(first) else np.zeros(0, dtype=np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), here[1], dtype=np.int32)), pa.array(word[first].astype(np.int32)), pa.array(as_long(value))], names=["size", "word", "bits"])

    for batch in batches:
        for bucket, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if parts and (bucket, n) != here:
                yield found()
                parts = []
            here = (bucket, n)
            parts.append(np.frombuffer(data.as_buffer().to_pybytes(), dtype=np.uint32))
    if parts:
        yield found()


def _recurring(texts: DataFrame, order: int, buckets: int) -> list[np.ndarray]:
    """For n = 2, 3, ...: a bitmap of all n-grams that occur twice (and others by chance); at most FILTER_BITS / 64 rows of each reach the driver."""
    packs = texts.mapInArrow(lambda it: _print_packs(it, order, buckets), "bucket int, size int, data binary").repartition(buckets, "bucket").sortWithinPartitions("bucket", "size")
    with once(texts.sparkSession):
        words = packs.mapInArrow(lambda it: _again(it, FILTER_BITS), "size int, word int, bits long").groupBy("size", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    n, word, value = (words[x].to_numpy() for x in ("size", "word", "bits"))
    out = []
    for size in range(2, order + 1):
        table = np.zeros(FILTER_BITS >> 6, dtype=np.int64)
        table[word[n == size]] = value[n == size]
        out.append(table.view(np.uint8))
    return out


def _arc_packs(batches: Iterator[pa.RecordBatch], shared, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, n, keys of the first and of the last n - 1 words, counts) of n-grams that may occur again, by the bucket of all n."""
    filters = shared.value
    counters = [_Counter() for _ in filters]

    def written(k: int) -> pa.RecordBatch:
        packs = []
        for own in counters[k].batches(1 << 62):
            left, right, n = (x.to_numpy() for x in own.columns)
            bucket = (mix(_joined(left.view(np.uint64), right.view(np.uint64), k + 2)) % np.uint64(buckets)).astype(np.int64)
            packs += [(b, k + 2, x.tobytes() + y.tobytes() + z.astype(np.int32).tobytes()) for b, (x, y, z) in _split(bucket, left, right, n)]
        counters[k] = _Counter()
        return _packs(packs, ["bucket", "size", "data"])

    for batch in batches:
        for c in chunks(batch.column(0)):
            for k, (at, shorter, keys) in enumerate(_grams(*tokens_of(c), len(filters) + 1)):
                at = at[marked(filters[k], _joint(*_prints(keys[at], buckets)))]
                counters[k].add(keys[at], shorter[at], shorter[at + 1])
                if counters[k].held > HELD:
                    yield written(k)
    for k in range(len(filters)):
        yield written(k)


def _arcs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(size, left, right, n) of n-grams that occur often enough; packs come sorted by bucket and n."""
    here, parts = None, []

    def counted() -> pa.RecordBatch:
        left, right, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((right, left))
        left, right, n = left[order], right[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(left) else np.zeros(0, dtype=np.int64)
        n = np.add.reduceat(n.astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)
        first, n = first[n >= least], n[n >= least]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), here[1], dtype=np.int32)), pa.array(left[first]), pa.array(right[first]), pa.array(n)], names=["size", "left", "right", "n"])

    for batch in batches:
        for bucket, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if parts and (bucket, n) != here:
                yield counted()
                parts = []
            here = (bucket, n)
            data = data.as_buffer().to_pybytes()
            m = len(data) // 20
            parts.append((np.frombuffer(data, np.int64, m), np.frombuffer(data, np.int64, m, 8 * m), np.frombuffer(data, np.int32, m, 16 * m)))
    if parts:
        yield counted()


def weights(train: DataFrame, order: int = ORDER, least: int = LEAST) -> tuple[int, int, DataFrame, list[np.ndarray]]:
    """Training tokens, distinct words, the table (key, is_word, n, v) of all words and arcs, written, and a filter for each order of n-grams.

    The v of a key's rows add up: a word or an n-gram has one row with its
    count, an n-gram's with what its arc adds; a state has one more of count 0,
    with its failure weight.
    """
    if least < 2:
        raise ValueError("an arc is an n-gram that occurs twice at least")
    sc = train.sparkSession.sparkContext
    texts = train.select("text")
    counts = cut(texts.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = _buckets(total, BUCKET)
    shared = sc.broadcast(_recurring(texts, order, buckets))
    arcs = texts.mapInArrow(lambda it: _arc_packs(it, shared, buckets), "bucket int, size int, data binary").repartition(buckets, "bucket").sortWithinPartitions("bucket", "size")
    arcs = cut(arcs.mapInArrow(lambda it: _arcs(it, least), "size int, left long, right long, n long"))
    shared.destroy()  # every executor has a file of it
    parts = [counts.select("key", F.lit(True).alias("is_word"), "n", F.lit(0.0).alias("v"))]
    kept = counts.where(F.col("n") >= least).select("key", "n", F.log10((F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1))).alias("p"))
    filters, tables = [], []
    for n in range(2, order + 1):
        grams = arcs.where(F.col("size") == n).select("left", "right", "n").withColumn("key", _key(n))
        grams = grams.join(kept.select(F.col("key").alias("left"), F.col("n").alias("c")), "left").join(kept.select(F.col("key").alias("right"), F.col("p").alias("low")), "right")
        grams = cut(grams.select("key", "left", "n", "low", F.log10((F.col("n") - DISCOUNT) / F.col("c")).alias("p")))
        if n == order:
            discard(arcs)
        room = [F.greatest(1 - F.sum(F.pow(F.lit(10.0), F.col(x))), F.lit(1e-9)) for x in ("p", "low")]
        states = cut(grams.groupBy("left").agg(F.log10(room[0] / room[1]).alias("bow")))
        tables += [grams, states]
        parts.append(states.select(F.col("left").alias("key"), F.lit(n == 2).alias("is_word"), F.lit(0).cast("long").alias("n"), F.col("bow").alias("v")))
        parts.append(grams.join(states, "left").select("key", F.lit(False).alias("is_word"), "n", (F.col("p") - F.col("low") - F.col("bow")).alias("v")))
        kept = grams.select("key", "n", "p")
        filters.append(bitmap(kept, FILTER_BITS))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionAll(part)
    table = cut(table)
    for done in (counts, *tables):
        discard(done)
    return total, distinct, table, filters


OUT = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _asked_pack(keys: np.ndarray, rows: np.ndarray) -> bytes:
    step = np.diff(rows, prepend=rows[0]).astype(np.int32).tobytes()
    return np.int64(rows[0]).tobytes() + keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes() + step


def _score(batches: Iterator[pa.RecordBatch], shared, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs of three kinds (``_model_packs`` has another), by bucket: 0: documents with what the worker holds, 1: other words of theirs, 2: n-grams that may be arcs.

    1 and 2: the first row, then keys and how far each one's row is from the
    one before (mostly nothing, so that Spark's compression shrinks it).
    """
    words, base, v, grams, gram_v, filters = shared.value
    held: tuple[list, list, list] = ([], [], [])
    size = 0

    def written() -> pa.RecordBatch:
        packs = []
        for kind in (1, 2):
            if held[kind]:
                keys, rows = (np.concatenate([x[k] for x in held[kind]]) for k in range(2))
                order = np.argsort(rows, kind="stable")
                keys, rows = keys[order], rows[order]
                packs += [(b, kind, _asked_pack(k[a : a + PACK], r[a : a + PACK])) for b, (k, r) in _split(*_placed(keys, buckets), rows) for a in range(0, len(k), PACK)]
        if held[0]:
            columns = [np.concatenate([x[k] for x in held[0]]) for k in range(7)]
            packs += [(b, 0, np.stack([x.view(np.int64) for x in own]).tobytes()) for b, own in _split((mix(columns[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), *columns)]
        return _packs(packs, ["bucket", "kind", "data"])

    for batch in batches:
        ids, out, text, place = batch.columns
        for c in chunks(text):
            tokens, offs = tokens_of(c)
            word = words.find(tokens)
            known = word >= 0
            n = np.diff(offs)
            row = np.repeat(np.arange(c.rows), n)
            rows = place.slice(c.first, c.rows).to_numpy()
            logs = np.where(known, (base + v)[word] if len(base) else 0.0, 0.0)
            for (at, _, keys), bits in zip(_grams(tokens, offs, len(filters) + 1), filters, strict=True):
                at = at[marked(bits, keys[at])]
                found = grams.find(keys[at])
                hit = found >= 0
                logs[at[hit]] += gram_v[found[hit]]
                at = at[~hit]
                held[2].append((keys[at], rows[row[at]]))
                size += len(at)
            rare = np.flatnonzero(~known)
            held[1].append((tokens[rare], rows[row[rare]]))
            total = [np.bincount(row, weights=x, minlength=c.rows) for x in (known, np.where(known, base[word] if len(base) else 0.0, 0.0), logs)]
            own = ids.slice(c.first, c.rows)
            flags = np.asarray(out.slice(c.first, c.rows)).astype(np.int64) | np.asarray(own.is_null()).astype(np.int64) << 1
            held[0].append((rows, np.asarray(own.fill_null(0)), flags, n.astype(np.int64), total[0].astype(np.int64), total[1], total[2]))
            size += len(rare) + c.rows
            if size >= ASKED:
                yield written()
                held, size = ([], [], []), 0
                pa.default_memory_pool().release_unused()
    if held[0]:
        yield written()


def _model_packs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs of kind 3: keys, weights and counts of words (0 of n-grams) of the model's rows (key, is_word, n, v)."""
    held, size = [], 0

    def written() -> pa.RecordBatch:
        key, v, n = (np.concatenate([x[k] for x in held]) for k in range(3))
        bucket, key = _placed(key.view(np.uint64), buckets)
        return _packs([(b, 3, x.tobytes() + y.tobytes() + z.tobytes()) for b, (x, y, z) in _split(bucket, key, v, n)], ["bucket", "kind", "data"])

    for batch in batches:
        key, is_word, n, v = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        held.append((key.copy(), v.copy(), np.where(is_word, n, 0)))
        size += len(key)
        if size >= HELD:
            yield written()
            held, size = [], 0
    if size:
        yield written()


class _Rows:
    """Sums by row, merged now and then."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, *part: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Takes (row, known, base, score); gives sums when too many are held."""
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > 2 * SUMMED:
            self._merge()
            if self.held > SUMMED:
                yield from self.batches()

    def _merge(self) -> None:
        rows, *sums = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        rows, back = np.unique(rows, return_inverse=True)
        self.parts, self.held = [(rows, *(np.bincount(back, weights=x, minlength=len(rows)) for x in sums))], len(rows)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            rows, known, base, score = self.parts[0]
            self.parts, self.held = [], 0
            none = np.zeros(len(rows), dtype=np.int64)
            columns = [pa.array(rows), pa.nulls(len(rows), pa.int64()), pa.array(none.astype(bool)), pa.array(none), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=OUT)


def _documents(data: list[bytes]) -> pa.RecordBatch:
    doc = np.concatenate([np.frombuffer(x, np.int64).reshape(7, -1) for x in data], axis=1)
    columns = [pa.array(doc[0]), pa.array(doc[1], mask=doc[2] & 2 > 0), pa.array(doc[2] & 1 > 0), pa.array(doc[3]), pa.array(doc[4]), pa.array(doc[5].view(np.float64)), pa.array(doc[6].view(np.float64))]
    return pa.RecordBatch.from_arrays(columns, names=OUT)


def _looked_up(data: list[bytes], rare: bool, model: tuple[np.ndarray, ...], total: int, distinct: int) -> tuple[np.ndarray, ...]:
    """(row, known, base, score) of packs of lookups; rare: of words, n-grams otherwise."""
    keys, n, v = model
    size = np.array([(len(x) - 8) // (KEY_BYTES + 4) for x in data])
    m = int(size.sum())
    key = np.zeros((m, 8), dtype=np.uint8)
    key[:, :KEY_BYTES] = np.frombuffer(b"".join(x[8 : 8 + KEY_BYTES * k] for x, k in zip(data, size.tolist(), strict=True)), np.uint8).reshape(-1, KEY_BYTES)
    key = key.view(np.uint64).ravel()
    step = np.frombuffer(b"".join(x[8 + KEY_BYTES * k :] for x, k in zip(data, size.tolist(), strict=True)), np.int32).astype(np.int64)
    begin = np.cumsum(size) - size
    change = step > 0
    change[begin] = True
    first = np.flatnonzero(change)
    start = np.array([np.frombuffer(x, np.int64, 1)[0] for x in data])
    far = np.cumsum(step)
    rows = (far + np.repeat(start - far[begin], size))[first]
    count, value = np.zeros(m), np.zeros(m)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        count, value = np.where(hit, n[at], 0), np.where(hit, v[at], 0.0)
    base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1))) if rare else np.zeros(m)
    return rows, *(np.add.reduceat(x.astype(np.float64), first) for x in ((count > 0) & rare, base, base + value))


def _sums(batches: Iterator[pa.RecordBatch], total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Documents, and what keys add to rows, summed up over all buckets of a task; a bucket's model comes first, its packs as they are read."""
    here, model, ready, rows = None, [], None, _Rows()
    for batch in batches:
        bucket, kind = (batch.column(k).to_numpy() for k in range(2))
        edges = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if bucket[a] != here:
                here, model, ready = bucket[a], [np.zeros((3, 0), dtype=np.int64)], None
            data = batch.column(2).slice(a, b - a)
            if kind[a] == 3:
                model += [np.frombuffer(x, np.int64).reshape(3, -1) for x in data.to_pylist()]
            elif kind[a] == 0:
                yield _documents(data.to_pylist())
            else:
                if ready is None:
                    key, v, n = np.concatenate(model, axis=1)
                    keys, back = np.unique(key.view(np.uint64), return_inverse=True)
                    ready, model = (keys, *(np.bincount(back, weights=x, minlength=len(keys)) for x in (n, v.view(np.float64)))), []
                for k in range(0, len(data), 1 << 11):
                    yield from rows.add(*_looked_up(data.slice(k, 1 << 11).to_pylist(), kind[a] == 1, ready, total, distinct))
        batch = data = None
        pa.default_memory_pool().release_unused()
    yield from rows.batches()


def _frequent(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    got = counts.where(F.col("n") >= least).toArrow()
    return got["key"].to_numpy().view(np.uint64), got["n"].to_numpy()


def fit(train: DataFrame, order: int = ORDER, word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE) -> tuple[Automaton, DataFrame]:
    """The automaton of a column of texts, and the counts (key, n) of all its words, written."""
    sc = train.sparkSession.sparkContext
    texts = train.select("text")
    counts = cut(texts.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = _frequent(counts, word_share * total)
    least = max(gram_share * total, 2)
    common = np.flatnonzero(words[1] >= least)
    numbered, shorter, grams = Lookup(words[0][common]), None, []
    for n in range(2, order + 1):
        shared = sc.broadcast((numbered, shorter))
        counted = texts.mapInArrow(lambda it, shared=shared, n=n: _count_grams(it, shared, n), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        keys, got = _frequent(counted, least)
        if not len(keys):
            break
        places = [keys >> np.uint64(BITS * (n - 1 - k)) & np.uint64((1 << BITS) - 1) for k in range(n)]
        grams.append((common[np.stack(places, axis=1).astype(np.int64)], got))
        shorter = Lookup(keys)
    return Automaton(total, distinct, words, grams), counts


def score(docs: DataFrame, order: int = ORDER, word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE, least: int = LEAST) -> DataFrame:
    """Learn from documents that aren't held out and score all, a row a document; the shares bound what a worker holds, not the model."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    total, distinct, table, filters = weights(docs.where(~F.col("held_out")), order, least)
    buckets = _buckets(total, LOOKED_UP)
    often = F.col("n") >= F.when(F.col("is_word"), word_share * total).otherwise(gram_share * total)
    with once(docs.sparkSession):
        held = thinned(table, table.where(often).select("key")).groupBy("key", "is_word").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where(often).toArrow()
    is_word, keys, n, v = (held[x].to_numpy() for x in ("is_word", "key", "n", "v"))
    is_word, keys = is_word.astype(bool), keys.view(np.uint64)
    base = np.log10((n[is_word] + 0.5) / (total + 0.5 * (distinct + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(keys[is_word]), base, v[is_word], Lookup(keys[~is_word]), v[~is_word], filters))
    packs = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lambda it: _score(it, shared, buckets), "bucket int, kind int, data binary")
    model = table.mapInArrow(lambda it: _model_packs(it, buckets), "bucket int, kind int, data binary")
    met = packs.unionAll(model).repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("kind").desc())
    sums = met.mapInArrow(lambda it: _sums(it, total, distinct), SCHEMA)
    by = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return by.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
