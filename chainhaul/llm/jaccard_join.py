"""Documents linked by the Jaccard similarity of their word n-grams.

The document by n-gram incidence matrix is multiplied by its transpose in
column blocks, sparsely.  Equal rows (documents with the same set) become one.
Columns are ordered from rare to frequent; the size of a row bounds which of
its first columns any partner must share (n - ceil(t n) + 1 of them), and only
those enter the product.  A block of columns holds rows in compressed form and
accumulates overlap counts of row pairs whose sizes fit.  A pair is dropped if
no column that it shares could be its first (the places of the column in both
rows leave too little), or if its count plus what the rest of either row can add
stays below the overlap that both sizes ask for, ceil(t (n1 + n2) / (1 + t));
the others are counted in full on their whole texts.

A column of up to ``DENSE`` rows gives its pairs.  The rows of a denser one meet
its lead only, the row with most frequent columns, and are counted in full
against it.  What a row x differs from a lead by, D(x), replaces it from there
on: |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, so two rows of a lead link at
once if their slacks, (1 - t) n - (1 + t) |D|, don't sum below zero, and
otherwise only if D(x) and D(y) share at least a number of elements that the
slacks give.  The first kind hangs on the row of most slack; the second comes
from a second product, over the first elements of D, of pairs that don't both
hang there.  So a group of m near copies costs m full counts, and no link
between components is lost.  The frequent columns are known by a bounded list
(``FREQUENT`` of them, from counters of bounded size), which shapes only the
order of columns, never the result; their rows are dealt out by row, so that no
task gets a frequent column as a whole.

Rows and cases: a null or empty text has no n-grams and links with nothing;
fewer words than n make one gram of the whole sequence.  Repeated rows fall
into one component, rows of one doc_id are one vertex, and a null doc_id has a
null component.  Extra columns are dropped.  A very long text is one row like
any other; a task holds the n-grams of one chunk of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .store import bitmap, cut, discard, marked, thinned
from .text import Chunk, Lookup, as_long, chunks, gram_hashes, mix, repeat_ranges

WORDS = 5
PERCENT = 80
DENSE = 8
FREQUENT = 1 << 21
FREQUENT_FROM = DENSE + 1
#: Columns are counted and listed by their grams without so many bits.
LISTED_BY = np.uint64(8)
#: A task holds so many entries before it writes blocks, and counts.
HELD, COUNTED = 1 << 20, 1 << 21
#: Entries of a column block; most shuffle partitions.
BLOCK, PARTITIONS = 2_000_000, 1 << 15
COLUMN_BITS = 48
#: Pairs or leads that are broadcast (up to 40 bytes each, after a count); bits of the filters of wanted sets.
FEW_PAIRS, KEY_BITS = 200_000, 1 << 23
#: Elements of a lead's rows that meet in one task; those of larger groups are dealt out by element.
GROUP = 1 << 20
#: Rows of a run of difference elements that one task pairs; longer runs are dealt out by pairs of their parts.
RUN = 2048


def gram_sets(c: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct grams of each row, sorted."""
    h, counts = c.word_hashes(lower=True), c.counts
    full = gram_hashes(h, words)
    own = np.maximum(counts - words + 1, 0)
    grams, rows = [full[repeat_ranges(c.woffs[:-1], own)]], [np.repeat(np.arange(c.rows), own)]
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        if len(short):
            grams.append(gram_hashes(h, n)[c.woffs[short]])
            rows.append(short)
    grams, rows = np.concatenate(grams), np.concatenate(rows)
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    keep = np.ones(len(grams), dtype=bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return rows[keep], grams[keep]


def set_keys(rows: np.ndarray, grams: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and key of each row's set; equal sets have equal keys."""
    offs = np.searchsorted(rows, np.arange(n_rows + 1))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams ^ np.uint64(0x51ED270B0A1F39C1)), dtype=np.uint64)])
        sums = total[offs[1:]] - total[offs[:-1]]
    n = np.diff(offs)
    return n, mix(sums + n.astype(np.uint64))


class Listed(Lookup):
    """Places of frequent grams, by what ``LISTED_BY`` leaves of them."""

    def find(self, h: np.ndarray) -> np.ndarray:
        return super().find(h >> LISTED_BY)


def _pack_counts(key: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys as the bytes of their steps, those of one place together, and the counts other than 1."""
    step = np.diff(key, prepend=key[:1])
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    more = np.flatnonzero(n > 1)
    head = np.array([len(key), width, len(more)], dtype=np.int64).tobytes() + key[:1].tobytes()
    return head + step.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() + more.astype(np.int32).tobytes() + n[more].astype(np.int64).tobytes()


def _unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, width, more = (int(x) for x in np.frombuffer(data, np.int64, 3))
    step = np.zeros((size, 8), dtype=np.uint8)
    step[:, :width] = np.frombuffer(data, np.uint8, size * width, 32).reshape(width, size).T
    n = np.ones(size, dtype=np.int64)
    at = 32 + size * width
    n[np.frombuffer(data, np.int32, more, at)] = np.frombuffer(data, np.int64, more, at + 4 * more)
    return np.frombuffer(data, np.uint64, 1, 24) + np.cumsum(step.view(np.uint64).ravel()), n


def _gram_packs(batches: Iterator[pa.RecordBatch], words: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """(block, packed counts) of all grams of this task, by ranges of keys; a gram counts once a document."""
    held, size = [], 0

    def written() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(key, _range_starts(blocks))
        full = np.flatnonzero(np.diff(edges, append=len(key)))
        ends = np.append(edges, len(key))
        out = [_pack_counts(key[ends[b] : ends[b + 1]], n[ends[b] : ends[b + 1]]) for b in full]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(out, pa.binary())], names=["block", "data"])

    for batch in batches:
        for c in chunks(batch.column(0)):
            held.append(gram_sets(c, words)[1] >> LISTED_BY)
            size += len(held[-1])
            if size >= COUNTED:
                yield written()
                held, size = [], 0
    if size:
        yield written()


def _range_starts(blocks: int) -> np.ndarray:
    return np.array([(b << 56) // blocks for b in range(blocks)], dtype=np.uint64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of grams in ``FREQUENT_FROM`` documents or more; a block's packs come one after the other."""
    block, parts = None, []

    def done() -> pa.RecordBatch:
        key, n = (np.concatenate([p[k] for p in parts]) for k in range(2))
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(n, first)
        often = n >= FREQUENT_FROM
        return pa.RecordBatch.from_arrays([pa.array(as_long(key[first[often]])), pa.array(n[often])], names=["key", "n"])

    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != block and parts:
                yield done()
                parts = []
            block = b
            parts.append(_unpack_counts(data.as_buffer().to_pybytes()))
    if parts:
        yield done()


def frequent_columns(texts: DataFrame, words: int, total: int) -> Listed:
    """The grams of most documents, at most ``FREQUENT`` of them, rarer ones first.

    All grams (``total`` of them, in all documents) are counted, so that the
    list doesn't depend on how documents are dealt out to tasks.
    """
    blocks = max(24, total // BLOCK)
    packs = texts.mapInArrow(lambda it: _gram_packs(it, words, blocks), "block int, data binary").repartition(min(blocks, PARTITIONS), "block").sortWithinPartitions("block")
    counts = cut(packs.mapInArrow(_gram_counts, "key long, n long"))
    levels = counts.groupBy(F.least("n", F.lit(1 << 12)).alias("n")).count().toArrow()
    n, rows = levels["n"].to_numpy(), levels["count"].to_numpy()
    order = np.argsort(-n)
    fits = int((np.cumsum(rows[order]) <= FREQUENT).sum())
    often = counts.where(F.col("n") >= int(n[order][fits - 1]) if fits else F.lit(False)).toArrow()
    discard(counts)
    by = np.lexsort((often["key"].to_numpy(), often["n"].to_numpy()))
    return Listed(often["key"].to_numpy().view(np.uint64)[by])


def _measure(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, n) of each document."""
    for batch in batches:
        for c in chunks(batch.column(1)):
            n, key = set_keys(*gram_sets(c, words), c.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), pa.array(as_long(key)), pa.array(n.astype(np.int64))], names=["doc_id", "key", "n"])


def _pack(block: int, node: np.ndarray, n: np.ndarray, col: np.ndarray, pos: np.ndarray) -> tuple[int, bytes]:
    """Rows of a block: per row its key, size and number of columns, then the columns and their places in the row."""
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    count = np.diff(np.concatenate([first, [len(node)]]))
    planes = col.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    head = np.array([len(first), len(col)], dtype=np.int64).tobytes()
    sizes = zlib.compress(n[first].astype(np.int32).tobytes() + count.astype(np.int32).tobytes() + pos.astype(np.int32).tobytes(), 1)
    return block, head + np.int64(len(sizes)).tobytes() + sizes + node[first].tobytes() + planes


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """(node, n, col, pos) of a pack's entries."""
    rows, cols, size = (int(x) for x in np.frombuffer(data, np.int64, 3))
    numbers = np.frombuffer(zlib.decompress(data[24 : 24 + size]), np.int32)
    at = 24 + size
    node = np.frombuffer(data, np.uint64, rows, at)
    col = np.zeros((cols, 8), dtype=np.uint8)
    col[:, :6] = np.frombuffer(data, np.uint8, cols * 6, at + 8 * rows).reshape(-1, 6)
    count = numbers[rows : 2 * rows]
    return np.repeat(node, count), np.repeat(numbers[:rows], count), col.view(np.uint64).ravel(), numbers[2 * rows :]


#: Columns from here on are those of the list of frequent ones.
LISTED = np.uint64(1 << (COLUMN_BITS - 1))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def prefix_columns(rows: np.ndarray, grams: np.ndarray, n: np.ndarray, frequent: Lookup, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, place in the row) of each row's first columns, as many as its size asks for."""
    place = frequent.find(grams)
    col = np.where(place >= 0, LISTED + place.astype(np.uint64), grams >> np.uint64(64 - COLUMN_BITS + 1))
    order = np.lexsort((col, rows))
    rows, col = rows[order], col[order]
    offs = np.concatenate([[0], np.cumsum(n)])
    most = prefix_size(n, percent)
    keep = repeat_ranges(offs[:-1], most)
    return rows[keep], col[keep], repeat_ranges(np.zeros(len(n), dtype=np.int64), most)


def _incidence(batches: Iterator[pa.RecordBatch], shared, words: int, percent: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Packed column blocks of the rows of this task; entries of listed columns go by row."""
    frequent, held, size = shared.value, [], 0

    def written() -> Iterator[pa.RecordBatch]:
        node, n, col, pos = (np.concatenate([x[k] for x in held]) for k in range(4))
        block = (np.where(col >= LISTED, mix(node ^ LISTED), mix(col)) % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((node, block))
        node, n, col, pos, block = node[order], n[order], col[order], pos[order], block[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        edges = np.concatenate([first, [len(block)]])
        out = [_pack(int(block[a]), node[a:b], n[a:b], col[a:b], pos[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["block", "data"])

    for batch in batches:
        for c in chunks(batch.column(0)):
            rows, grams = gram_sets(c, words)
            n, key = set_keys(rows, grams, c.rows)
            rows, col, pos = prefix_columns(rows, grams, n, frequent, percent)
            held.append((key[rows], n[rows].astype(np.int32), col, pos.astype(np.int32)))
            size += len(col)
            if size >= HELD:
                yield from written()
                held, size = [], 0
    if size:
        yield from written()


def _fit(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)


def multiply(node: np.ndarray, n: np.ndarray, col: np.ndarray, pos: np.ndarray, percent: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Of one column block: 0: counted pairs (a, b, n_a, n_b, count, able); 1: entries (column, row, n, place, listed columns of the row) of dense columns; 2: rows and their numbers of other columns that aren't theirs alone."""
    order = np.lexsort((node, col))
    node, n, col, pos = node[order], n[order].astype(np.int64), col[order], pos[order].astype(np.int64)
    keep = np.ones(len(col), dtype=bool)
    keep[1:] = (col[1:] != col[:-1]) | (node[1:] != node[:-1])
    node, n, col, pos = node[keep], n[keep], col[keep], pos[keep]
    first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]])) if len(col) else np.zeros(0, dtype=np.int64)
    m = np.diff(np.concatenate([first, [len(col)]]))
    m = np.repeat(m, m)
    listed = col >= LISTED
    few = np.flatnonzero((m > 1) & (m <= DENSE) & ~listed)
    fn, fs, fc, left = node[few], n[few], col[few], (n - pos)[few]
    pairs = []
    for k in range(1, DENSE):
        at = np.flatnonzero((fc[k:] == fc[:-k]) & _fit(fs[k:], fs[:-k], percent)) if len(fc) > k else []
        if len(at):
            # the rows' overlap, if this is the first column they share, is at most what either has left
            able = np.minimum(left[at], left[at + k]) * (100 + percent) >= percent * (fs[at] + fs[at + k])
            pairs.append((fn[at], fn[at + k], fs[at], fs[at + k], able))
    if pairs:
        yield 0, _counted(*(np.concatenate([p[k] for p in pairs]) for k in range(5)))
    if len(few):
        row, count = np.unique(fn, return_counts=True)
        yield 2, (row, count)
    many = np.flatnonzero((m > DENSE) | listed)
    if len(many):
        row, back = np.unique(node[many], return_inverse=True)
        own = np.bincount(back, weights=listed[many])[back].astype(np.int64)
        yield 1, (col[many], node[many], n[many], pos[many], own)


def _counted(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, able: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], na[first], nb[first], np.diff(np.concatenate([first, [len(a)]])), np.maximum.reduceat(able[order].astype(np.int64), first)


def _product(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The product of each block; a block's rows come one after the other."""
    names = ["kind", "a", "b", "na", "nb", "count", "able"]

    def done(parts: list) -> Iterator[pa.RecordBatch]:
        for kind, found in multiply(*(np.concatenate([p[k] for p in parts]) for k in range(4)), percent):
            if kind == 1:
                col, node, n, pos, own = found
                columns = [as_long(col), as_long(node), n, pos, own, np.ones(len(n), dtype=np.int64)]
            elif kind == 2:
                columns = [as_long(found[0]), *(found[1] for _ in range(5))]
            else:
                a, b, na, nb, count, able = found
                columns = [as_long(a), as_long(b), na, nb, count, able]
            for k in range(0, len(columns[0]), 1 << 17):
                part = [np.ascontiguousarray(x[k : k + (1 << 17)]) for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, dtype=np.int32)), *map(pa.array, part)], names=names)

    block, parts = None, []
    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != block and parts:
                yield from done(parts)
                parts = []
            block = b
            parts.append(_unpack(data.as_buffer().to_pybytes()))
    if parts:
        yield from done(parts)


def _sets(column: pa.Array, words: int) -> list[np.ndarray]:
    out = []
    for c in chunks(column):
        rows, grams = gram_sets(c, words)
        out += np.split(grams, np.searchsorted(rows, np.arange(1, c.rows)))
    return out


def _verify(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of texts whose sets are similar enough, counted in full."""
    for batch in batches:
        keep = []
        for x, y in zip(_sets(batch.column(2), words), _sets(batch.column(3), words), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _most_slack(slack: int, n: int, percent: int) -> int:
    """Of a partner of a row: it is no larger than sizes allow, and no nearer to the lead than what both may differ by."""
    own = (100 - percent) * (n * 100 // percent)
    return min(own, slack + 2 * own)


def _differ(batches: Iterator[pa.RecordBatch], shared, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(x, lead, slack of x, slack of the lead, d, most slack of a partner, first elements of D(x)) of pairs of a row and its lead.

    Elements come in one order for all rows of a lead: those of x, then those
    of the lead that x lacks, frequent ones first there: what the lead alone
    has is in every D.
    """
    frequent, up, down = shared.value, 100 - percent, 100 + percent
    for batch in batches:
        slack, own, size, bound, elements = [], [], [], [], []
        for x, y in zip(_sets(batch.column(2), words), _sets(batch.column(3), words), strict=True):
            plus, minus = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
            d, p, m = len(plus) + len(minus), frequent.find(plus), frequent.find(minus)
            s = up * len(x) - down * d
            bound.append(_most_slack(s, len(x), percent))
            k = max(1, -((s + bound[-1]) // (2 * down)))
            plus, minus = plus[np.lexsort((plus, p))], minus[np.lexsort((minus, m, m < 0))]
            slack.append(s)
            own.append(up * len(y))
            size.append(d)
            elements.append(np.concatenate([plus, minus])[: max(0, d - k + 1)])
        offs = np.concatenate([[0], np.cumsum([len(e) for e in elements])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(as_long(np.concatenate(elements) if elements else np.zeros(0, dtype=np.uint64))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (slack, own, size, bound)), lists], names=["x", "lead", "slack", "own", "d", "bound", "elements"])


def _paired(run: np.ndarray, x: np.ndarray, slack: np.ndarray, left: np.ndarray, hangs: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """(a, b) of rows that may link by an element both differ from their lead by; run: numbers of (lead, element), ascending.

    Two rows that hang on the lead's best aren't paired, nor those of one side
    of a cell of two parts.
    """
    down = 2 * (100 + percent)
    if not len(run):
        return np.zeros((0, 2), dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    own = np.diff(np.concatenate([first, [len(run)]]))
    own = np.repeat((own > 1) & ~np.logical_and.reduceat(hangs, first), own)
    run, x, slack, left, hangs = run[own], x[own], slack[own], left[own], hangs[own]
    side = None if side is None else side[own]
    out, k, at = [np.zeros((0, 2), dtype=np.int64)], 1, np.arange(max(0, len(run) - 1))
    while len(at):
        at = at[at + k < len(run)]
        at = at[run[at] == run[at + k]]
        y = at + k
        total = slack[at] + slack[y]
        ok = (total < 0) & ~(hangs[at] & hangs[y]) & (np.minimum(left[at], left[y]) >= np.maximum(1, -(total // down))) & (x[at] != x[y])
        if side is not None:
            ok &= (side[at] != side[y]) | (side[at] < 0)
        one, two = x[at[ok]], x[y[ok]]
        out.append(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1))
        if len(out) > 64:
            out = [np.unique(np.concatenate(out), axis=0)]
        k += 1
    return np.unique(np.concatenate(out), axis=0)


def _pair_batch(both: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in range(2)], names=["a", "b"])


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """The rows in tables of about ``most``, none of which ends inside a run of equal keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            same = np.zeros(len(t), dtype=bool)
            for k in keys:
                column = t[k].to_numpy()
                same |= column != column[-1]
            same = np.flatnonzero(same)
            whole = int(same[-1]) + 1 if len(same) else 0  # the last run may go on
            if whole:
                yield t.slice(0, whole).combine_chunks()
            held, size = t.slice(whole).combine_chunks().to_batches(), len(t) - whole
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of large groups; rows come an element each, sorted by lead, element and cell."""
    for t in _whole_runs(batches, ["lead", "element", "cell"], 1 << 17):
        lead, element, cell, side, x, slack, left, hangs = (t[k].to_numpy() for k in ("lead", "element", "cell", "side", "x", "slack", "left", "hangs"))
        run = np.cumsum(np.concatenate([[True], (lead[1:] != lead[:-1]) | (element[1:] != element[:-1]) | (cell[1:] != cell[:-1])]))
        yield _pair_batch(_paired(run, x, slack, left, hangs, side, percent))


def _meet_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of groups of bounded size; rows come whole, sorted by lead."""
    for t in _whole_runs(batches, ["lead"], 1 << 9):
        size = t["elements"].combine_chunks().value_lengths().to_numpy()
        element = t["elements"].combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(len(t)), size)
        left = t["d"].to_numpy()[row] - repeat_ranges(np.zeros(len(t), dtype=np.int64), size.astype(np.int64))
        lead = t["lead"].to_numpy()[row]
        order = np.lexsort((element, lead))
        lead, element, row, left = lead[order], element[order], row[order], left[order]
        run = np.cumsum(np.concatenate([[True], (lead[1:] != lead[:-1]) | (element[1:] != element[:-1])])) if len(row) else row
        x, slack, hangs = (t[k].to_numpy()[row] for k in ("x", "slack", "hangs"))
        yield _pair_batch(_paired(run, x, slack, left, hangs, None, percent))


def _enough(count: Column, percent: int) -> Column:
    """Whether a pair's overlap, what is counted and all that the rest of either row can add, may do."""
    rest = F.greatest(F.floor(F.col("na") * percent / 100), F.floor(F.col("nb") * percent / 100))
    return (count + rest) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _with_texts(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (a, b) with both texts; few pairs (a checked number) are brought to the first texts, more meet them by a shuffle."""
    first, second = (thinned(texts, pairs.select(c).distinct()) for c in (a, b))
    few = F.broadcast(pairs.select(a, b)) if pairs.count() <= FEW_PAIRS else pairs.select(a, b)
    both = first.select(F.col("key").alias(a), F.col("text").alias("ta")).join(few, a).join(second.select(F.col("key").alias(b), F.col("text").alias("tb")), b)
    return both.select(a, b, "ta", "tb")


def _keyed(batches: Iterator[pa.RecordBatch], shared, words: int) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, text) of the rows whose doc_id and key are wanted, and a few others by chance."""
    ids, keys = shared.value
    for batch in batches:
        own = batch.filter(pa.array(marked(ids, batch.column(0).to_numpy().view(np.uint64))))
        for c in chunks(own.column(1)):
            part = own.slice(c.first, c.rows)
            _, key = set_keys(*gram_sets(c, words), c.rows)
            part = pa.RecordBatch.from_arrays([pa.array(as_long(key)), *part.columns], names=["key", "doc_id", "text"])
            yield part.filter(pa.array(marked(keys, key)))


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (key, doc_id, text) that are in wanted (id, key); few of those (a checked number) are broadcast."""
    near = F.broadcast(wanted) if wanted.count() <= FEW_PAIRS else wanted
    return texts.join(near.select(F.col("id"), F.col("key").alias("k")), (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("id")), "left_semi")


def _leads(dense: DataFrame, percent: int) -> DataFrame:
    """(x, lead): rows of dense columns that may have a partner there, with one of the column's rows that may have one of their size.

    dense: (col, key, n, pos, own, cap); cap: how many columns of the row may
    be another's.  Of a pair the smaller row (or either, if equal) could meet
    another of its size.  A smaller partner is in the row's class of sizes or
    the one below: a class spans more than the sizes of a pair may differ by.
    """
    base = max(1.05, 100 / percent * 1.0001) if percent else 2.0
    dense = dense.withColumn("class", F.least(F.floor(F.log(base, F.col("n"))), F.lit(62)).cast("int"))
    dense = dense.withColumn("most", F.least("cap", F.col("n") - F.col("pos"))).withColumn("able", F.col("most") * (100 + percent) >= 2 * percent * F.col("n"))
    lead = F.max(F.struct("able", "own", F.xxhash64("key").alias("spread"), "key"))
    stats = dense.groupBy("col").agg(lead.alias("lead"), F.min(F.when(F.col("able"), F.col("n"))).alias("least"), F.bit_or(F.expr("if(able, shiftleft(1L, class), 0L)")).alias("classes"), F.count("*").alias("rows"))
    stats = cut(stats.where("rows > 1 and lead.able").select(F.col("col").alias("c"), F.col("lead.key").alias("lead"), "least", "classes"))
    met = dense.join(stats, F.col("col") == F.col("c"))
    near = F.expr("(classes & (shiftleft(1L, class) | shiftleft(1L, greatest(class - 1, 0)))) <> 0")
    smaller = near & (F.col("least") <= F.col("n")) & (F.col("most") * (100 + percent) >= (F.col("n") + F.greatest("least", F.ceil(F.col("n") * percent / 100))) * percent)
    return met.where((F.col("able") | smaller) & (F.col("key") != F.col("lead"))).select(F.col("key").alias("x"), "lead").distinct()


def _candidates(differ: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) that link for sure, and (a, b) that may, of rows and what they differ from their leads by."""
    down = 2 * (100 + percent)
    best = F.max(F.struct("slack", F.xxhash64("x").alias("spread"), "x"))
    hubs = differ.groupBy("lead").agg(best.alias("best"), F.max("own").alias("top"), F.min("slack").alias("low"), F.count("*").alias("rows"), F.sum(F.size("elements")).alias("sum"))
    lead_is = F.col("top") >= F.col("best.slack")
    hubs = cut(hubs.select(F.col("lead").alias("l"), F.when(lead_is, F.col("lead")).otherwise(F.col("best.x")).alias("hub"), F.greatest("top", "best.slack").alias("most"), F.col("best.slack").alias("next"), "low", "rows", "sum"))
    near = F.broadcast(hubs) if hubs.count() <= FEW_PAIRS else hubs
    rows = differ.join(near, F.col("lead") == F.col("l")).withColumn("hangs", F.col("slack") + F.col("most") >= 0)
    sure = rows.where("hangs").select(F.col("x").alias("a"), F.col("hub").alias("b")).unionByName(rows.where(F.col("slack") + F.col("own") >= 0).select(F.col("x").alias("a"), F.col("lead").alias("b"))).where("a <> b").distinct()
    # partners of a row that hangs are those that don't; of others, all rows but the lead
    other = F.least("bound", F.when(F.col("hangs"), -F.col("most") - 1).otherwise(F.col("next")))
    need = F.greatest(F.lit(1), F.ceil(-(F.col("slack") + other) / down)).cast("int")
    rows = rows.where((F.col("low") + F.col("most") < 0) & (F.col("rows") > 1)).withColumn("need", need).where("need <= d")
    rows = rows.select("lead", "x", "slack", "d", "hangs", "sum", F.slice("elements", F.lit(1), (F.col("d") - F.col("need") + 1).cast("int")).alias("elements"))
    small = rows.where(F.col("sum") <= GROUP).select("lead", "x", "slack", "d", "hangs", "elements").repartition("lead").sortWithinPartitions("lead")
    small = small.mapInArrow(lambda it: _meet_groups(it, percent), "a long, b long")
    if hubs.where(F.col("sum") > GROUP).isEmpty():
        return sure, small.distinct()
    large = rows.where(F.col("sum") > GROUP).select("lead", "x", "slack", "d", "hangs", F.posexplode("elements").alias("pos", "element"))
    large = large.select("lead", "element", "x", "slack", (F.col("d") - F.col("pos")).cast("long").alias("left"), "hangs")
    # a run without a row that doesn't hang has no pair; long runs go in cells, each two of their parts
    runs = large.groupBy("lead", "element").agg(F.count("*").alias("m"), F.min("hangs").alias("all")).where("m > 1 and not all")
    runs = runs.select(F.col("lead").alias("l"), F.col("element").alias("e"), F.ceil(F.col("m") / RUN).cast("int").alias("parts"))
    met = large.join(runs, (F.col("lead") == F.col("l")) & (F.col("element") == F.col("e")))
    part = F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")
    met = met.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    met = met.select("lead", "element", (low * F.col("parts") + high).alias("cell"), F.when(low == high, -1).otherwise((F.col("part") == high).cast("int")).alias("side"), "x", "slack", "left", "hangs")
    met = met.repartition("lead", "element", "cell").sortWithinPartitions("lead", "element", "cell").mapInArrow(lambda it: _meet(it, percent), "a long, b long")
    return sure, small.unionByName(met).distinct()


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # 1. sizes and keys of rows; frequent columns
    known = docs.where("doc_id is not null")
    rows = cut(known.mapInArrow(lambda it: _measure(it, words), "doc_id long, key long, n long"))
    ids = cut(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("id")))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = sc.broadcast(frequent_columns(known.select("text"), words, total))
    # 2. the product of the first columns, block by block
    blocks = max(24, total * (100 - percent) // 100 // BLOCK)
    packed = known.select("text").mapInArrow(lambda it: _incidence(it, frequent, words, percent, blocks), "block int, data binary")
    product = cut(packed.repartition(min(blocks, PARTITIONS), "block").sortWithinPartitions("block").mapInArrow(lambda it: _product(it, percent), "kind int, a long, b long, na long, nb long, count long, able long"))
    pairs = product.where("kind = 0").groupBy("a", "b", "na", "nb").agg(F.sum("count").alias("count"), F.max("able").alias("able")).where("able = 1")
    # of a row's first columns, those that aren't its own alone; no pair shares more of them than either has
    dense = product.where("kind = 1").select(F.col("a").alias("col"), F.col("b").alias("key"), F.col("na").alias("n"), F.col("nb").alias("pos"), F.col("count").alias("own"))
    common = product.where("kind > 0").groupBy(F.when(F.col("kind") == 1, F.col("b")).otherwise(F.col("a")).alias("k")).agg(F.sum(F.when(F.col("kind") == 1, 1).otherwise(F.col("count"))).alias("common"), F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("more"))
    common = cut(common)
    more = common.where("more > 0")
    pairs = pairs.join(more.select(F.col("k").alias("x"), F.col("more").alias("ma")), F.col("a") == F.col("x"), "left").join(more.select(F.col("k").alias("y"), F.col("more").alias("mb")), F.col("b") == F.col("y"), "left")
    most = F.col("count") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))
    pairs = cut(pairs.where(_enough(most, percent)).select("a", "b"))
    rest = F.floor(F.col("n") * percent / 100)
    rest = F.when(F.col("n") * percent % 100 == 0, rest - 1).otherwise(rest)
    leads = cut(_leads(dense.join(more, F.col("key") == F.col("k")).withColumn("cap", rest + F.col("common")), percent))
    discard(product)
    # 3. the texts of rows to be counted in full, one a set
    ends = [pairs.select(F.col("a").alias("k")), pairs.select("b"), leads.select("x"), leads.select("lead")]
    wanted = ends[0]
    for end in ends[1:]:
        wanted = wanted.union(end)
    wanted = cut(ids.join(wanted.distinct(), F.col("key") == F.col("k")).select("id", "key"))
    # (once the filters' chance hits, other copies of a wanted set among them, are gone, only rows that share a doc_id can give a text twice)
    again = cut(rows.where("n > 0").groupBy(F.col("doc_id").alias("d")).agg(F.count("*").alias("m"), F.min("key").alias("a"), F.max("key").alias("b")).where("m > 1"))
    filters = sc.broadcast((bitmap(wanted.select("id"), KEY_BITS), bitmap(wanted.select("key"), KEY_BITS)))
    texts = _only(known.mapInArrow(lambda it: _keyed(it, filters, words), "key long, doc_id long, text string"), wanted)
    if not again.isEmpty():
        once = texts.join(again.select("d"), F.col("doc_id") == F.col("d"), "left_anti")
        texts = once.unionByName(texts.join(again.select("d"), F.col("doc_id") == F.col("d"), "left_semi").dropDuplicates(["key"]))
    texts = cut(texts.select("key", "text"))
    filters.unpersist()
    # 4. rows against leads, then pairs
    differ = cut(_with_texts(leads, texts, "x", "lead").mapInArrow(lambda it: _differ(it, frequent, words, percent), "x long, lead long, slack long, own long, d long, bound long, elements array<long>"))
    sure, may = _candidates(differ, percent)
    pairs, sure = cut(pairs.unionByName(may).distinct()), cut(sure)
    discard(differ)
    found = cut(_with_texts(pairs, texts, "a", "b").mapInArrow(lambda it: _verify(it, words, percent), "a long, b long").unionByName(sure))
    frequent.unpersist()
    discard(texts)
    # 5. components of documents; sets that rows of one doc_id have are linked by it
    twice = again.where("a <> b").select("d", "a")
    found = found.unionByName(rows.where("n > 0").join(twice, F.col("doc_id") == F.col("d")).select("a", F.col("key").alias("b")).where("a <> b"))
    found = found.join(ids.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("y")), "b")
    comp = components(found.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("k"), "component")
    classes = ids.join(comp, F.col("id") == F.col("k"), "left").select(F.col("key").alias("set"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.join(classes, (F.col("key") == F.col("set")) & (F.col("n") > 0), "left")
    same = linked.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return same.unionByName(_nameless(docs, words))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of least doc_id; all columns.

    Documents without words are in no component and stay, as do those without
    a doc_id; of rows that share a doc_id the one of least text stays (of equal
    texts, that of least other columns).
    """
    linked = link(docs.where("doc_id is not null"), words, percent)
    kept = cut(linked.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows")))
    named = docs.join(kept, F.col("doc_id") == F.col("__kept"))
    once = named.where(F.col("__rows") == 1).select(*map(_name, docs.columns))
    order = Window.partitionBy("doc_id").orderBy(F.col("text").isNull(), "text", F.xxhash64(*(F.col(_quoted(c)) for c in docs.columns if c not in ("doc_id", "text"))))
    first = named.where(F.col("__rows") > 1).withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") == 1).select(*map(_name, docs.columns))
    return once.unionByName(first).unionByName(docs.where("doc_id is null"))


def _quoted(name: str) -> str:
    return f"`{name}`"


def _name(name: str) -> Column:
    return F.col(_quoted(name))


def _nameless(docs: DataFrame, words: int) -> DataFrame:
    """Documents without an id: sizes only."""
    measured = docs.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _measure(it, words), "doc_id long, key long, n long")
    return measured.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
