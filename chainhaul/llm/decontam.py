"""Benchmark decontamination by template canonicalisation.

Numbers, units and names give way to typed placeholders, so a question asked
again with other values has the same template.  Windows of ``WINDOW`` template
tokens of documents and benchmark items meet in a hash join.  Matching windows
are judged by occurrence: those of one document and item whose offset between
both texts is the same, those whose offsets lie close (``SPANS``; words were put
in or left out), and those of the whole document.  A document leaks an item if,
in any occurrence, matching windows cover at least ``SHARE`` of the item's
windows and its slots are consistent: each value of the item stands for one
value of the document.  Windows with unchanged values that cover as much suffice
too, wherever they stand.

Only windows that can match leave the text scan: a bitmap of fixed size
(``BITMAP_BITS``) holds the hashes of the benchmark's windows; what it lets
through by chance the join drops.

Canonical tokens, from words without punctuation at their ends, in small letters:
a number has a digit and otherwise only digits and ``.,:/%+-``; a unit is one
of ``UNITS`` after a number; a name begins with a capital, is not the first
word of its text, line or sentence, and has a small letter.  Windows need
``LITERALS`` tokens that are no placeholders, shorter items (all tokens in one
window) too.

Rows and cases: null or empty texts match nothing; items with fewer literal
tokens have no window.  Repeated rows are judged alike, repeated items are
separate.  Rows without a doc_id are judged by ``clean`` like others.  Extra
columns are dropped by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import _PUNCT
from .store import cut
from .text import Chunk, as_long, chunks, gram_hashes, mix

WINDOW = 8
LITERALS = 4
SHARE = 0.5
#: Offsets that differ by no more than one of these are also judged as one occurrence.
SPANS = (8, 64)
BITMAP_BITS = 1 << 24
#: The units that are told apart from other words.
UNITS = ("mm cm m km in ft yd mi inch inches foot feet mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent degree degrees mph kmh").split()

_NUMERIC = np.zeros(256, dtype=bool)
_NUMERIC[[*range(48, 58), *b".,:/%+-"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".!?:;")] = True
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1D8E4E27C47D124F, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85))


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.concatenate([c.word_hashes(lower=True) for c in chunks(pa.array([" ".join(words)]))])


_UNIT_HASHES = np.sort(_word_hashes(UNITS))


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with accented capitals of Latin-1 made small, and a mask of small letters in the given bytes."""
    second = np.zeros(len(data), dtype=bool)
    second[1:] = data[:-1] == 0xC3
    capital = second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    return np.where(capital, data + 0x20, data).astype(np.uint8), _SMALL[data] | second & (data >= 0xA0)


def canonical(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(template, value) hashes of each word; they differ where a placeholder stands."""
    start, end = c.start.copy(), c.end.copy()
    given, (plain, small) = c, folded(c.data)
    c = Chunk(c.first, plain, c.offs)
    todo = np.arange(len(end))
    while len(todo := todo[_PUNCT[c.data[end[todo] - 1]] & (end[todo] - start[todo] > 1)]):
        end[todo] -= 1
    todo = np.arange(len(start))
    while len(todo := todo[_PUNCT[c.data[start[todo]]] & (end[todo] - start[todo] > 1)]):
        start[todo] += 1
    value = c.range_hash(c.prefix(lower=True), start, end)
    template = value.copy()
    if not len(start):
        return template, value
    first = given.data[start]
    # names: the word before must be of the same row and line and end no sentence
    capital = np.flatnonzero((first >= 65) & (first <= 90) | (first == 0xC3))
    capital = capital[(first[capital] != 0xC3) | (given.data[np.minimum(start[capital] + 1, len(c.data) - 1)] < 0x9F)]
    begins = np.zeros(len(start), dtype=bool)
    begins[c.woffs[:-1][c.counts > 0]] = True
    capital = capital[~begins[capital]]
    if len(capital):
        lines = np.concatenate([[0], np.cumsum(c.data == 10)])
        small = np.concatenate([[0], np.cumsum(small)])
        ok = ~_STOPS[c.data[c.end[capital - 1] - 1]] & (lines[start[capital]] == lines[c.end[capital - 1]]) & (small[end[capital]] > small[start[capital] + 1])
        template[capital[ok]] = NAME
    digits = np.flatnonzero(_DIGIT[first] | _NUMERIC[first])
    if len(digits):
        inside = np.concatenate([[0], np.cumsum(_NUMERIC[c.data])])
        has = np.concatenate([[0], np.cumsum(_DIGIT[c.data])])
        s, e = start[digits], end[digits]
        number = digits[(inside[e] - inside[s] == e - s) & (has[e] > has[s])]
        template[number] = NUMBER
        after = number + 1
        after = after[after < len(start)]
        after = after[~begins[after]]
        unit = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, value[after]), len(_UNIT_HASHES) - 1)] == value[after]
        template[after[unit]] = UNIT
    return template, value


def windows(c: Chunk, sizes: list[int], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(hashes, places, template, value, size) of the windows of each size; whole: shorter ones only as a row's all."""
    template, value = canonical(c)
    slots = np.concatenate([[0], np.cumsum(template != value)])
    for size in sizes:
        h = gram_hashes(template, size)
        if not len(h):
            continue
        row = np.repeat(np.arange(c.rows), c.counts)[: len(h)]
        at = np.arange(len(h))
        ok = (at + size <= c.woffs[1:][row]) & (size - (slots[size:] - slots[:-size]) >= LITERALS)
        if whole and size < WINDOW:
            ok &= c.counts[row] == size
        at = at[ok]
        yield h[at], at, template, value, size


def _rows(c: Chunk, found: tuple, ids: pa.Array) -> pa.RecordBatch:
    h, at, template, value, size = found
    row = np.searchsorted(c.woffs, at, "right") - 1
    slot = (template != value)[at[:, None] + np.arange(size)] if len(at) else np.zeros((0, size), dtype=bool)
    flat = value[at[:, None] + np.arange(size)][slot] if len(at) else value[:0]
    offs = np.concatenate([[0], np.cumsum(slot.sum(axis=1))]).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(c.first + row)), pa.array(as_long(h)), pa.array((at - c.woffs[row]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offs), pa.array(as_long(flat)))], names=["id", "hash", "at", "slots"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(1)):
            for found in windows(c, list(range(LITERALS, WINDOW + 1)), whole=True):
                out = _rows(c, found, batch.column(0))
                yield out.append_column("size", pa.array(np.full(len(out), found[-1], dtype=np.int32)))


def _doc_windows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    bits, sizes = shared.value
    for batch in batches:
        for c in chunks(batch.column(1)):
            for h, at, template, value, size in windows(c, sizes, whole=False):
                place = (mix(h) % np.uint64(BITMAP_BITS)).astype(np.int64)
                hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                if hit.any():
                    yield _rows(c, (h[hit], at[hit], template, value, size), batch.column(0))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = (mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(BITMAP_BITS)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(place))], names=["place"])


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, item_id, matched, verbatim, windows, agreed) of the items whose windows meet a document's; docs: (id, text).

    matched and verbatim count windows of the whole document, agreed those of
    the consistent occurrence that has most.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.struct("item_id", F.monotonically_increasing_id().alias("nth")))
    known = cut(items.select(F.col("item.nth").alias("id"), "text").mapInArrow(_item_windows, "id long, hash long, at int, slots array<long>, size int"))
    names = cut(items.select("item.nth", "item_id"))
    places = known.select("hash").mapInArrow(_places, "place long").distinct().toArrow()["place"].to_numpy()  # at most BITMAP_BITS of them
    bits = np.zeros(BITMAP_BITS >> 3, dtype=np.uint8)
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    sizes = sorted(r.size for r in known.select("size").distinct().collect())  # WINDOW sizes at most
    shared = docs.sparkSession.sparkContext.broadcast((bits, sizes))
    seen = docs.mapInArrow(lambda it: _doc_windows(it, shared), "id long, hash long, at int, slots array<long>")
    total = known.groupBy(F.col("id").alias("of")).agg(F.count("*").alias("windows"))
    other = known.select(F.col("id").alias("nth"), F.col("hash").alias("h"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    met = seen.join(other, F.col("hash") == F.col("h")).select("id", "nth", "item_at", (F.col("at") - F.col("item_at")).alias("offset"), (F.col("item_slots") == F.col("slots")).alias("same"), F.arrays_zip("item_slots", "slots").alias("pairs"))
    met = cut(met)
    spot = lambda span, place: F.struct(F.lit(span).alias("span"), place.cast("long").alias("place"))
    near = [spot(n, F.floor(F.col("offset") / n) - k) for n in SPANS for k in (0, 1)]
    spots = met.withColumn("spot", F.explode(F.array(spot(1, F.col("offset")), *near, spot(0, F.lit(0))))).select("id", "nth", "item_at", "same", "pairs", "spot.*")
    key = ["id", "nth", "span", "place"]
    matched = spots.groupBy(*key).agg(F.count_distinct("item_at").alias("matched"), F.count_distinct(F.when(F.col("same"), F.col("item_at"))).alias("verbatim"))
    pairs = spots.select(*key, F.explode("pairs").alias("p")).distinct()
    # an item's value with two values of an occurrence: a clash; each place's windows vote by distinct pairs
    clash = pairs.groupBy(*key, "p.item_slots").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("most"))
    agreed = F.when(F.coalesce("most", F.lit(1)) == 1, F.col("matched")).otherwise(0)
    judged = matched.join(clash, key, "left").groupBy("id", "nth").agg(F.max("matched").alias("matched"), F.max("verbatim").alias("verbatim"), F.max(agreed).alias("agreed"))
    out = judged.join(total, F.col("nth") == F.col("of")).join(names, "nth")
    return out.select("id", "item_id", "matched", "verbatim", "windows", "agreed")


def _leaking(matches: DataFrame, share: float) -> DataFrame:
    enough = F.col("windows") * share
    return matches.where((F.col("verbatim") >= enough) | (F.col("agreed") >= enough))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, matched, windows): one row for each leaked item of a document."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    return _leaking(_matches(docs, benchmark), share).select(F.col("id").alias("doc_id"), "item_id", "matched", "windows")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that leak no item, all columns."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    bad = cut(_leaking(_matches(docs.select(key.alias("id"), "text"), benchmark), share).select(F.col("id").alias("__leaking")).distinct())
    return docs.join(bad, key == F.col("__leaking"), "left_anti")
