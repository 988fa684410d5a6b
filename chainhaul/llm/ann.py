"""Nearest neighbours by cosine with score-aware product quantisation.

Unit vectors are cut into subspaces of two dimensions with 16 codewords each.
Codewords and codes minimise an anisotropic loss: the residual along the
vector, which falsifies large inner products, weighs ``eta`` times as much as
the residual across.  A query makes a table of inner products with all
codewords; two subspaces' four-bit codes make one byte, so a scan adds one
table entry a byte.  The ``rerank`` best of a scan are scored exactly, in double
precision, on the original vectors; so is then each other vector that could
still be among the ``k`` nearest.  For the code y of a unit vector x, let y = g x
+ p with p across x.  A query of cosine s with x has an estimate of at least
g s - |p| sqrt(1 - s^2), so vectors whose estimate is below that, at the k-th
best s known, are out.  What is returned is therefore exact on all rows, such as
groups closer together than codewords are; only how many vectors are scored
exactly depends on them (all, at worst).

Queries in blocks meet all codes in blocks, with g, |p| and the vectors beside
them; each such task returns its ``k`` nearest, which merge by query.  Codebooks
come from at most about ``SAMPLE_ROWS`` vectors; every vector is indexed.

Rows and cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do vectors of another length than most of the
sample.  Rows that share a vec_id are rows of their own but never each other's
neighbour.  With fewer candidates than asked for, all are returned.  Ties go to
the smaller vec_id.  Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .store import cut
from .text import mix

SAMPLE_ROWS = 20_000
WIDTH = 2
CODES = 16
#: Weight of the parallel residual: inner products above about 0.4 of the norm matter.
ETA = 4.0
RERANK = 300
#: Queries that a block of the index is sent to at once, and those of them that are scanned together.
QUERY_BLOCK, TABLE_QUERIES = 2048, 256
#: Blocks of the index: as many tasks a query block has, more for more components in all.
INDEX_BLOCKS, INDEX_COMPONENTS = 12, 1 << 22
#: Rows of a block that are scanned together; of their pairs with queries, the share from which on one product scores all.
TILE, DENSE = 4096, 1 / 32


def usable(column: Column) -> Column:
    """Vectors of finite components, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return column.isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0)


class Codebook:
    """Codewords by subspace, and what encodes and scans with them."""

    def __init__(self, sample: np.ndarray, eta: float = ETA, rounds: int = 8, seed: int = 7):
        self.dim, self.eta = sample.shape[1], eta
        self.parts = -(-self.dim // (2 * WIDTH)) * 2  # an even number: two codes a byte
        x = self.cut(sample)
        rng = np.random.default_rng(seed)
        self.words = np.stack([x[rng.integers(0, len(x), CODES), m] + rng.normal(0, 1e-6, (CODES, WIDTH)) for m in range(self.parts)])
        codes = np.stack([((x[:, m, None] - self.words[m]) ** 2).sum(-1).argmin(1) for m in range(self.parts)], axis=1)
        for _ in range(rounds):
            codes = self._assign(x, codes)
            self._update(x, codes)

    def cut(self, unit: np.ndarray) -> np.ndarray:
        """Unit vectors by subspace, zeros at the end."""
        out = np.zeros((len(unit), self.parts * WIDTH))
        out[:, : self.dim] = unit
        return out.reshape(len(unit), self.parts, WIDTH)

    def _along(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each subspace's share of the residual along the vector."""
        return np.stack([((x[:, m] - self.words[m][codes[:, m]]) * x[:, m]).sum(-1) for m in range(self.parts)], axis=1)

    def _assign(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Coordinate descent: each subspace's best code, given the others'."""
        codes = codes.copy()
        along = self._along(x, codes)
        total = along.sum(1)
        for m in range(self.parts):
            r = x[:, m, None] - self.words[m]
            a = (r * x[:, m, None]).sum(-1)
            rest = (total - along[:, m])[:, None]
            codes[:, m] = ((r * r).sum(-1) + (self.eta - 1) * (rest + a) ** 2).argmin(1)
            new = a[np.arange(len(x)), codes[:, m]]
            total += new - along[:, m]
            along[:, m] = new
        return codes

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codewords that minimise the loss of their members, given the other subspaces."""
        along = self._along(x, codes)
        total = along.sum(1)
        for m in range(self.parts):
            u, rest = x[:, m], total - along[:, m]
            outer = u[:, :, None] * u[:, None, :]
            want = u + (self.eta - 1) * u * (rest + (u * u).sum(-1))[:, None]
            for k in range(CODES):
                own = codes[:, m] == k
                if own.any():
                    left = own.sum() * np.eye(WIDTH) + (self.eta - 1) * outer[own].sum(0)
                    self.words[m, k] = np.linalg.solve(left, want[own].sum(0))
            new = ((u - self.words[m][codes[:, m]]) * u).sum(-1)
            total += new - along[:, m]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of two codes each; what they stand for along the vector, and its length across."""
        x = self.cut(unit)
        codes = np.stack([((x[:, m, None] - self.words[m]) ** 2).sum(-1).argmin(1) for m in range(self.parts)], axis=1)
        for _ in range(2):
            codes = self._assign(x, codes)
        y = np.stack([self.words[m][codes[:, m]] for m in range(self.parts)], axis=1)
        along = (y * x).sum((1, 2))
        across = np.sqrt(((y - along[:, None, None] * x) ** 2).sum((1, 2)))
        turned = along <= 0  # no bound on these
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8), np.where(turned, 0, along), np.where(turned, 1e9, across)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """(byte position, 256, query): inner products of queries with the codewords of a byte."""
        one = np.einsum("qmw,mcw->mcq", self.cut(unit), self.words).astype(np.float32)
        low, high = one[::2], one[1::2]
        return (high[:, :, None] + low[:, None]).reshape(self.parts // 2, 256, len(unit))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(rows: np.ndarray) -> pa.Array:
    """One binary value a row."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


INDEX = "vec_id long, block int, code binary, along float, across float, vector binary"


def _encode(batches: Iterator[pa.RecordBatch], shared, blocks: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        x = matrix(batch.column(1))
        codes, along, across = shared.value.encode(unit_rows(x))
        block = (mix(batch.column(0).to_numpy().view(np.uint64)) + np.arange(len(x), dtype=np.uint64)) % np.uint64(blocks)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(block.astype(np.int32)), _packed(codes), pa.array(along.astype(np.float32)), pa.array(across.astype(np.float32)), _packed(x.astype(kind))], names=["vec_id", "block", "code", "along", "across", "vector"])


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def scan(left: pa.Table, right: pa.Table, book: Codebook, rerank: int, k: int, kind: str) -> pa.Table:
    """The ``k`` nearest of a block of the index for each query of a block: larger cosines first, ties to smaller ids."""
    out = []
    if len(left) and len(right):
        order = np.argsort(right["vec_id"].to_numpy(), kind="stable")
        ids, codes = right["vec_id"].to_numpy()[order], _unpacked(right["code"], "u1")[order]
        along, across = right["along"].to_numpy()[order], right["across"].to_numpy()[order]
        vectors = _unpacked(right["vector"], kind)[order]
        queries, asked = left["query_id"].to_numpy(), matrix(left["query"].combine_chunks())
        for a in range(0, len(queries), TABLE_QUERIES):
            out.append(_scan(queries[a : a + TABLE_QUERIES], asked[a : a + TABLE_QUERIES], ids, codes, along, across, vectors, book, rerank, k))
    return pa.concat_tables([FOUND.empty_table(), *out])


#: Pairs that a scan holds before it takes the nearest of them.
FINALISTS = 1 << 20
#: More than the rounding of a cosine from unit vectors.
ROUNDING = 1e-9


def _scan(queries, asked, ids, codes, along, across, vectors, book: Codebook, rerank: int, k: int) -> pa.Table:
    table, units = book.tables(unit_rows(asked)), unit_rows(asked)
    est = np.empty((len(queries), len(ids)), dtype=np.float32)
    for a in range(0, len(ids), TILE):
        part = np.zeros((len(ids[a : a + TILE]), len(queries)), dtype=np.float32)
        for m in range(codes.shape[1]):
            part += table[m, codes[a : a + TILE, m]]
        est[:, a : a + TILE] = part.T
    low, high = np.searchsorted(ids, queries), np.searchsorted(ids, queries, side="right")
    # the best of the estimates: their k-th best cosine bounds those of the k nearest from below
    least = np.full(len(queries), -2.0)
    for q, row in enumerate(est):
        row[low[q] : high[q]] = -np.inf
        best = np.argpartition(row, len(row) - rerank)[len(row) - rerank :] if len(row) > rerank else np.arange(len(row))
        best = best[row[best] > -np.inf]
        if len(best) >= k:
            least[q] = np.partition(unit_rows(vectors[best].astype(np.float64)) @ units[q], len(best) - k)[len(best) - k] - ROUNDING
    # all that can reach it
    reach = np.where(least > 0, np.sqrt(np.clip(1 - least * least, 0, 1)) + 1e-6, 1.0)
    slack = 1e-6 * (codes.shape[1] + 8)  # rounding of estimates
    side, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for a in range(0, len(ids), TILE):
        here = est[:, a : a + TILE]
        bound = np.outer(least, along[a : a + TILE]) - np.outer(reach, across[a : a + TILE]) - slack
        q, r = np.nonzero((here >= bound) & (here > -np.inf))
        x = unit_rows(vectors[a : a + TILE].astype(np.float64))
        if len(q) >= DENSE * here.size:
            cos = (units @ x.T)[q, r]
        else:
            cos = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", units[q[b : b + 65536]], x[r[b : b + 65536]]) for b in range(0, len(q), 65536))])
        near = cos >= least[q] - ROUNDING
        side, place, score = np.append(side, q[near]), np.append(place, r[near] + a), np.append(score, cos[near])
        if len(side) > FINALISTS:  # large groups of copies
            side, place, score = _first(side, place, score, asked, ids, vectors, k)
    side, place, score = _first(side, place, score, asked, ids, vectors, k)
    return pa.table([queries[side], ids[place], score], schema=FOUND)


def _first(side, place, score, asked, ids, vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` nearest of the pairs (side: query, place: vector), with exact scores; the given ones only rule out."""
    order = np.argsort(side, kind="stable")
    place, score = place[order], score[order]
    ends = np.cumsum(np.bincount(side, minlength=len(asked)))
    sides, places, scores = [side[:0]], [place[:0]], [score[:0]]
    for q, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        at = place[a:b]
        if b - a > k:
            at = at[score[a:b] >= np.partition(score[a:b], b - a - k)[b - a - k] - 2 * ROUNDING]
        if len(at):
            exact = cosine(asked[q : q + 1], vectors[at].astype(np.float64))
            best = np.lexsort((ids[at], -exact))[:k]
            sides.append(np.full(len(best), q))
            places.append(at[best])
            scores.append(exact[best])
    return np.concatenate(sides), np.concatenate(places), np.concatenate(scores)


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """In double precision, of vectors scaled by their largest component, which neither overflows nor vanishes."""
    q, x = (m / np.abs(m).max(axis=1, keepdims=True) for m in (q, x))
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def search(vectors: DataFrame, queries: Column, k: int = 5, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of (vec_id, embedding) that ``queries`` marks."""
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asked")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = good.count()
    share = min(1.0, sample_rows / max(1, rows))
    place = F.xxhash64("vec_id", "embedding", F.lit("ann"))
    sample = (good if share >= 1 else good.where(place < F.lit(int(-(2**63) + share * 2**64)))).select("embedding").toArrow()["embedding"].combine_chunks()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    sizes, n = np.unique(sample.value_lengths().to_numpy(), return_counts=True)
    dim = int(sizes[n.argmax()])
    sample = sample.filter(pa.array(sample.value_lengths().to_numpy() == dim))
    book = spark.sparkContext.broadcast(Codebook(unit_rows(matrix(sample))))
    good = good.where(F.size("embedding") == dim)
    blocks = max(INDEX_BLOCKS, -(-rows * dim // INDEX_COMPONENTS))
    kind = "f4" if isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "f8"
    index = cut(good.select("vec_id", "embedding").mapInArrow(lambda it: _encode(it, book, blocks, kind), INDEX))
    asked = good.where("asked").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    # every query block with every block of the index: the stated queries against all rows
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(lambda a, b: scan(a, b, book.value, rerank, k, kind), "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
