"""Tables written to the shared checkpoint folder, to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import mix


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="chainhaul-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written now: whole, shared, kept when executors go.

    What was shuffled to make it goes, as do broadcasts once the driver has
    collected its garbage, which is asked for here.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    with once(spark):
        df.write.option("compression", "zstd").parquet(path)
    del df
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


#: The setting by which Spark removes shuffle files at the end of the execution that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def once(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here is run once only, and its shuffle files go as soon as it ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def discard(table: DataFrame) -> None:
    """Remove a table that ``cut`` wrote and nothing reads any more."""
    path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Ids up to this number are broadcast; bits of the filter that thins out rows before a shuffle otherwise.
FEW_IDS, FILTER_BITS = 20_000, 1 << 22


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the 64-bit keys in the first column; at most bits / 64 rows reach the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> 6).astype(np.int32)), pa.array((np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    with once(keys.sparkSession):
        got = keys.mapInArrow(words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits >> 6, dtype=np.int64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return table.view(np.uint8)


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a bitmap may hold: all that it does, others by chance."""
    place = (mix(keys) % np.uint64(len(table) << 3)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def thinned(rows: DataFrame, keys: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """The rows of (key, ...) whose key is among the keys of a one-column table, and a few others by chance."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys, bits))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(shared.value, batch.column(0).to_numpy().view(np.uint64))))

    return rows.mapInArrow(thin, rows.schema)


def _places(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of (doc_id, ...) whose doc_id is among ids (id, distinct and written), with the column id.

    Few ids are broadcast, after a count.  More are joined by a shuffle, which a
    bitmap of fixed size spares most other rows; it lets rows through by
    chance, more as ids grow, and the join drops them.
    """
    condition = F.col("doc_id") == F.col("id")
    if ids.count() <= FEW_IDS:
        return rows.join(F.broadcast(ids), condition)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy())
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = own.view(np.int64)
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(words[full])], names=["word", "bits"])

    got = ids.select("id").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS >> 6, dtype=np.int64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table.view(np.uint8))
    at = rows.columns.index("doc_id")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _places(batch.column(at).to_numpy())
            yield batch.filter(pa.array((shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0))

    return rows.mapInArrow(thin, rows.schema).join(ids, condition)
