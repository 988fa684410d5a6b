"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a place in its source's hash order.  Tokens are summed by
source and hash bucket; the budget threshold falls into one bucket, which alone
is refined by the next bits of the hash, level after level.  The mix is then a
filter on hash thresholds; nothing is sorted and no list is gathered.

Rows and cases: a null or empty text has size 0 and takes 0.  Null sources form
one source, last in order.  Null doc_ids are told apart by their texts, as are
rows that share a doc_id; rows equal in both share their place and are taken
together.  A source without words has target 0.  Without any word all
targets are 0; an empty table gives an empty result.  Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Hash digits (of 4 bits) used by each level of the histogram.
LEVELS = (3, 3, 3, 3)
MOST_TIMES = 3
#: Sources whose plan is broadcast; more are joined by a shuffle, to the same result.
SMALL = 50_000
WEIGHTS = (1, 2, 3)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(doc_id: Column, text: Column) -> Column:
    """The document's place in the hash order: hexadecimal digits of its id and text."""
    return F.substring(F.md5(F.concat_ws(" ", doc_id.cast("string"), text)), 1, sum(LEVELS))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), place_of(F.col("doc_id"), F.col("text")).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target, reps, rest: one row a source.

    Targets share all words by weight, none above ``most`` times its source:
    with sources ordered by what they hold a unit of weight, those below the
    level of the others are full and the rest share what remains; the level is
    the largest of those found by filling the first 0, 1, 2, ... sources.  The
    windows run over one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").isNull(), F.col("source"))
    k = len(weights)
    nth = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % k + 1).cast("int"))
    by = by.withColumn("weight", nth.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    by = by.withColumn("level", F.max("level").over(whole))
    by = by.withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
    reps = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return by.withColumn("reps", F.least(reps, F.lit(most).cast("long"))).select("source", "source_size", "target", "reps", (F.col("target") - F.col("reps") * F.col("source_size")).alias("rest"))


def thresholds(sizes: DataFrame, goals: DataFrame, small: bool) -> DataFrame:
    """source, edge: documents with a place below ``edge`` are within the rest.

    Level by level: the sums of one more group of digits, inside the boundary
    bucket only; the first bucket whose running sum passes what is still wanted
    is the next boundary.  At the last level the boundary bucket is in if that
    comes nearer to the target.  Every level's edges are written, one row a
    source, and broadcast if ``small``, so that a hot source stays where it lies.
    """
    edge = goals.select(F.col("source").alias("s"), F.lit("").alias("edge"), F.col("rest").alias("wanted"))
    used = 0
    for level, digits in enumerate(LEVELS):
        used += digits
        inside = sizes.join(F.broadcast(edge) if small else edge, F.col("source").eqNullSafe(F.col("s")) & F.col("place").startswith(F.col("edge")))
        sums = inside.groupBy("s", F.substring("place", 1, used).alias("bucket")).agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
        run = Window.partitionBy("s").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        last = level == len(LEVELS) - 1
        reach = F.col("upto") - F.col("words") / 2 if last else F.col("upto")
        first = sums.where(reach > F.col("wanted")).groupBy("s").agg(F.min(F.struct("bucket", (F.col("wanted") - (F.col("upto") - F.col("words"))).alias("left"))).alias("m"))
        # past every bucket: nothing of this source is left out below the old edge
        edge = edge.select("s", F.col("edge").alias("old")).join(first.select(F.col("s").alias("s2"), "m"), F.col("s").eqNullSafe(F.col("s2")), "left").select("s", F.coalesce("m.bucket", F.concat("old", F.lit("g"))).alias("edge"), F.coalesce("m.left", F.lit(0.0)).alias("wanted"))
        edge = cut(edge)
    return edge.select(F.col("s").alias("source"), "edge")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row a document.

    ``taken`` is size times the whole copies that the target holds of the
    source, and once more for documents below the source's hash threshold.
    """
    sizes = cut(measured(docs))
    goals = cut(targets(sizes, weights, most)).select(F.col("source").alias("g"), "source_size", "target", "reps", "rest")
    small = goals.count() <= SMALL  # one row a source: its size is known here
    edges = thresholds(sizes, goals.withColumnRenamed("g", "source"), small).withColumnRenamed("source", "e")
    plan = goals.join(edges, F.col("g").eqNullSafe(F.col("e")), "left")
    if small:
        plan = F.broadcast(plan)
    extra = F.when(F.col("place") < F.col("edge"), 1).otherwise(0)
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("g"))).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.least(F.lit(most).cast("long"), F.col("reps") + extra)).alias("taken"))
