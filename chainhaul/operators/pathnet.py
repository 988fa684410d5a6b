"""Second-order (path-dependent) network: where a vehicle goes next depends on where it came from.

chains are read in the canonical order (vehicle_id, chain_seq); ``source``,
``sink`` and ``unknown`` are pseudo ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar

SOURCE, SINK, UNKNOWN = "source", "sink", "unknown"


def _rows(acts: DataFrame) -> DataFrame:
    chain = Window.partitionBy("vehicle_id", "chain_seq")
    order = chain.orderBy("act_seq")
    rows = acts.select("vehicle_id", "chain_seq", "act_seq", "type", "end_ts", "facility_id", "x", "y")
    return rows.withColumn("prev", F.lag("facility_id").over(order)).withColumn("next", F.lead("facility_id").over(order)).withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(chain)).withColumn("minors", F.sum((F.lower("type") == "minor").cast("long")).over(chain)).withColumn("rank", F.struct("vehicle_id", "chain_seq"))


def edges(acts: DataFrame) -> DataFrame:
    """prev_id, node_id, next_id, weight.

    A last activity counts only if its facility is a node by then: one that an
    earlier chain made, or this one before its end.
    """
    rows = _rows(acts)
    made = _made(rows).groupBy("id").agg(F.min("rank").alias("born"))
    known = rows.where("facility_id is not null and n > 1")
    prev = F.when(F.col("i") == 0, SOURCE).otherwise(F.coalesce("prev", F.lit(UNKNOWN)))
    inner = known.where("i < n - 1").select(prev.alias("prev_id"), F.col("facility_id").alias("node_id"), F.coalesce("next", F.lit(UNKNOWN)).alias("next_id"))
    last = known.where("i = n - 1").join(made, (F.col("facility_id") == F.col("id")) & (F.col("born") <= F.col("rank")))
    last = last.select(F.coalesce("prev", F.lit(UNKNOWN)).alias("prev_id"), F.col("facility_id").alias("node_id"), F.lit(SINK).alias("next_id"))
    return inner.unionByName(last).groupBy("prev_id", "node_id", "next_id").agg(F.count("*").cast("double").alias("weight"))


def _made(rows: DataFrame) -> DataFrame:
    """Events that make a node: an activity that isn't its chain's last, and the one after it."""
    known = rows.where("facility_id is not null and i < n - 1")
    return known.select(F.explode(F.array("facility_id", "next")).alias("id"), "rank", "i", "x", "y").where("id is not null")


def nodes(acts: DataFrame) -> DataFrame:
    """id, x, y: at the place first seen."""
    rows = _rows(acts)
    born = _made(rows).select("id").distinct()
    place = F.min_by(F.struct("x", "y"), F.struct("vehicle_id", "chain_seq", "act_seq"))
    return rows.where("facility_id is not null").groupBy(F.col("facility_id").alias("id")).agg(place.alias("p")).join(born, "id", "left_semi").select("id", "p.x", "p.y")


def contexts(acts: DataFrame) -> DataFrame:
    """prev_id, node_id: also those without an edge."""
    rows = _rows(acts)
    after = rows.where("facility_id is not null and i < n - 1 and next is not null").select(F.col("facility_id").alias("prev_id"), F.col("next").alias("node_id"))
    return edges(acts).select("prev_id", "node_id").unionByName(after).distinct()


def starts(acts: DataFrame) -> DataFrame:
    """node_id, hour, activities, count: of first activities, by the hour they end and the chain's minor ones."""
    first = _rows(acts).where("i = 0 and n > 1 and facility_id is not null")
    return first.groupBy(F.col("facility_id").alias("node_id"), calendar.hour_of(F.col("end_ts")).alias("hour"), F.col("minors").alias("activities")).agg(F.count("*").alias("count"))


def collapsed(pd: DataFrame) -> DataFrame:
    """Path-independent edges: node_id, next_id, weight, without sink and unknown."""
    return pd.where(~F.col("next_id").isin(SINK, UNKNOWN)).groupBy("node_id", "next_id").agg(F.sum("weight").alias("weight"))


def degrees(pd: DataFrame, ctx: DataFrame, places: DataFrame) -> DataFrame:
    """in_degree: contexts but source and unknown; out_degree: distinct next ones but sink and unknown."""
    i = ctx.where(~F.col("prev_id").isin(SOURCE, UNKNOWN)).groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("prev_id").alias("in_degree"))
    o = pd.where(~F.col("next_id").isin(SINK, UNKNOWN)).groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("next_id").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return places.select("id").join(i, "id", "left").join(o, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def stats(deg: DataFrame) -> DataFrame:
    """One row: nodes, edges, density in percent."""
    out = deg.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"))
    return out.withColumn("density", F.when(F.col("nodes") > 0, F.col("edges") * 100.0 / (F.col("nodes") * F.col("nodes"))).otherwise(0.0))


def end_weights(pd: DataFrame) -> DataFrame:
    """node_id, source_weight (to known nodes), sink_weight."""
    weight = lambda on: F.coalesce(F.sum(F.when(on, F.col("weight"))), F.lit(0.0))
    return pd.groupBy("node_id").agg(weight((F.col("prev_id") == SOURCE) & (F.col("next_id") != UNKNOWN)).alias("source_weight"), weight(F.col("next_id") == SINK).alias("sink_weight"))


def context_out_degree(pd: DataFrame) -> DataFrame:
    return pd.where(~F.col("next_id").isin(SINK, UNKNOWN)).groupBy("prev_id", "node_id").agg(F.count("*").alias("out_degree"))


def neighbours(pd: DataFrame) -> DataFrame:
    """node_id with its distinct next nodes, in order; a node's list grows with its degree."""
    own = pd.where(~F.col("next_id").isin(SINK, UNKNOWN)).groupBy("node_id").agg(F.array_sort(F.collect_set("next_id")).alias("out_ids"))
    return own
