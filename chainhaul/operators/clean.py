"""Cleaning of chains: consecutive activities at one facility become one.

activities: vehicle_id, chain_seq, act_seq, type, start_ts, end_ts, x, y, facility_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHAIN = ("vehicle_id", "chain_seq")


def merge_same_facility(acts: DataFrame) -> DataFrame:
    """Maximal runs at one known facility (letters' case aside): first start and place, last end, major if any is."""
    order = Window.partitionBy(*CHAIN).orderBy("act_seq")
    same = F.coalesce(F.lower("facility_id") == F.lower(F.lag("facility_id").over(order)), F.lit(False))
    rows = acts.withColumn("new", (~same).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = (lambda c: F.min_by(c, "act_seq").alias(c)), (lambda c: F.max_by(c, "act_seq").alias(c))
    major = F.bool_or(F.lower("type") == "major")
    out = rows.groupBy(*CHAIN, "island").agg(F.when(major, "major").otherwise(F.min_by("type", "act_seq")).alias("type"), first("start_ts"), last("end_ts"), first("x"), first("y"), first("facility_id"), F.count("*").alias("merged"))
    return out.withColumn("act_seq", (F.row_number().over(Window.partitionBy(*CHAIN).orderBy("island")) - 1).cast("int")).drop("island")


def drop_short(acts: DataFrame, least: int = 2) -> DataFrame:
    """Chains of at least two activities; vehicles without chains go with them."""
    return acts.withColumn("n", F.count("*").over(Window.partitionBy(*CHAIN))).where(F.col("n") >= least).drop("n")


def consolidate(acts: DataFrame, end_rule: str = "min") -> DataFrame:
    """The last activity of a chain and the first of the next get common times: the earlier start, and of ends the ``end_rule``."""
    pick = {"min": F.least, "max": F.greatest}[end_rule]
    order = Window.partitionBy("vehicle_id").orderBy("chain_seq", "act_seq")
    whole = Window.partitionBy(*CHAIN)
    rows = acts.withColumn("top", F.max("act_seq").over(whole)).withColumn("low", F.min("act_seq").over(whole))
    after, before = F.lead(F.struct("start_ts", "end_ts")).over(order), F.lag(F.struct("start_ts", "end_ts")).over(order)
    rows = rows.withColumn("other", F.when(F.col("act_seq") == F.col("top"), after).when(F.col("act_seq") == F.col("low"), before))
    return rows.withColumn("start_ts", F.least("start_ts", "other.start_ts")).withColumn("end_ts", pick(F.col("end_ts"), F.col("other.end_ts"))).drop("top", "low", "other")


def clean(acts: DataFrame, end_rule: str = "min") -> DataFrame:
    return consolidate(drop_short(merge_same_facility(acts)), end_rule)
