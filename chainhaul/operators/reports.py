"""Reports on activities and chains.

activities: vehicle_id, chain_seq, act_seq, type, start_ts, end_ts, x, y, facility_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, geo

CHAIN = ("vehicle_id", "chain_seq")


def _minor():
    return F.lower("type") == "minor"


def minor_start_hours(acts: DataFrame) -> DataFrame:
    return acts.where(_minor()).groupBy(F.lpad(calendar.hour_of(F.col("start_ts")).cast("string"), 2, "0").alias("hour")).agg(F.count("*").alias("n"))


def minor_durations(acts: DataFrame) -> DataFrame:
    return acts.where(_minor()).select(*CHAIN, "act_seq", (F.col("end_ts") - F.col("start_ts")).alias("seconds"))


def facility_share(acts: DataFrame) -> DataFrame:
    """Share of a vehicle's activities that have a facility."""
    return acts.groupBy("vehicle_id").agg(F.avg(F.col("facility_id").isNotNull().cast("double")).alias("share"))


def facility_visits(acts: DataFrame) -> DataFrame:
    """Visits of minor activities by vehicle and facility, at the facility's first place."""
    place = F.min_by(F.struct("x", "y"), F.struct("chain_seq", "act_seq"))
    return acts.where(_minor() & F.col("facility_id").isNotNull()).groupBy("vehicle_id", "facility_id").agg(F.count("*").alias("visits"), place.alias("p")).select("vehicle_id", "facility_id", "visits", "p.x", "p.y")


def chain_ends(acts: DataFrame) -> DataFrame:
    """One row a chain: first and last activity, numbers by type."""
    first, last = (lambda c: F.min_by(c, "act_seq")), (lambda c: F.max_by(c, "act_seq"))
    return acts.groupBy(*CHAIN).agg(first("end_ts").alias("first_end"), first("start_ts").alias("first_start"), first("type").alias("first_type"), last("start_ts").alias("last_start"), last("type").alias("last_type"), F.count("*").alias("activities"), F.count_if(_minor()).alias("minors"))


def chain_summary(acts: DataFrame, abnormal_dates: list[str]) -> DataFrame:
    """vehicle, day, day type, start hour and minor activities of each chain."""
    t = F.col("first_end")
    return chain_ends(acts).select(*CHAIN, F.date_format(calendar.date_of(t), "yyyy/MM/dd").alias("day"), calendar.day_type_by_date(t, abnormal_dates).alias("day_type"), calendar.hour_of(t).alias("hour"), "minors")


def chain_flags(acts: DataFrame) -> DataFrame:
    """Completeness and shape by the types of the ends."""
    first, last = F.lower("first_type"), F.lower("last_type")
    return chain_ends(acts).select(*CHAIN, ((first == "major") & (last == "major")).alias("complete"), ((first == "major") & (last == "exit")).alias("inter_out"), ((first == "entry") & (last == "major")).alias("inter_in"), ((first == "entry") & (last == "exit")).alias("in_out"))


def chain_start_report(acts: DataFrame) -> DataFrame:
    """Start (seconds of the day), size, straight distance and duration of each chain."""
    order = Window.partitionBy(*CHAIN).orderBy("act_seq")
    step = geo.distance(F.col("x"), F.col("y"), F.lag("x").over(order), F.lag("y").over(order))
    rows = acts.withColumn("step", step).groupBy(*CHAIN).agg(F.min_by("end_ts", "act_seq").alias("t"), F.max_by("start_ts", "act_seq").alias("u"), F.count("*").alias("activities"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance"))
    return rows.select(*CHAIN, calendar.second_of_day(F.col("t")).alias("start_second"), "activities", "distance", (F.col("u") - F.col("t")).alias("duration"))


def normal_weekday_chains(acts: DataFrame, abnormal_days: list[int]) -> DataFrame:
    """Chains by day of the year, Monday to Friday and not abnormal."""
    t = F.col("first_end")
    rows = chain_ends(acts).select(calendar.day_of_year(t).alias("day"), calendar.day_of_week(t).alias("dow")).where(F.col("dow").between(2, 6))
    return rows.where(~F.col("day").isin(*abnormal_days) if abnormal_days else F.lit(True)).groupBy("day").agg(F.count("*").alias("chains"))


def month_counts(monthly: DataFrame, yearly: DataFrame, months: list[str]) -> DataFrame:
    """Vehicle by month: chains in the monthly and in the yearly source, zeros where there are none."""

    def pivot(acts: DataFrame, name: str) -> DataFrame:
        rows = chain_ends(acts).select("vehicle_id", calendar.month_key(F.col("first_end")).alias("month"))
        return rows.groupBy("vehicle_id").agg(*(F.count_if(F.col("month") == m).alias(f"{name}_{m}") for m in months))

    a, b = pivot(monthly, "m"), pivot(yearly, "y")
    both = a.join(b, "vehicle_id", "full_outer")
    return both.select("vehicle_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in both.columns if c != "vehicle_id"))


def consecutive_report(acts: DataFrame, abnormal_days: list[int]) -> DataFrame:
    """Pairs of consecutive activities that both have a facility; the row describes the second."""
    order = Window.partitionBy(*CHAIN).orderBy("act_seq")
    whole = Window.partitionBy(*CHAIN)
    rows = acts.withColumn("p", F.lag(F.struct("facility_id", "start_ts", "end_ts")).over(order)).withColumn("position", F.row_number().over(order)).withColumn("chain_length", F.count("*").over(whole)).withColumn("t", F.first("end_ts").over(order))
    rows = rows.where("facility_id is not null and p.facility_id is not null")
    minutes = lambda a, b: F.round((a - b) / 60, 0).cast("long")
    return rows.select(*CHAIN, "facility_id", "chain_length", "position", calendar.day_type(F.col("t"), abnormal_days).alias("chain_day"), calendar.day_type(F.col("start_ts"), abnormal_days).alias("activity_day"), "x", "y", minutes(F.col("start_ts"), F.col("p.end_ts")).alias("between"), minutes(F.col("start_ts"), F.col("p.start_ts")).alias("start_to_start"), (F.col("facility_id") == F.col("p.facility_id")).alias("duplicate"))
