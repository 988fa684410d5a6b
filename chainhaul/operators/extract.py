"""Activity chains from ordered position records, by windows alone.

gps: vehicle_id, seq, time (epoch seconds), lon, lat, status.  All windows are
by vehicle; a vehicle's records sort and spill inside one partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVITY_SECONDS, MAJOR_SECONDS = 60, 18_000


def in_bounds(gps: DataFrame) -> DataFrame:
    """Records inside the study's bounds, both ends included."""
    return gps.where(F.col("lon").between(0, 45) & F.col("lat").between(-36, 0))


def ignition(status: Column, start: list[str], stop: list[str]) -> Column:
    """True for start codes, false for stop codes, null for codes that say nothing."""
    return F.when(status.isin(*start), True).when(status.isin(*stop), False)


def moving(gps: DataFrame, start: list[str], stop: list[str]) -> DataFrame:
    """Adds rn (place in time order) and moving (the last known state, at first moving)."""
    order = Window.partitionBy("vehicle_id").orderBy("time", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(ignition(F.col("status"), start, stop), ignorenulls=True).over(upto)
    return gps.withColumn("rn", F.row_number().over(order)).withColumn("moving", F.coalesce(known, F.lit(True)))


def classify(seconds: Column, major_seconds: int) -> Column:
    return F.when(seconds >= major_seconds, "major").otherwise("minor")


def activities(moved: DataFrame, activity_seconds: int = ACTIVITY_SECONDS, major_seconds: int = MAJOR_SECONDS, project: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Stopped runs with the record that closes them, long enough to be activities.

    One row an activity: vehicle_id, first_rn, close_rn, start_ts, end_ts, x, y,
    type.  The place is the mean of the run and its closing record, before
    projection.  A run without a closing record is no activity.
    """
    order = Window.partitionBy("vehicle_id").orderBy("rn")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = moved.withColumn("turn", F.coalesce((F.col("moving") != F.lag("moving").over(order)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("turn").over(upto)).withColumn("next", F.lead(F.struct("rn", "time", "lon", "lat")).over(order)).where(~F.col("moving"))
    close = F.max_by("next", "rn")
    runs = rows.groupBy("vehicle_id", "run").agg(F.min("rn").alias("first_rn"), F.min_by("time", "rn").alias("start_ts"), F.sum("lon").alias("sx"), F.sum("lat").alias("sy"), F.count("*").alias("n"), close.alias("close")).where("close is not null")
    x, y = (F.col("sx") + F.col("close.lon")) / (F.col("n") + 1), (F.col("sy") + F.col("close.lat")) / (F.col("n") + 1)
    point = project(x, y) if project else F.struct(x.alias("x"), y.alias("y"))
    seconds = F.col("close.time") - F.col("start_ts")
    return runs.where(seconds >= activity_seconds).select("vehicle_id", "first_rn", F.col("close.rn").alias("close_rn"), "start_ts", F.col("close.time").alias("end_ts"), point["x"].alias("x"), point["y"].alias("y"), classify(seconds, major_seconds).alias("type"))


def chains(acts: DataFrame) -> DataFrame:
    """Activities by chain: each pair of consecutive majors bounds one, and a major may close one and open the next.

    Adds chain_seq, act_seq (from 0) and next_rn, the first record of the activity after.
    """
    order = Window.partitionBy("vehicle_id").orderBy("first_rn")
    whole = Window.partitionBy("vehicle_id")
    major = (F.col("type") == "major").cast("int")
    rows = acts.withColumn("nth", F.sum(major).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("majors", F.sum(major).over(whole)).withColumn("next_rn", F.lead("first_rn").over(order))
    opens = F.when(F.col("nth").between(1, F.col("majors") - 1), F.col("nth"))
    closes = F.when((F.col("type") == "major") & (F.col("nth") >= 2), F.col("nth") - 1)
    rows = rows.withColumn("chain_seq", F.explode(F.array_compact(F.array(opens, closes)))).drop("nth", "majors")
    within = Window.partitionBy("vehicle_id", "chain_seq").orderBy("first_rn")
    return rows.withColumn("act_seq", (F.row_number().over(within) - 1).cast("int")).withColumn("chain_seq", F.col("chain_seq").cast("int"))


def traces(moved: DataFrame, chained: DataFrame) -> DataFrame:
    """Positions between activities: from an activity's closing record up to the record before the next one's first.

    An equi-join puts each activity on its closing record and a window carries
    it forward; there is no range join.
    """
    last = F.row_number().over(Window.partitionBy("vehicle_id", "chain_seq").orderBy(F.col("act_seq").desc())) == 1
    opens = chained.withColumn("is_last", last).where("not is_last").select(F.col("vehicle_id").alias("v"), F.col("close_rn").alias("at"), F.struct("chain_seq", "act_seq", "next_rn").alias("act"))
    rows = moved.join(opens, (F.col("vehicle_id") == F.col("v")) & (F.col("rn") == F.col("at")), "left")
    upto = Window.partitionBy("vehicle_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("act", F.last("act", ignorenulls=True).over(upto)).where(F.col("act").isNotNull() & (F.col("rn") < F.col("act.next_rn")))
    place = F.row_number().over(Window.partitionBy("vehicle_id", "act.chain_seq", "act.act_seq").orderBy("rn")) - 1
    return rows.select("vehicle_id", F.col("act.chain_seq").alias("chain_seq"), F.col("act.act_seq").alias("trace_seq"), place.cast("int").alias("pos_seq"), F.col("time").alias("ts"), F.col("lon").alias("x"), F.col("lat").alias("y"))


def extract(gps: DataFrame, start: list[str], stop: list[str], activity_seconds: int = ACTIVITY_SECONDS, major_seconds: int = MAJOR_SECONDS, project: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Raw records to activity chains."""
    moved = moving(in_bounds(gps), start, stop)
    return chains(activities(moved, activity_seconds, major_seconds, project))
