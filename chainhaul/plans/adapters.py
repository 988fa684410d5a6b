"""The driver's tables as the tables of this library.

gps comes from events, whose statuses include codes that say nothing; orders
with their lines make a second, larger set of chains.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import extract

START, STOP = ["click", "view"], ["purchase", "error"]
ACTIVITY_SECONDS, MAJOR_SECONDS = 3600, 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder spark.checkpoint.dir; in local mode, if none is set, one of this machine's own."""
    shared = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="files-")
    return f"{shared}/files-{uuid.uuid4().hex}"


#: The setting by which Spark removes shuffle files at the end of the execution that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(rows: DataFrame) -> DataFrame:
    """The same rows, read from a table written now: made once, however often they are read; what was shuffled for it goes."""
    spark, schema = rows.sparkSession, rows.schema
    path, before = scratch(spark), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def epoch(column: str):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).try_cast("long")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("vehicle_id"), F.col("event_id").alias("seq"), epoch("ts").alias("time"), (F.col("value") - 50 * F.floor(F.col("value") / 50)).alias("lon"), (-(k % 40)).cast("double").alias("lat"), F.col("event_type").alias("status"))


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.moving(extract.in_bounds(gps(spark, sf_dir)), START, STOP)


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.chains(extract.activities(moved(spark, sf_dir), ACTIVITY_SECONDS, MAJOR_SECONDS))


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of gps with facilities: cells of five degrees, some unknown."""
    c = (F.floor(F.col("x") / 5) * 10 + F.floor(-F.col("y") / 5)).cast("long")
    rows = chained(spark, sf_dir).withColumn("cell", c)
    return rows.withColumn("facility_id", F.when(F.col("cell") % 4 != 0, F.concat(F.lit("f"), F.col("cell").cast("string")))).select("vehicle_id", "chain_seq", "act_seq", "type", "start_ts", "end_ts", "x", "y", "facility_id")


def order_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of orders: customers are vehicles, lines activities, suppliers facilities (every seventh unknown)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    start = epoch("l_shipdate") + F.col("l_linenumber") * 600
    return rows.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("vehicle_id"),
        F.col("o_orderkey").cast("int").alias("chain_seq"),
        (F.row_number().over(place) - 1).cast("int").alias("act_seq"),
        F.when(F.col("l_returnflag") == "R", "major").otherwise("minor").alias("type"),
        start.alias("start_ts"),
        (start + F.col("l_quantity").cast("long") * 60).alias("end_ts"),
        ((F.col("l_suppkey") % 97) * 10.0).alias("x"),
        ((F.col("l_suppkey") % 89) * 10.0).alias("y"),
        F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("facility_id"),
    )


def zones(spark: SparkSession, size: int = 100, count: int = 10) -> DataFrame:
    """A grid of square zones."""
    k = F.col("id")
    x, y = F.floor(k / count) * size, (k % count) * size
    return spark.range(count * count).select(F.concat(F.lit("z"), F.lpad(k.cast("string"), 3, "0")).alias("zone_id"), geo.rectangle(x, y, x + size, y + size).alias("ring"))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as facilities with square hulls around them."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0")
    x, y = (F.col("s_suppkey") % 97) * 10.0 + 2, (F.col("s_suppkey") % 89) * 10.0 + 2
    return s.select(F.concat(F.lit("h"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("facility_id"), x.alias("fx"), y.alias("fy"), geo.rectangle(x - 5, y - 5, x + 5, y + 5).alias("hull"))
