"""Delimited outputs and conversions: each returns the table to be written, or writes a folder in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import network
from . import readers, writers


def split_by_vehicle(gps: DataFrame, path: str) -> None:
    """A folder a vehicle; appends."""
    gps.repartition("vehicle_id").write.mode("append").partitionBy("vehicle_id").csv(path)


def sorted_vehicle_csv(gps: DataFrame, path: str) -> None:
    """Compressed files in time order by vehicle, with a header; one shuffle, sorts inside partitions."""
    rows = gps.repartition("vehicle_id").sortWithinPartitions("vehicle_id", "time", "seq")
    rows.select(F.col("vehicle_id").alias("vId"), "time", "lon", "lat", "status", "speed").write.option("header", True).option("compression", "gzip").csv(path)


def collate(parts: list[DataFrame]) -> DataFrame:
    """Several vehicle tables as one; a vehicle in two of them is an error."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    twice = out.groupBy("vehicle_id").agg(F.count_distinct("_part").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"vehicle {twice[0].vehicle_id} is there twice")
    return out.drop("_part")


def without_traces(spark, source: str, target: str) -> None:
    """A container of version 2 as one of version 1."""
    root = readers.container_attributes(spark, source).first()
    writers.write_vehicles(readers.xml_activities(readers.vehicles_xml(spark, source)), None, target, crs=root.crs, description=root.description)


def facility_points(clustered: DataFrame) -> DataFrame:
    """Distinct member places of each cluster."""
    return clustered.where("cluster_id is not null").select("zone_id", "cluster_id", F.col("x").alias("Long"), F.col("y").alias("Lat")).distinct()


def lost_points(clustered: DataFrame) -> DataFrame:
    """Places that no cluster took."""
    return clustered.where("cluster_id is null").select("zone_id", F.col("x").alias("Long"), F.col("y").alias("Lat"))


def clusters_csv(centres: DataFrame) -> DataFrame:
    return centres.select(F.col("cluster_id").alias("ClusterId"), F.col("x").alias("Long"), F.col("y").alias("Lat"), F.col("n").alias("NumberOfActivities"))


def node_order_csv(places: DataFrame, mx: DataFrame) -> DataFrame:
    order = network.node_order(mx)
    return places.join(order, "id").select(F.col("id").alias("FacilityId"), F.col("x").alias("Long"), F.col("y").alias("Lat"), F.col("in_order").alias("InOrder"), F.col("out_order").alias("OutOrder"), F.col("total_order").alias("Order"))


def weighted_edge_list(edges: DataFrame, places: DataFrame, lon0: float | None = None) -> DataFrame:
    """Ends, weight and both ends' places, projected and in degrees; without lon0 the places are in degrees already.

    edges: o_id, d_id, weight.
    """

    def degrees(x: Column, y: Column) -> Column:
        return F.struct(x.alias("lon"), y.alias("lat")) if lon0 is None else geo.from_transverse_mercator(x, y, lon0)

    end = lambda p: places.select(F.col("id").alias(f"{p}_id"), F.col("x").alias(f"{p}X"), F.col("y").alias(f"{p}Y"), degrees(F.col("x"), F.col("y")).alias(f"{p}_deg"))
    out = edges.join(end("o"), "o_id").join(end("d"), "d_id")
    return out.select(F.col("o_id").alias("fromId"), F.col("d_id").alias("toId"), "weight", "oX", "oY", F.col("o_deg.lon").alias("oLon"), F.col("o_deg.lat").alias("oLat"), "dX", "dY", F.col("d_deg.lon").alias("dLon"), F.col("d_deg.lat").alias("dLat"))


def degree_report(degrees: DataFrame, places: DataFrame, lon0: float | None = None) -> DataFrame:
    """id, x, y, lon, lat, in and out degree."""
    deg = F.struct(F.col("x").alias("lon"), F.col("y").alias("lat")) if lon0 is None else geo.from_transverse_mercator(F.col("x"), F.col("y"), lon0)
    return places.join(degrees, "id").withColumn("p", deg).select("id", "x", "y", "p.lon", "p.lat", "in_degree", "out_degree")


def coordinate_label(x: Column, y: Column) -> Column:
    return F.format_string("[%.2f ; %.2f]", x, y)
