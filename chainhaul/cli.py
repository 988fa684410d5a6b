"""Command line: ``python -m chainhaul.cli COMMAND ARGUMENTS``; tables are Parquet folders unless said otherwise."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .functions import geo
from .operators import assign, clean, cluster, extract, generate, graph, kde, network, pathnet, reports, similarity
from .sources import exports, readers, writers

FEED = {"time": 0, "lat": 1, "lon": 2, "speed": 3, "status": 4, "vehicle_id": 5}


def do_extract(spark, a):
    """Raw records (delimited text) to activity chains and traces."""
    start, stop = readers.status_codes(spark, a.status)
    moved = extract.moving(extract.in_bounds(readers.raw_gps(spark, a.input, FEED)), start, stop)
    project = geo.to_transverse_mercator if a.project else None
    chained = extract.chains(extract.activities(moved, a.activity, a.major, project))
    chained.withColumn("facility_id", F.lit(None).cast("string")).drop("first_rn", "close_rn", "next_rn").write.parquet(f"{a.output}/activities")
    extract.traces(moved, chained).write.parquet(f"{a.output}/positions")


def do_cluster(spark, a):
    """Activities to facilities, by zone of a shapefile; points are visited by vehicle, chain and place in it."""
    zones = readers.zones_shapefile(spark, a.zones, a.field).select("zone_id", F.explode("rings").alias("ring"))
    placed = assign.point_in_zone(spark.read.parquet(a.input), zones, a.cell)
    points = placed.select("zone_id", F.row_number().over(Window.partitionBy("zone_id").orderBy("vehicle_id", "chain_seq", "act_seq", "x", "y")).alias("point_id"), "x", "y")
    clustered = cluster.cluster(points, a.radius, a.points)
    found = cluster.facilities(clustered, a.threshold)
    found.write.parquet(f"{a.output}/facilities")
    exports.facility_points(clustered).write.option("header", True).csv(f"{a.output}/points")


def do_assign(spark, a):
    """Activities snapped to facilities."""
    f = spark.read.parquet(a.facilities).select("facility_id", F.col("x").alias("fx"), F.col("y").alias("fy"), "hull")
    assign.snap(spark.read.parquet(a.input), f, a.reach).write.parquet(a.output)


def do_clean(spark, a):
    """Consecutive activities at one facility merged."""
    clean.clean(spark.read.parquet(a.input), a.end_rule).write.parquet(a.output)


def do_network(spark, a):
    """The multiplex network as node and arc text, with degrees and statistics."""
    acts = assign.chains_with_facility(spark.read.parquet(a.input), a.only)
    mx = network.arcs(acts).cache()
    writers.write_network(network.nodes(acts), mx, f"{a.output}/network", a.overwrite)
    network.degree_distribution(network.degrees(mx)).write.parquet(f"{a.output}/degrees")
    network.stats(mx).write.json(f"{a.output}/stats")


def do_paths(spark, a):
    """The second-order network: edges, contexts, starts, nodes."""
    acts = spark.read.parquet(a.input)
    for name, make in (("edges", pathnet.edges), ("contexts", pathnet.contexts), ("starts", pathnet.starts), ("nodes", pathnet.nodes)):
        make(acts).write.parquet(f"{a.output}/{name}")


def do_generate(spark, a):
    """Synthetic plans from a second-order network."""
    read = lambda name: spark.read.parquet(f"{a.input}/{name}")
    generate.plans(read("edges"), read("starts"), read("nodes"), a.number, a.prefix, a.deciles, a.seed).write.parquet(a.output)


def do_centrality(spark, a):
    """Betweenness or eigenvector centrality of a network's edges."""
    e = spark.read.parquet(a.input).groupBy("o_id", "d_id").agg(F.sum("weight").alias("weight"))
    (graph.betweenness(e) if a.kind == "betweenness" else graph.eigenvector(e)).write.option("header", True).csv(a.output)


def do_report(spark, a):
    """One of the reports on chains."""
    acts = spark.read.parquet(a.input)
    days = [r.day_of_year for r in readers.abnormal_days(spark, a.abnormal).collect()] if a.abnormal else []
    dates = [r.date for r in readers.abnormal_days(spark, a.abnormal).collect()] if a.abnormal else []
    made = {"hours": lambda: reports.minor_start_hours(acts), "durations": lambda: reports.minor_durations(acts), "shares": lambda: reports.facility_share(acts), "visits": lambda: reports.facility_visits(acts), "chains": lambda: reports.chain_summary(acts, dates), "starts": lambda: reports.chain_start_report(acts), "weekdays": lambda: reports.normal_weekday_chains(acts, days), "consecutive": lambda: reports.consecutive_report(acts, days), "overlap": lambda: similarity.chain_overlap(acts)}[a.kind]()
    made.write.option("header", True).csv(a.output)


def do_density(spark, a):
    """A kernel density raster as boxes."""
    acts = spark.read.parquet(a.input).select("x", "y", F.lit(1.0).alias("weight"))
    kde.boxes(kde.raster(acts, a.kind, a.resolution, a.radius, *a.extent), a.resolution, a.extent[0], a.extent[3]).write.option("header", True).csv(a.output)


def do_untrace(spark, a):
    """A vehicles container without its traces."""
    exports.without_traces(spark, a.input, a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chainhaul", description=__doc__)
    sub = top.add_subparsers(required=True)

    def add(name, run, *options):
        p = sub.add_parser(name, help=run.__doc__)
        p.add_argument("input")
        p.add_argument("output")
        for flag, kind in options:
            p.add_argument(flag, **kind)
        p.set_defaults(run=run)

    add("extract", do_extract, ("--status", {"required": True}), ("--activity", {"type": int, "default": 60}), ("--major", {"type": int, "default": 18000}), ("--project", {"action": "store_true"}))
    add("cluster", do_cluster, ("--zones", {"required": True}), ("--field", {"required": True}), ("--radius", {"type": float, "default": 16.6}), ("--points", {"type": int, "default": 11}), ("--threshold", {"type": float, "default": 10.0}), ("--cell", {"type": float, "default": 5000.0}))
    add("assign", do_assign, ("--facilities", {"required": True}), ("--reach", {"type": float, "default": 1000.0}))
    add("clean", do_clean, ("--end-rule", {"choices": ["min", "max"], "default": "min"}))
    add("network", do_network, ("--only", {"nargs": "*"}), ("--overwrite", {"action": "store_true"}))
    add("paths", do_paths)
    add("generate", do_generate, ("--number", {"type": int, "default": 1000}), ("--prefix", {"default": "p"}), ("--seed", {"type": int, "default": 0}), ("--deciles", {"type": float, "nargs": 11, "required": True}))
    add("centrality", do_centrality, ("--kind", {"choices": ["betweenness", "eigenvector"], "default": "betweenness"}))
    add("report", do_report, ("--kind", {"default": "chains"}), ("--abnormal", {}))
    add("density", do_density, ("--kind", {"type": int, "default": 0}), ("--resolution", {"type": float, "required": True}), ("--radius", {"type": float, "required": True}), ("--extent", {"type": float, "nargs": 4, "required": True}))
    add("untrace", do_untrace)
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.appName("chainhaul").getOrCreate(), a)


if __name__ == "__main__":
    main()
