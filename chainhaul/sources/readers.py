"""Readers of position records, vehicles, facilities, networks and shapes, as tables."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, geo

FIELDS = ("vehicle_id", "time", "lon", "lat", "status", "speed")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and seq, the line's place in file order: (file, block, place in block) made one number by rank of file and block."""
    return spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("seq"))


def typed(rows: DataFrame) -> DataFrame:
    """Rows whose six texts parse; status keeps its number's form, so 015 reads 15."""
    out = rows.select("seq", F.trim("vehicle_id").try_cast("long").cast("string").alias("vehicle_id"), F.trim("time").try_cast("long").alias("time"), F.trim("lon").try_cast("double").alias("lon"), F.trim("lat").try_cast("double").alias("lat"), F.trim("status").try_cast("int").cast("string").alias("status"), F.trim("speed").try_cast("int").alias("speed"))
    return out.dropna()


def raw_gps(spark: SparkSession, path: str, positions: dict[str, int], start_line: int = 0, most_lines: int | None = None) -> DataFrame:
    """Comma-separated records of exactly six fields; positions tells where each of FIELDS stands.

    start_line and most_lines cut a window of the lines in file order.
    """
    rows = lines(spark, path)
    if start_line or most_lines is not None:
        rows = rows.orderBy("seq").offset(start_line)
        rows = rows if most_lines is None else rows.limit(most_lines)
    parts = F.split("value", ",", -1)
    rows = rows.where(F.size(parts) == 6)
    return typed(rows.select("seq", *(parts[positions[f]].alias(f) for f in FIELDS)))


def time_range(gps: DataFrame) -> DataFrame:
    return gps.agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def sorted_vehicle_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of one vehicle each, with a header; the id is the file's name up to its first dot."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{f} string" for f in FIELDS))
    return typed(raw.select(F.struct(F.monotonically_increasing_id().alias("nth")).alias("seq"), name.alias("vehicle_id"), *FIELDS[1:]))


def status_codes(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(start codes, stop codes) of the two-line status file; any other line is an error."""
    found: dict[str, list[str]] = {}
    rows = spark.read.text(path)
    kind = F.trim(F.substring_index("value", ",", 1))
    wrong = rows.where(~kind.isin("Start", "Stop")).limit(1).collect()
    for row in wrong or rows.limit(3).collect():
        kind, *codes = [x.strip() for x in row.value.split(",")]
        if wrong or kind in found:
            raise ValueError(f"unexpected line in the status file: {row.value!r}")
        found[kind] = codes
    return found.get("Start", []), found.get("Stop", [])


def abnormal_days(spark: SparkSession, path: str) -> DataFrame:
    """date and day of the year of each line YYYY/MM/DD; other lines are skipped."""
    date = F.try_to_timestamp(F.trim("value"), F.lit("yyyy/MM/dd")).cast("date")
    return spark.read.text(path).select(F.trim("value").alias("date"), F.dayofyear(date).alias("day_of_year")).dropna()


_ACTIVITY = "array<struct<_type:string,_start:string,_end:string,_x:double,_y:double,_facility:string,_link:string>>"
_TRACE = "array<struct<_crs:string,position:array<struct<_time:string,_x:double,_y:double,_z:double>>>>"
_VEHICLE = f"_id string, _type string, chain array<struct<activity:{_ACTIVITY},trace:{_TRACE}>>"


def vehicles_xml(spark: SparkSession, path: str) -> DataFrame:
    """Vehicles of single files or containers, either version; one schema reads all."""
    return spark.read.format("xml").option("rowTag", "digicoreVehicle").schema(_VEHICLE).load(path)


def container_attributes(spark: SparkSession, path: str) -> DataFrame:
    """crs (default Atlantis) and description of containers."""
    root = spark.read.format("xml").option("rowTag", "digicoreVehicles").schema("_crs string, _desc string").load(path)
    return root.select(F.coalesce("_crs", F.lit("Atlantis")).alias("crs"), F.col("_desc").alias("description"))


def xml_activities(vehicles: DataFrame) -> DataFrame:
    chains = vehicles.select(F.col("_id").alias("vehicle_id"), F.posexplode("chain").alias("chain_seq", "c"))
    rows = chains.select("vehicle_id", "chain_seq", F.posexplode("c.activity").alias("act_seq", "a"))
    return rows.select("vehicle_id", "chain_seq", "act_seq", F.col("a._type").alias("type"), calendar.parse_stamp(F.col("a._start")).alias("start_ts"), calendar.parse_stamp(F.col("a._end")).alias("end_ts"), F.col("a._x").alias("x"), F.col("a._y").alias("y"), F.col("a._facility").alias("facility_id"), F.col("a._link").alias("link_id"))


def xml_positions(vehicles: DataFrame, crs: str | None = None) -> DataFrame:
    """Positions of traces; a trace without a crs has the container's."""
    chains = vehicles.select(F.col("_id").alias("vehicle_id"), F.posexplode("chain").alias("chain_seq", "c"))
    rows = chains.select("vehicle_id", "chain_seq", F.posexplode("c.trace").alias("trace_seq", "t"))
    rows = rows.select("vehicle_id", "chain_seq", "trace_seq", F.coalesce("t._crs", F.lit(crs)).alias("crs"), F.posexplode("t.position").alias("pos_seq", "p"))
    return rows.select("vehicle_id", "chain_seq", "trace_seq", "pos_seq", "crs", calendar.parse_stamp(F.col("p._time")).alias("ts"), F.col("p._x").alias("x"), F.col("p._y").alias("y"), F.col("p._z").alias("z"))


def facilities_xml(spark: SparkSession, path: str) -> DataFrame:
    """facility_id, x, y, hull and activity count."""
    schema = "_id string, _x double, _y double, attributes struct<attribute:array<struct<_name:string,_VALUE:string>>>"
    raw = spark.read.format("xml").option("rowTag", "facility").schema(schema).load(path)
    value = lambda name: F.element_at(F.transform(F.filter("attributes.attribute", lambda a: a["_name"] == name), lambda a: a["_VALUE"]), 1)
    return raw.select(F.col("_id").alias("facility_id"), F.col("_x").alias("x"), F.col("_y").alias("y"), geo.decode_hull(value("concaveHull")).alias("hull"), value("digicoreActivityCount").cast("long").alias("activity_count"))


def network_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, arcs) of a node and arc file; an arc to a missing node is an error.

    A folder's files are one text in the order of their names: a section goes on
    over the ends of files and blocks until the next one begins.
    """
    block = ["_file", "_block"]
    order = Window.partitionBy(*block).orderBy("seq")
    head = F.when(F.trim("value").isin("NODES", "ARCS"), F.trim("value"))
    rows = lines(spark, path).select("*", F.col("seq.file").alias("_file"), F.col("seq.block").alias("_block"), head.alias("_head"))
    # one row a block: the section that was open where it begins
    ends = rows.groupBy(*block).agg(F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("seq.nth"))).alias("_last"))
    open_at = ends.select(*block, F.last("_last", ignorenulls=True).over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    own = F.last("_head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_own", own).join(open_at, block).withColumn("section", F.coalesce("_own", "_open"))
    parts = F.split("value", ",")
    nodes = rows.where((F.col("section") == "NODES") & (F.size(parts) == 3) & ~F.col("value").startswith("NodeId")).select(parts[0].alias("id"), parts[1].cast("double").alias("x"), parts[2].cast("double").alias("y"))
    arcs = rows.where((F.col("section") == "ARCS") & (F.size(parts) == 5) & ~F.col("value").startswith("From_Id")).select(parts[0].alias("o_id"), parts[1].alias("d_id"), parts[2].alias("o_type"), parts[3].alias("d_type"), parts[4].cast("long").alias("weight"))
    lost = arcs.select(F.explode(F.array("o_id", "d_id")).alias("id")).join(nodes, "id", "left_anti").limit(1).collect()
    if lost:
        raise OSError(f"an arc names the missing node {lost[0].id}")
    return nodes, arcs


def path_network_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, starts) of a path-dependent network, either version."""
    schema = "_id string, _x double, _y double, preceding array<struct<_id:string,following:array<struct<_id:string,_weight:double>>>>, startnode array<struct<_hour:int,_activities:long,_count:long>>"
    raw = spark.read.format("xml").option("rowTag", "node").schema(schema).load(path)
    edges = raw.select(F.col("_id").alias("node_id"), F.explode("preceding").alias("p")).select("node_id", F.col("p._id").alias("prev_id"), F.explode("p.following").alias("f"))
    starts = raw.select(F.col("_id").alias("node_id"), F.explode("startnode").alias("s")).select("node_id", F.col("s._hour").alias("hour"), F.col("s._activities").alias("activities"), F.col("s._count").alias("count"))
    return raw.select(F.col("_id").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y")), edges.select("prev_id", "node_id", F.col("f._id").alias("next_id"), F.col("f._weight").alias("weight")), starts


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="x double, y double")


def restrict(rows: DataFrame, ids: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def parse_shp(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Rings of each record of a .shp file: points count as rings of one point."""
    at, out = 100, []
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body = at + 8
        (kind,) = struct.unpack_from("<i", data, body)
        if kind in (1, 11, 21):
            out.append([[struct.unpack_from("<2d", data, body + 4)]])
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, body + 44 + 4 * parts)
            pairs = list(zip(flat[::2], flat[1::2], strict=True))
            out.append([pairs[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
        else:
            out.append([])
        at = body + 2 * words
    return out


def parse_dbf(data: bytes) -> list[dict[str, str]]:
    """Rows of a .dbf file, all as text."""
    n, head, size = struct.unpack_from("<iHH", data, 4)
    fields, at, place = [], 32, 1
    while data[at] != 0x0D:
        name, width = data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]
        fields.append((name, place, width))
        at, place = at + 32, place + width
    rows = [data[head + k * size : head + (k + 1) * size] for k in range(n)]
    return [{f: r[a : a + w].decode("latin-1").strip() for f, a, w in fields} for r in rows]


def zones_shapefile(spark: SparkSession, path: str, id_field: str) -> DataFrame:
    """zone_id and rings of each feature; Spark reads the two files, one task parses them.

    path: without its ending.
    """
    both = spark.read.format("binaryFile").load([f"{path}.shp", f"{path}.dbf"]).select(F.lit(1).alias("one"), F.right("path", F.lit(3)).alias("kind"), "content")
    pair = both.groupBy("one").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf")).select("shp", "dbf")

    def parse(frames):
        import pandas as pd

        for pdf in frames:
            for shp, dbf in zip(pdf["shp"], pdf["dbf"], strict=True):
                shapes, rows = parse_shp(bytes(shp)), parse_dbf(bytes(dbf))
                yield pd.DataFrame({"zone_id": [r[id_field] for r in rows], "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in s] for s in shapes]})

    return pair.mapInPandas(parse, "zone_id string, rings array<array<struct<x:double,y:double>>>")


def points_shapefile(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """x, y of each point feature, with the text of one attribute as code."""
    rows = zones_shapefile(spark, path, field) if field else _shapes(spark, path)
    first = F.col("rings")[0][0]
    out = rows.select(*([F.col("zone_id").alias("code")] if field else []), first["x"].alias("x"), first["y"].alias("y"))
    return out.where("x is not null")


def _shapes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").load(f"{path}.shp").select("content")

    def parse(frames):
        import pandas as pd

        for pdf in frames:
            for shp in pdf["content"]:
                yield pd.DataFrame({"rings": [[[{"x": x, "y": y} for x, y in ring] for ring in s] for s in parse_shp(bytes(shp))]})

    return raw.mapInPandas(parse, "rings array<array<struct<x:double,y:double>>>")


def buildings(spark: SparkSession, path: str, field: str = "S_LU_CODE") -> DataFrame:
    """Building points (code, x, y) in the equal-area conic, from degrees."""
    rows = points_shapefile(spark, path, field).withColumn("p", geo.to_albers(F.col("x"), F.col("y")))
    return rows.select("code", "p.x", "p.y")


def unique_vehicles(vehicles: DataFrame) -> DataFrame:
    """The same rows; an id that occurs twice is an error."""
    twice = vehicles.groupBy("_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"vehicle {twice[0]._id} is there twice")
    return vehicles
