import struct

import pytest
from pyspark.sql import functions as F

from chainhaul.functions import calendar
from chainhaul.sources import readers, writers


def test_raw_gps(spark, tmp_path):
    p = tmp_path / "201001.csv"
    p.write_text("100,-20.5,25.25,60,015,7\nbad,line\n101,-20,x,1,2,7\n102,-21,26,5,3,8\n103,-22,27,5,3,8,9\n")
    where = {"time": 0, "lat": 1, "lon": 2, "speed": 3, "status": 4, "vehicle_id": 5}
    got = readers.raw_gps(spark, str(p), where).orderBy("time").collect()
    assert [(r.vehicle_id, r.time, r.lon, r.lat, r.status, r.speed) for r in got] == [("7", 100, 25.25, -20.5, "15", 60), ("8", 102, 26.0, -21.0, "3", 5)]
    assert readers.raw_gps(spark, str(p), where, start_line=1, most_lines=3).count() == 1
    r = readers.time_range(readers.raw_gps(spark, str(p), where)).first()
    assert (r.first_time, r.last_time) == (100, 102)


def test_sorted_files_bare_cr(spark, tmp_path):
    (tmp_path / "17.txt").write_bytes(b"VehicleId,Time,Long,Lat,Status,Speed\r17,5,20,-20,15,0\r17,9,20,-20,0,0\r")
    got = readers.sorted_vehicle_files(spark, str(tmp_path)).orderBy("time").collect()
    assert [(r.vehicle_id, r.time, r.status) for r in got] == [("17", 5, "15"), ("17", 9, "0")]


def test_status_and_days(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Start,1,2\nStop,15\n")
    assert readers.status_codes(spark, str(tmp_path / "s.csv")) == (["1", "2"], ["15"])
    (tmp_path / "bad.csv").write_text("Start,1\nOther,2\n")
    with pytest.raises(ValueError):
        readers.status_codes(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "d.txt").write_text("2010/01/02\nrubbish\n2010/02/01\n")
    assert [r.day_of_year for r in readers.abnormal_days(spark, str(tmp_path / "d.txt")).orderBy("date").collect()] == [2, 32]


def chain(spark):
    acts = spark.createDataFrame([("1", 0, k, t, 1000 * k, 1000 * k + 500, float(k), -1.5, f) for k, (t, f) in enumerate([("major", "f&1"), ("minor", None), ("major", "f2")])], "vehicle_id string, chain_seq int, act_seq int, type string, start_ts long, end_ts long, x double, y double, facility_id string")
    pos = spark.createDataFrame([("1", 0, t, p, 500 + 1000 * t + p, 1.0 + p, 1.0) for t in range(2) for p in range(5)], "vehicle_id string, chain_seq int, trace_seq int, pos_seq int, ts long, x double, y double")
    return acts, pos


@pytest.mark.parametrize("traces", [True, False])
def test_vehicles_round_trip(spark, tmp_path, traces):
    acts, pos = chain(spark)
    writers.write_vehicles(acts, pos if traces else None, str(tmp_path / "out"), crs="Atlantis", description="test")
    back = readers.vehicles_xml(spark, str(tmp_path / "out"))
    cols = ["vehicle_id", "chain_seq", "act_seq", "type", "start_ts", "end_ts", "x", "y", "facility_id"]
    assert sorted(map(tuple, readers.xml_activities(back).select(*cols).collect())) == sorted(map(tuple, acts.collect()))
    got = readers.xml_positions(back, "Atlantis").collect()
    assert len(got) == (10 if traces else 0) and {r.crs for r in got} <= {"Atlantis"}
    if traces:
        assert sorted((r.trace_seq, r.pos_seq, r.ts, r.x) for r in got)[0] == (0, 0, 500, 1.0)
    root = readers.container_attributes(spark, str(tmp_path / "out")).first()
    assert (root.crs, root.description) == ("Atlantis", "test")
    with pytest.raises(ValueError):
        writers.write_vehicles(acts, pos, str(tmp_path / "other"), crs="A", trace_crs="B")


def test_network_text_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("1", 0.5, 1.0), ("2", 2.0, 3.0)], "id string, x double, y double")
    mx = spark.createDataFrame([("1", "2", "a", "b", 3)], "o_id string, d_id string, o_type string, d_type string, weight long")
    path = str(tmp_path / "net")
    writers.write_network(nodes.coalesce(1), mx, path)
    n, a = readers.network_text(spark, path)
    assert sorted(map(tuple, n.collect())) == [("1", 0.5, 1.0), ("2", 2.0, 3.0)] and [tuple(r) for r in a.collect()] == [("1", "2", "a", "b", 3)]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        writers.write_network(nodes, mx, path)
    (tmp_path / "bad.txt").write_text("NODES\nNodeId,Long,Lat\n1,0,0\nARCS\nFrom_Id,To_Id,From_Type,To_Type,Weight\n1,9,a,a,1\n")
    with pytest.raises(OSError, match="9"):
        readers.network_text(spark, str(tmp_path / "bad.txt"))


def test_network_text_in_many_files(spark, tmp_path):
    # as a large network is written: sections begin in one file and go on in others
    arcs = [(str(k), str((k * 7 + 1) % 50), "a", "b", k + 1) for k in range(50)]
    lines = ["NODES", "NodeId,Long,Lat", *(f"{k},{k}.5,1.0" for k in range(50)), "ARCS", "From_Id,To_Id,From_Type,To_Type,Weight", *(",".join(map(str, a)) for a in arcs)]
    (tmp_path / "net").mkdir()
    for part, at in enumerate(range(0, len(lines), 9)):
        (tmp_path / "net" / f"part-{part:05d}.txt").write_text("\n".join(lines[at : at + 9]) + "\n")
    n, a = readers.network_text(spark, str(tmp_path / "net"))
    assert sorted(int(r.id) for r in n.collect()) == list(range(50))
    assert sorted(tuple(r) for r in a.collect()) == sorted(arcs)
    # and blocks of one file
    (tmp_path / "one.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    try:
        n, a = readers.network_text(spark, str(tmp_path / "one.txt"))
        assert n.count() == 50 and sorted(tuple(r) for r in a.collect()) == sorted(arcs)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_path_network_and_facilities_xml(spark, tmp_path):
    nodes = spark.createDataFrame([("A", 1.0, 2.0), ("B", 3.0, 4.0)], "id string, x double, y double")
    edges = spark.createDataFrame([("source", "A", "B", 2.0)], "prev_id string, node_id string, next_id string, weight double")
    ctx = spark.createDataFrame([("source", "A"), ("A", "B")], "prev_id string, node_id string")
    starts = spark.createDataFrame([("A", 8, 2, 5)], "node_id string, hour int, activities long, count long")
    lines = [r.text for r in writers.path_network_elements(nodes, edges, ctx, starts).orderBy("id").collect()]
    (tmp_path / "p.xml").write_text("<digicoreNetwork>\n" + "\n".join(lines) + "\n</digicoreNetwork>")
    n, e, s = readers.path_network_xml(spark, str(tmp_path / "p.xml"))
    assert sorted(map(tuple, n.collect())) == [("A", 1.0, 2.0), ("B", 3.0, 4.0)]
    assert sorted(map(tuple, e.collect())) == [("A", "B", "sink", 1.0), ("source", "A", "B", 2.0)]
    assert [tuple(r) for r in s.collect()] == [("A", 8, 2, 5)]
    f = spark.createDataFrame([("f1", 1.0, 2.0, [(0.0, 0.0), (1.0, 0.0)], 7)], "facility_id string, x double, y double, hull array<struct<x:double,y:double>>, activity_count long")
    (tmp_path / "f.xml").write_text("<facilities>" + writers.facility_elements(f).first().value + "</facilities>")
    got = readers.facilities_xml(spark, str(tmp_path / "f.xml")).first()
    assert (got.facility_id, got.activity_count, len(got.hull)) == ("f1", 7, 2)
    assert writers.facilities_csv(f).first().x == "1.0"


def shapefile(path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 2, 2, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    records = b"".join(struct.pack(">2i", k + 1, len(body) // 2) + body for k in range(2))
    (path.parent / f"{path.name}.shp").write_bytes(b"\0" * 100 + records)
    field = b"ID".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15
    head = b"\x03" + b"\0" * 3 + struct.pack("<iHH", 2, 32 + 32 + 1, 6) + b"\0" * 20
    (path.parent / f"{path.name}.dbf").write_bytes(head + field + b"\x0d" + b" zone1 zone2")


def test_shapefile(spark, tmp_path):
    shapefile(tmp_path / "z")
    got = readers.zones_shapefile(spark, str(tmp_path / "z"), "ID").orderBy("zone_id").collect()
    assert [r.zone_id for r in got] == ["zone1", "zone2"] and len(got[0].rings[0]) == 4


def test_restrict_and_plan(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "vehicle_id string")
    assert [r.vehicle_id for r in readers.restrict(rows, spark.createDataFrame([("b",), ("b",)], "value string")).collect()] == ["b"]
    plans = spark.createDataFrame([("p_0", 0, "activity", "major", "A", 1.0, 2.0, 3600.0, None), ("p_0", 1, "leg", "commercial", None, None, None, None, None)], "person_id string, elem_seq int, kind string, type string, facility_id string, x double, y double, end_time double, max_dur double")
    text = writers.plan_elements(plans).first().text
    assert 'end_time="3600.0"' in text and "<leg" in text and "max_dur" not in text


def test_stamp_round_trip(spark):
    df = spark.range(0, 10**9, 123456789).select(F.col("id").alias("t"))
    assert df.where(calendar.parse_stamp(calendar.stamp(F.col("t"))) != F.col("t")).count() == 0
    assert spark.range(1).select(calendar.parse_stamp(F.lit("rubbish")).alias("t")).first().t is None


def test_exports(spark, tmp_path):
    from chainhaul.operators import sample
    from chainhaul.sources import exports

    gps = spark.createDataFrame([("a", 2, 20, 1.0, -1.0, "0", 5), ("a", 1, 10, 1.0, -1.0, "0", 5), ("b", 1, 5, 2.0, -2.0, "1", 6)], "vehicle_id string, seq long, time long, lon double, lat double, status string, speed int")
    exports.split_by_vehicle(gps, str(tmp_path / "split"))
    exports.split_by_vehicle(gps, str(tmp_path / "split"))
    assert spark.read.csv(str(tmp_path / "split")).count() == 6
    exports.sorted_vehicle_csv(gps, str(tmp_path / "sorted"))
    got = spark.read.option("header", True).csv(str(tmp_path / "sorted")).where("vId = 'a'").collect()
    assert [r.time for r in got] == ["10", "20"]
    v = gps.select("vehicle_id").distinct()
    assert exports.collate([v.where("vehicle_id = 'a'"), v.where("vehicle_id = 'b'")]).count() == 2
    with pytest.raises(ValueError):
        exports.collate([v, v])
    acts, pos = chain(spark)
    writers.write_vehicles(acts, pos, str(tmp_path / "v2"), description="d")
    exports.without_traces(spark, str(tmp_path / "v2"), str(tmp_path / "v1"))
    back = readers.vehicles_xml(spark, str(tmp_path / "v1"))
    assert readers.xml_activities(back).count() == 3 and readers.xml_positions(back).count() == 0
    assert readers.unique_vehicles(back).count() == 1
    clustered = spark.createDataFrame([("z", 0, 1.0, 2.0), ("z", 0, 1.0, 2.0), ("z", None, 5.0, 5.0)], "zone_id string, cluster_id long, x double, y double")
    assert exports.facility_points(clustered).count() == 1 and exports.lost_points(clustered).count() == 1
    drawn = spark.createDataFrame([(0, "1", 0), (1, "1", 0)], "draw long, vehicle_id string, chain_seq int")
    plans = sample.bootstrap_plans(acts, drawn, "p").where("person_id = 'p_1'").orderBy("elem_seq").collect()
    assert [r.kind for r in plans] == ["activity", "leg", "activity", "leg", "activity"]
    assert (plans[0].end_time, plans[2].max_dur, plans[4].start_time) == (7200 + 500, 500, 7200 + 2000)


def test_points_shapefile(spark, tmp_path):
    body = struct.pack("<i2d", 1, 18.5, -33.9)
    (tmp_path / "p.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    assert [tuple(r) for r in readers.points_shapefile(spark, str(tmp_path / "p")).collect()] == [(18.5, -33.9)]
