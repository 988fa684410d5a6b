import numpy as np
import pytest
from pyspark.sql import functions as F

from chainhaul.functions import calendar, geo
from chainhaul.operators import cluster, hull, kde, similarity


def test_dj_cluster_golden():
    p = np.array([(2, 1), (1, 2), (1, 3), (1, 4), (2, 5), (3, 4), (3, 3), (3, 2), (7, 3), (6, 4), (7, 5), (8, 4), (4, 7), (5, 7)], dtype=float)
    label = cluster.dj_labels(p[:, 0], p[:, 1], 2, 3)
    assert sorted(np.bincount(label[label >= 0])) == [4, 8]
    assert (label == -1).sum() == 2


def test_dj_cluster_order_and_merge():
    y = np.zeros(5)
    # a point that sees two clusters makes them one; the radius includes its bound
    assert set(cluster.dj_labels(np.array([0.0, 1.0, 4.0, 3.0, 2.0]), y, 1.0, 2)) == {0}
    # one that was absorbed before is not expanded: the order of visits matters
    assert sorted(set(cluster.dj_labels(np.array([0.0, 1.0, 3.0, 4.0, 2.0]), y, 1.0, 2))) == [0, 1]
    assert set(cluster.dj_labels(np.array([0.0, 1.0, 4.0, 3.0, 2.0]), y, 1.0, 4)) == {-1}


def test_cluster_frame(spark):
    rows = [("a", k, float(k % 3), 0.0) for k in range(9)] + [("b", 100, 5.0, 5.0)]
    got = {r.point_id: r.cluster_id for r in cluster.cluster(spark.createDataFrame(rows, "zone_id string, point_id long, x double, y double"), 1.5, 5).collect()}
    assert got[100] is None and set(got[k] for k in range(9)) == {0}


def test_concave_hull():
    square = [(0, 0), (4, 0), (0, 4), (4, 4), (2, 1), (3, 2), (2, 3), (1, 2)]
    ring = hull.concave_hull(np.array(square + square[:4], dtype=float), 1.0)
    assert len(ring) > 3 and (ring[0] == ring[-1]).all()
    assert len(hull.concave_hull(np.zeros((4, 2)))) == 1
    assert len(hull.concave_hull(np.array([[0, 0], [1, 1.0]]))) == 2
    assert len(hull.concave_hull(np.array([[0, 0], [1, 1], [2, 2], [3, 3.0]]))) == 1
    far = hull.concave_hull(np.array(square, dtype=float), 100.0)
    assert hull.centroid(far) == pytest.approx((2, 2))


def test_delaunay_empty_circles():
    p = np.random.default_rng(1).random((60, 2))
    t = hull.triangulate(p)
    area = sum(abs(np.cross(np.append(p[b] - p[a], 0), np.append(p[c] - p[a], 0))[2]) / 2 for a, b, c in t)
    ring = hull.convex_hull(p)
    x, y = ring[:, 0], ring[:, 1]
    assert area == pytest.approx(abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2, rel=1e-3)


def test_delaunay_of_many_points():
    import time

    # a point costs the same among many: a cluster of tables 6 times sf0.1 has as many
    p = np.unique(np.random.default_rng(2).integers(0, 2000, (12_000, 2)).astype(float), axis=0)
    began = time.process_time()
    t = hull.triangulate(p)
    assert time.process_time() - began < 30
    area = sum(abs((p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])) / 2 for a, b, c in t)
    assert area == pytest.approx(1999.0**2, rel=5e-3)
    sides = [e for a, b, c in t for e in ((a, b), (b, c), (a, c))]
    assert max(sides.count(e) for e in sides[:50]) <= 2


def test_delaunay_of_points_on_circles():
    # of points on one circle the last is joined with all
    p = np.array([(i, j) for i in range(5) for j in range(5)], dtype=float)
    want = {t for i in range(4) for j in range(4) for t in ((5 * i + j, 5 * i + j + 1, 5 * i + j + 6), (5 * i + j, 5 * i + j + 5, 5 * i + j + 6))}
    assert set(hull.triangulate(p)) == want


def test_hull_codec(spark):
    rows = [([(0.0, 0.0)],), ([(0.0, 0.0), (5.0, 0.0)],), ([(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0), (0.0, 0.0)],), (None,)]
    df = spark.createDataFrame(rows, f"hull {geo.RING}").withColumn("text", geo.encode_hull(F.col("hull")))
    got = df.withColumn("back", geo.decode_hull(F.col("text"))).withColumn("kind", geo.hull_kind(F.col("hull"))).collect()
    assert [r.text for r in got] == ["(0.0;0.0)", "(0.0;0.0),(5.0;0.0)", "(0.0;0.0),(5.0;0.0),(5.0;5.0),(0.0;5.0),(0.0;0.0)", ""]
    assert all(r.back == r.hull for r in got)
    assert [r.kind for r in got][:3] == ["Point", "LineString", "Polygon"]


def test_predicates(spark):
    ring = geo.rectangle(*map(F.lit, (0.0, 0.0, 4.0, 4.0)))
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 2.0), (4.0, 4.0), (5.0, 1.0)], "x double, y double")
    got = df.select(geo.contains(ring, F.col("x"), F.col("y")).alias("i"), geo.covers(ring, F.col("x"), F.col("y")).alias("c")).collect()
    assert [(r.i, r.c) for r in got] == [(True, True), (False, True), (False, True), (False, False)]


def test_projection(spark):
    df = spark.createDataFrame([(29.0, 0.0), (28.0, -26.0), (31.5, -30.25)], "lon double, lat double").withColumn("p", geo.to_transverse_mercator(F.col("lon"), F.col("lat")))
    got = df.withColumn("q", geo.from_transverse_mercator(F.col("p.x"), F.col("p.y"))).collect()
    assert got[0].p.x == 0 and got[0].p.y == pytest.approx(0, abs=1e-6)
    for r in got:
        assert r.q.lon == pytest.approx(r.lon, abs=1e-7) and r.q.lat == pytest.approx(r.lat, abs=1e-7)


def test_calendar(spark):
    assert len(calendar.months()) == 53 and calendar.months()[0] == "201001" and calendar.months()[-1] == "201405"
    r = spark.createDataFrame([(1349330400,)], "t long").select(calendar.day_of_week(F.col("t")).alias("d"), calendar.stamp(F.col("t")).alias("s"), calendar.parse_stamp(calendar.stamp(F.col("t"))).alias("t")).first()
    assert (r.d, r.s, r.t) == (5, "20121004 08:00:00", 1349330400)


def test_buffer_overlap():
    p, q = np.array([(0.5, 0.5), (0.5, 2.5)]), np.array([(0.5, 2.5), (2.5, 2.5)])
    same = similarity.overlap(p, p, 0.5)
    assert same == pytest.approx(1, abs=1e-9)
    # each buffer: 2 + pi/4; both: three quarters of a disk and a square corner
    cap = np.pi * 0.25
    both = 0.25 + 0.75 * cap
    assert similarity.overlap(p, q, 0.5, 4000) == pytest.approx(both / (2 * (2 + cap) - both), abs=2e-3)


def test_kde_own_pixel_and_reach(spark):
    pts = spark.createDataFrame([(5.0, 5.0, 2.0)], "x double, y double, weight double")
    got = {(r.col, r.row): r.value for r in kde.raster(pts, kde.UNIFORM, 10.0, 10.0, 0.0, 0.0, 30.0, 30.0).collect()}
    assert got == {(0, 2): 0.1, (1, 2): 0.1, (0, 1): 0.1}
    assert kde.raster(pts, kde.CELL, 10.0, 10.0, 0.0, 0.0, 30.0, 30.0).collect()[0].value == 1.0
    with pytest.raises(ValueError):
        kde.raster(pts, kde.CELL, 100.0, 10.0, 0.0, 0.0, 30.0, 30.0)


def test_overlap_of_long_legs():
    p, q = np.array([(0.0, 0.0), (200e3, 0.0), (200e3, 50e3)]), np.array([(0.0, 0.0), (200e3, 0.0)])
    assert similarity.overlap(p, q, 100.0) == pytest.approx(0.8, abs=1e-3)
    assert similarity.overlap(p, p[:, ::-1] - 1e6, 100.0) == 0
    assert similarity.overlap(q[:1], q[:1], 100.0) == pytest.approx(1)
