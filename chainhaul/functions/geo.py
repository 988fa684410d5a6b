"""Plane geometry as Column expressions, and the cell join.

Points are columns x, y; rings are array<struct<x,y>> columns, closed or not;
shapes are arrays of rings (outer rings and holes alike: the even-odd rule).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the WGS84 ellipsoid.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
_E2 = FLATTENING * (2 - FLATTENING)
RING = "array<struct<x:double,y:double>>"


def _edges(ring: Column) -> Column:
    """array of (a, b): each point with the next, the last with the first."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, F.when(i + 1 < F.size(ring), i + 2).otherwise(1).cast("int")).alias("b")))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    a, b = e["a"], e["b"]
    return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])


def _touches(e: Column, x: Column, y: Column) -> Column:
    a, b = e["a"], e["b"]
    turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    return (turn == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def on_boundary(ring: Column, x: Column, y: Column) -> Column:
    """One point equals, two points hold between them, more hold on an edge."""
    return F.exists(_edges(ring), lambda e: _touches(e, x, y))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting; the boundary is left to the caller."""
    return F.size(F.filter(_edges(ring), lambda e: F.coalesce(_crosses(e, x, y), F.lit(False)))) % 2 == 1


def contains(ring: Column, x: Column, y: Column) -> Column:
    """In the interior: the boundary is excluded."""
    return (F.size(ring) >= 3) & inside(ring, x, y) & ~on_boundary(ring, x, y)


def covers(ring: Column, x: Column, y: Column) -> Column:
    """In the interior or on the boundary; a point or a segment covers what lies on it."""
    return on_boundary(ring, x, y) | (F.size(ring) >= 3) & inside(ring, x, y)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """struct(x, y): of the area, of the segment for two points, of the mean if there is no area."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        cross = e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
        return F.struct((s["x"] + (e["a"]["x"] + e["b"]["x"]) * cross).alias("x"), (s["y"] + (e["a"]["y"] + e["b"]["y"]) * cross).alias("y"))

    total, a = F.aggregate(_edges(ring), zero, add), signed_area(ring)
    mean = F.aggregate(ring, zero, lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")), lambda s: F.struct((s["x"] / F.size(ring)).alias("x"), (s["y"] / F.size(ring)).alias("y")))
    return F.when(a == 0, mean).otherwise(F.struct((total["x"] / (6 * a)).alias("x"), (total["y"] / (6 * a)).alias("y")))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def envelope(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def encode_hull(ring: Column) -> Column:
    """(x;y),(x;y),...; nothing for a null or empty hull."""
    return F.coalesce(F.array_join(F.transform(ring, lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(";"), p["y"].cast("string"), F.lit(")"))), ","), F.lit(""))


def decode_hull(text: Column) -> Column:
    """Points of an encoded hull; null for an empty text."""
    pairs = F.split(F.regexp_replace(text, r"[()\s]", ""), ",")
    point = lambda p: F.struct(F.split(p, ";")[0].cast("double").alias("x"), F.split(p, ";")[1].cast("double").alias("y"))
    return F.when(F.length(F.trim(text)) > 0, F.transform(pairs, point))


def hull_kind(ring: Column) -> Column:
    n = F.size(ring)
    return F.when(n == 1, "Point").when(n == 2, "LineString").when(n >= 3, "Polygon")


def _meridian(lat: Column) -> Column:
    """Length of the meridian from the equator."""
    e2, e4, e6 = _E2, _E2**2, _E2**3
    return AXIS * ((1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * lat - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * lat) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * lat) - (35 * e6 / 3072) * F.sin(6 * lat))


def to_transverse_mercator(lon: Column, lat: Column, lon0: float = 29.0) -> Column:
    """struct(x, y) in metres, east and north, from degrees."""
    phi, e2 = F.radians(lat), _E2 / (1 - _E2)
    n = AXIS / F.sqrt(1 - _E2 * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), e2 * F.cos(phi) * F.cos(phi)
    a = F.cos(phi) * F.radians(lon - lon0)
    x = n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e2) * F.pow(a, 5) / 120)
    y = _meridian(phi) + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * e2) * F.pow(a, 6) / 720)
    return F.struct(x.alias("x"), y.alias("y"))


def from_transverse_mercator(x: Column, y: Column, lon0: float = 29.0) -> Column:
    """struct(lon, lat) in degrees."""
    e2 = _E2 / (1 - _E2)
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    mu = y / (AXIS * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    c, t = e2 * F.cos(p) * F.cos(p), F.tan(p) * F.tan(p)
    s = 1 - _E2 * F.sin(p) * F.sin(p)
    n, r = AXIS / F.sqrt(s), AXIS * (1 - _E2) / F.pow(s, 1.5)
    d = x / n
    lat = p - n * F.tan(p) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * e2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * e2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * e2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(p)
    return F.struct((F.degrees(lon) + lon0).alias("lon"), F.degrees(lat).alias("lat"))


def to_albers(lon: Column, lat: Column, lon0: float = 24.0, lat0: float = 0.0, lat1: float = -18.0, lat2: float = -32.0) -> Column:
    """struct(x, y): equal-area conic of the ellipsoid; the parallels are parameters."""
    e = math.sqrt(_E2)

    def q(s, log):
        return (1 - _E2) * (s / (1 - _E2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - _E2 * math.sin(math.radians(d)) ** 2)
    q0, q1, q2 = (q(math.sin(math.radians(d)), math.log) for d in (lat0, lat1, lat2))
    n = (m(lat1) ** 2 - m(lat2) ** 2) / (q2 - q1)
    c = m(lat1) ** 2 + n * q1
    rho = AXIS * F.sqrt(c - n * q(F.sin(F.radians(lat)), F.log)) / n
    rho0 = AXIS * math.sqrt(c - n * q0) / n
    theta = n * F.radians(lon - lon0)
    return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def cell_join(points: DataFrame, shapes: DataFrame, size: float, box: Column, how: str = "inner") -> DataFrame:
    """Points (x, y) with the shapes whose boxes reach their cell: an equi-join on grid cells.

    box: struct(minx, miny, maxx, maxy) over the columns of shapes; names must
    not clash.  The caller adds the exact predicate.  A shape costs one row a
    cell that its box touches.
    """
    spread = shapes.withColumn("_b", box).withColumn("_cx", F.explode(F.sequence(cell(F.col("_b.minx"), size), cell(F.col("_b.maxx"), size)))).withColumn("_cy", F.explode(F.sequence(cell(F.col("_b.miny"), size), cell(F.col("_b.maxy"), size)))).drop("_b")
    keyed = points.withColumn("_px", cell(F.col("x"), size)).withColumn("_py", cell(F.col("y"), size))
    return keyed.join(spread, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")), how).drop("_px", "_py", "_cx", "_cy")
