"""Kernel density rasters in long form: (col, row, value).

A point spreads over the pixels of its box, never over the raster; pixel sums
are pre-aggregated.  The raster's origin is (least x, greatest y).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

CELL, UNIFORM, TRIANGULAR, TRIWEIGHT = range(4)


def _height(kind: int, u: Column, w: Column, r: float) -> Column:
    if kind == UNIFORM:
        return w / (2 * r)
    if kind == TRIANGULAR:
        return (w / r) * (1 - u)
    return F.lit(35 / 32) * w * F.pow(1 - u * u, 3)


def raster(points: DataFrame, kind: int, resolution: float, radius: float, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Sum of kernels over points (x, y, weight) strictly inside the extent.

    kind 0 adds 1 to the point's own pixel; 1 is uniform, 2 triangular, 3
    triweight.  The own pixel gets the kernel's height at its centre; other
    pixels count if their centre lies within the radius, else they get nothing.
    """
    if maxx - minx < resolution or maxy - miny < resolution:
        raise ValueError("the extent is smaller than a pixel")
    cols, rows = -(-(maxx - minx) // resolution), -(-(maxy - miny) // resolution)
    inside = points.where((F.col("x") > minx) & (F.col("x") < maxx) & (F.col("y") > miny) & (F.col("y") < maxy))
    own_col, own_row = F.floor((F.col("x") - minx) / resolution), F.floor((F.lit(maxy) - F.col("y")) / resolution)
    if kind == CELL:
        return inside.groupBy(own_col.cast("int").alias("col"), own_row.cast("int").alias("row")).agg(F.count("*").cast("double").alias("value"))
    reach = lambda v, least, most: F.explode(F.sequence(F.greatest(F.floor((v - radius) / resolution), F.lit(least)), F.least(F.floor((v + radius) / resolution), F.lit(most))))
    spread = inside.withColumn("own_col", own_col).withColumn("own_row", own_row).withColumn("col", reach(F.col("x") - minx, 0, int(cols) - 1)).withColumn("row", reach(F.lit(maxy) - F.col("y"), 0, int(rows) - 1))
    d = geo.distance(F.col("x"), F.col("y"), F.lit(minx) + (F.col("col") + 0.5) * resolution, F.lit(maxy) - (F.col("row") + 0.5) * resolution)
    own = (F.col("col") == F.col("own_col")) & (F.col("row") == F.col("own_row"))
    u, w = F.col("d") / radius, F.col("weight").cast("double")
    peak = {UNIFORM: w / (2 * radius), TRIANGULAR: w / radius, TRIWEIGHT: F.lit(35 / 32) * w}[kind]
    value = F.when(own, peak).when(F.col("d") <= radius, _height(kind, u, w, radius))
    return spread.withColumn("d", d).withColumn("own", own).withColumn("value", value).where("value is not null").groupBy(F.col("col").cast("int").alias("col"), F.col("row").cast("int").alias("row")).agg(F.sum("value").alias("value"))


def boxes(pixels: DataFrame, resolution: float, minx: float, maxy: float, area: Column | None = None) -> DataFrame:
    """Pixels as boxes, those whose centre the area contains; yMin is the upper bound, as the format has it."""
    x, y = F.lit(minx) + F.col("col") * resolution, F.lit(maxy) - F.col("row") * resolution
    out = pixels.select(x.alias("xMin"), (x + resolution).alias("xMax"), y.alias("yMin"), (y - resolution).alias("yMax"), F.col("value").alias("Value"))
    return out if area is None else out.where(geo.contains(area, (F.col("xMin") + F.col("xMax")) / 2, (F.col("yMin") + F.col("yMax")) / 2))


def alpha(pixels: DataFrame) -> DataFrame:
    """Pixels with their opacity, 0 to 255, as a share of the greatest."""
    top = pixels.agg(F.max("value").alias("top"))
    return pixels.join(top).select("col", "row", F.floor(F.col("value") / F.col("top") * 255).cast("int").alias("alpha"))


def land_use(buildings: DataFrame, size: float) -> DataFrame:
    """(code, col, row) to weight: buildings (code, x, y) by the main part of their code and square cell."""
    return buildings.groupBy(F.substring_index("code", ".", 1).alias("code"), geo.cell(F.col("x"), size).alias("col"), geo.cell(F.col("y"), size).alias("row")).agg(F.count("*").cast("double").alias("weight"))
