"""Density-joinable clusters of activity places, by zone, and their facilities.

The algorithm visits points in order and its result depends on that order, so a
zone's points are clustered together in one grouped-map call, in the canonical
order (order column); a grid of radius-wide cells finds neighbours.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hull

RADIUS, MIN_POINTS = 16.6, 11


def dj_labels(x: np.ndarray, y: np.ndarray, radius: float = RADIUS, min_points: int = MIN_POINTS) -> np.ndarray:
    """Cluster of each point, -1 for noise; numbered densely by first member.

    A point without a cluster looks at its neighbours within the radius, itself
    included: too few make it noise for now; if any has a cluster, all their
    clusters become one and the rest join it; else they make a new one.  A
    point that was only absorbed is not expanded.  Small clusters go at last.
    """
    n = len(x)
    cells: dict[tuple[int, int], list[int]] = defaultdict(list)
    cx, cy = np.floor(x / radius).astype(np.int64), np.floor(y / radius).astype(np.int64)
    for k in range(n):
        cells[cx[k], cy[k]].append(k)
    label = np.full(n, -1, dtype=np.int64)
    parent: list[int] = []

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    for k in range(n):
        if label[k] >= 0:
            continue
        near = np.array([j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((cx[k] + a, cy[k] + b), ())])
        near = near[(x[near] - x[k]) ** 2 + (y[near] - y[k]) ** 2 <= radius * radius]
        if len(near) < min_points:
            continue
        old = {root(c) for c in label[near].tolist() if c >= 0}
        if old:
            own = min(old)
            for c in old:
                parent[c] = own
        else:
            own = len(parent)
            parent.append(own)
        label[near[label[near] < 0]] = own
    final = np.array([root(c) if c >= 0 else -1 for c in label.tolist()], dtype=np.int64)
    if not len(final):
        return final
    sizes = np.bincount(final[final >= 0], minlength=len(parent) + 1)
    final[(final >= 0) & (sizes[final] < min_points)] = -1
    kept, first = np.unique(final[final >= 0], return_index=True)
    order = np.argsort(first)
    dense = {int(c): k for k, c in enumerate(kept[order])}
    return np.array([dense.get(int(c), -1) for c in final], dtype=np.int64)


def cluster(points: DataFrame, radius: float = RADIUS, min_points: int = MIN_POINTS) -> DataFrame:
    """points (zone_id, point_id, x, y) with cluster_id, null for noise; visited by point_id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", kind="stable")
        label = dj_labels(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), radius, min_points)
        return pdf.assign(cluster_id=pd.array(np.where(label < 0, 0, label), dtype="Int64").astype("Int64")).assign(cluster_id=lambda d: d["cluster_id"].mask(label < 0))

    return points.select("zone_id", "point_id", "x", "y").groupBy("zone_id").applyInPandas(run, "zone_id string, point_id long, x double, y double, cluster_id long")


def facilities(clustered: DataFrame, threshold: float = 10.0) -> DataFrame:
    """facility_id, zone_id, cluster_id, x, y, activity_count, hull, hull_kind of each cluster.

    Facilities are numbered over zones and clusters in order, within zones by
    rank and across them by running totals of one row a zone.
    """

    def shape(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull.concave_hull(pdf[["x", "y"]].to_numpy(float), threshold)
        cx, cy = hull.centroid(ring)
        return pd.DataFrame({"zone_id": [key[0]], "cluster_id": [key[1]], "x": [cx], "y": [cy], "activity_count": [len(pdf)], "hull": [[{"x": a, "y": b} for a, b in ring.tolist()]]})

    shapes = clustered.where("cluster_id is not null").groupBy("zone_id", "cluster_id").applyInPandas(shape, "zone_id string, cluster_id long, x double, y double, activity_count long, hull array<struct<x:double,y:double>>")
    totals = clustered.where("cluster_id is not null").groupBy("zone_id").agg((F.max("cluster_id") + 1).alias("n"))
    before = totals.select(F.col("zone_id").alias("z"), F.coalesce(F.sum("n").over(Window.orderBy("zone_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = shapes.join(before, F.col("zone_id") == F.col("z"))
    return out.select((F.col("before") + F.col("cluster_id")).cast("string").alias("facility_id"), "zone_id", "cluster_id", "x", "y", "activity_count", "hull", F.when(F.size("hull") == 1, "Point").when(F.size("hull") == 2, "LineString").otherwise("Polygon").alias("hull_kind"))


def sweep(points: DataFrame, parameters: list[tuple[float, int]]) -> DataFrame:
    """Clusters for several (radius, min_points): one plan, results side by side."""
    out = None
    for radius, least in parameters:
        one = cluster(points, radius, least).withColumn("radius", F.lit(float(radius))).withColumn("min_points", F.lit(int(least)))
        out = one if out is None else out.unionByName(one)
    return out


def centres(clustered: DataFrame) -> DataFrame:
    """Size and mean place of each cluster."""
    return clustered.where("cluster_id is not null").groupBy("zone_id", "cluster_id").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
