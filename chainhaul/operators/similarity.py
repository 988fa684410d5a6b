"""Similarity of a vehicle's chains: by position of facilities, and by overlap of buffered paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHAIN = ("vehicle_id", "chain_seq")


def known_places(acts: DataFrame) -> DataFrame:
    """Activities with a facility each: those without take the nearest place without one of their vehicle.

    Distinct places without a facility get ids of their own, a0, a1, ... in
    (x, y) order, so an activity's nearest is the one at its own place.
    """
    own = acts.where("facility_id is null").select("vehicle_id", "x", "y").distinct()
    own = own.withColumn("own_id", F.concat(F.lit("a"), F.row_number().over(Window.partitionBy("vehicle_id").orderBy("x", "y")) - 1))
    out = acts.join(own, ["vehicle_id", "x", "y"], "left")
    return out.withColumn("facility_id", F.coalesce("facility_id", "own_id")).drop("own_id")


def position_dissimilarity(acts: DataFrame, penalty: float) -> DataFrame:
    """vehicle_id, chain_1, chain_2, dissimilarity for each pair of a vehicle's chains.

    Over the vehicle's facilities: the squared difference of first positions,
    or the penalty where either chain lacks the facility.  Facilities in
    neither chain of a pair count the penalty too: their number is what the
    vehicle has less what the pair shares, so only shared ones are joined.
    """
    first = known_places(acts).groupBy("vehicle_id", "chain_seq", "facility_id").agg(F.min("act_seq").alias("pos"))
    total = first.groupBy("vehicle_id").agg(F.count_distinct("facility_id").alias("facilities"))
    chains = first.select(*CHAIN).distinct()
    a, b = chains.withColumnRenamed("chain_seq", "chain_1"), chains.withColumnRenamed("chain_seq", "chain_2")
    pairs = a.join(b, "vehicle_id").where("chain_1 < chain_2")
    p = first.select("vehicle_id", "facility_id", F.col("chain_seq").alias("chain_1"), F.col("pos").alias("pos_1"))
    q = first.select("vehicle_id", "facility_id", F.col("chain_seq").alias("chain_2"), F.col("pos").alias("pos_2"))
    d = F.col("pos_1") - F.col("pos_2")
    shared = p.join(q, ["vehicle_id", "facility_id"]).where("chain_1 < chain_2").groupBy("vehicle_id", "chain_1", "chain_2").agg(F.count("*").alias("both"), F.sum(d * d).alias("apart"))
    out = pairs.join(shared, ["vehicle_id", "chain_1", "chain_2"], "left").join(total, "vehicle_id")
    score = F.coalesce("apart", F.lit(0)) + (F.col("facilities") - F.coalesce("both", F.lit(0))) * F.lit(float(penalty))
    return out.select("vehicle_id", "chain_1", "chain_2", score.cast("double").alias("dissimilarity"))


def _spans(points: np.ndarray, d: float, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the y interval within d of each leg (rows) at each x (columns); low > high where there is none."""
    a = points[:-1] if len(points) > 1 else points
    b = points[1:] if len(points) > 1 else points
    low, high = np.full((len(a), len(xs)), np.inf), np.full((len(a), len(xs)), -np.inf)
    for c in (a, b):
        h = d * d - (xs - c[:, :1]) ** 2
        reach = h >= 0
        h = np.sqrt(np.maximum(h, 0))
        low = np.where(reach, np.minimum(low, c[:, 1:] - h), low)
        high = np.where(reach, np.maximum(high, c[:, 1:] + h), high)
    step = b - a
    n = np.hypot(step[:, 0], step[:, 1])[:, None]
    normal = np.stack([-step[:, 1], step[:, 0]], axis=1) / np.maximum(n, 1e-300)
    for sign in (-d, d):  # the two edges of the band around a leg, where they cross x
        foot = a + normal * sign
        with np.errstate(divide="ignore", invalid="ignore"):
            u = (xs - foot[:, :1]) / step[:, :1]
            y = foot[:, 1:] + u * step[:, 1:]
        on = (n > 0) & (np.abs(step[:, :1]) > 1e-12 * n) & (u >= 0) & (u <= 1)
        low, high = np.where(on, np.minimum(low, y), low), np.where(on, np.maximum(high, y), high)
    return low, high


def _covered(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Length of the union of the intervals of each column."""
    order = np.argsort(low, axis=0)
    low, high = np.take_along_axis(low, order, 0), np.take_along_axis(high, order, 0)
    upto = np.maximum.accumulate(high, axis=0)
    before = np.vstack([np.full((1, low.shape[1]), -np.inf), upto[:-1]])
    return np.maximum(high - np.maximum(low, before), 0, where=np.isfinite(high), out=np.zeros_like(high)).sum(axis=0)


def _breaks(points: np.ndarray, d: float) -> np.ndarray:
    """Where a path's buffer may change its form: the ends of the caps and the corners of the bands."""
    step = np.diff(points, axis=0)
    n = np.hypot(step[:, 0], step[:, 1])
    off = (d * step[:, 1] / np.maximum(n, 1e-300))[n > 0]
    ends = [points[:, 0] - d, points[:, 0] + d]
    for side in (points[:-1, 0][n > 0], points[1:, 0][n > 0]):
        ends += [side - off, side + off]
    return np.concatenate(ends)


def overlap(p: np.ndarray, q: np.ndarray, d: float, steps: int = 24) -> float:
    """Area of the intersection over that of the union of two paths' buffers.

    The x axis is cut wherever either buffer may change its form; each piece is
    integrated by ``steps`` strips that are narrow at its ends, where caps are
    steep.  So nothing falls between strips, however long the paths are.
    """
    edges = np.unique(np.concatenate([_breaks(p, d), _breaks(q, d)]))
    angle = (np.arange(steps) + 0.5) * np.pi / steps
    place, weight = (1 - np.cos(angle)) / 2, np.sin(angle) * np.sin(np.pi / (2 * steps))
    xs = (edges[:-1, None] + np.diff(edges)[:, None] * place).ravel()
    w = (np.diff(edges)[:, None] * weight).ravel()
    area = np.zeros(3)
    for k in range(0, len(xs), 4096):
        own = xs[k : k + 4096]
        s, t = _spans(p, d, own), _spans(q, d, own)
        for j, (low, high) in enumerate((s, t, (np.vstack([s[0], t[0]]), np.vstack([s[1], t[1]])))):
            area[j] += (_covered(low, high) * w[k : k + 4096]).sum()
    return float((area[0] + area[1] - area[2]) / area[2]) if area[2] else 0.0


def chain_overlap(acts: DataFrame, d: float = 100.0) -> DataFrame:
    """vehicle_id, chain_1, chain_2, overlap: Jaccard of the chains' buffers; a row a pair goes to Python, no group."""
    paths = acts.groupBy(*CHAIN).agg(F.array_sort(F.collect_list(F.struct("act_seq", "x", "y"))).alias("path"))
    a = paths.select("vehicle_id", F.col("chain_seq").alias("chain_1"), F.col("path").alias("p"))
    b = paths.select("vehicle_id", F.col("chain_seq").alias("chain_2"), F.col("path").alias("q"))
    pairs = a.join(b, "vehicle_id").where("chain_1 < chain_2")

    @F.pandas_udf("double")
    def measure(p: pd.Series, q: pd.Series) -> pd.Series:
        points = lambda path: np.array([(s["x"], s["y"]) for s in path], dtype=float)
        return pd.Series([overlap(points(u), points(v), d) for u, v in zip(p, q, strict=True)])

    return pairs.select("vehicle_id", "chain_1", "chain_2", measure("p", "q").alias("overlap"))
