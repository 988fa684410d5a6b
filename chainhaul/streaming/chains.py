"""Streams of position records: windowed counts, and activities found as records arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "vehicle_id string, start_ts long, end_ts long, x double, y double, type string"
STATE = "last_time long, moving boolean, first_time long, sx double, sy double, n long"


def hourly_counts(activities: DataFrame, late: str = "1 hour") -> DataFrame:
    """Activities by type and hour of their start (ts timestamp); records later than the watermark are dropped."""
    return activities.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "type", "n")


def activities(gps: DataFrame, start: list[str], stop: list[str], activity_seconds: int, major_seconds: int, idle: str = "2 days") -> DataFrame:
    """Activities of a stream (vehicle_id, seq, time, lon, lat, status, ts), emitted when the closing record comes.

    State is one open run a vehicle.  Records of a batch are put in time order;
    one older than the last seen of its vehicle is dropped.  A vehicle silent
    beyond the watermark by ``idle`` loses its state: its run has no closer.
    """
    gap = pd.Timedelta(idle) // pd.Timedelta("1ms")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, moving, first, sx, sy, n = state.get if state.exists else (-(1 << 62), True, None, 0.0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["time", "seq"], kind="stable")
        out = []
        for t, lon, lat, code in zip(rows["time"], rows["lon"], rows["lat"], rows["status"], strict=True):
            if t < last or not (0 <= lon <= 45 and -36 <= lat <= 0):
                continue
            last = int(t)
            moving = True if code in start else False if code in stop else moving
            if not moving:
                first = last if first is None else first
                sx, sy, n = sx + lon, sy + lat, n + 1
            elif first is not None:
                if last - first >= activity_seconds:
                    out.append((key[0], first, last, (sx + lon) / (n + 1), (sy + lat) / (n + 1), "major" if last - first >= major_seconds else "minor"))
                first, sx, sy, n = None, 0.0, 0.0, 0
        state.update((last, moving, first, sx, sy, n))
        state.setTimeoutTimestamp(max(int(state.getCurrentWatermarkMs()), last * 1000) + gap)
        yield pd.DataFrame(out, columns=["vehicle_id", "start_ts", "end_ts", "x", "y", "type"])

    return gps.withWatermark("ts", "1 hour").groupBy("vehicle_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
