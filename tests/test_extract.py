"""Extraction against a state machine, and the golden chain."""

import random

from chainhaul.operators import extract


def machine(rows, start, stop, activity, major):
    """One vehicle's activities, by walking its records."""
    out, moving, run = [], True, []
    for t, lon, lat, code in rows:
        if not (0 <= lon <= 45 and -36 <= lat <= 0):
            continue
        moving = True if code in start else False if code in stop else moving
        if not moving:
            run.append((t, lon, lat))
        elif run:
            run.append((t, lon, lat))
            if t - run[0][0] >= activity:
                n = len(run)
                out.append((run[0][0], t, round(sum(r[1] for r in run) / n, 6), round(sum(r[2] for r in run) / n, 6), "major" if t - run[0][0] >= major else "minor"))
            run = []
    majors = [k for k, a in enumerate(out) if a[4] == "major"]
    return [(c, k - a, *out[k]) for c, (a, b) in enumerate(zip(majors, majors[1:]), 1) for k in range(a, b + 1)]


def frame(spark, vehicles):
    rows = [(v, k, *r) for v, rs in vehicles.items() for k, r in enumerate(rs)]
    return spark.createDataFrame(rows, "vehicle_id string, seq long, time long, lon double, lat double, status string")


def test_golden_chain(spark):
    rows, t = [], 0
    for lon, stops in ((20.0, (5, 107)), (25.0, (113, 155)), (30.0, (161, 263))):
        for k in range(t, stops[0], 1):
            rows.append((k, lon, -20.0, "0"))
        rows += [(stops[0], lon, -20.0, "15"), ((stops[0] + stops[1]) // 2, lon, -20.0, "15"), (stops[1], lon, -20.0, "0")]
        t = stops[1] + 1
    got = extract.extract(frame(spark, {"v": rows}), ["0"], ["15"], 10, 100).orderBy("act_seq").collect()
    assert [(r.type, r.start_ts, r.end_ts, r.x, r.y) for r in got] == [("major", 5, 107, 20.0, -20.0), ("minor", 113, 155, 25.0, -20.0), ("major", 161, 263, 30.0, -20.0)]
    moved = extract.moving(extract.in_bounds(frame(spark, {"v": rows})), ["0"], ["15"])
    chained = extract.chains(extract.activities(moved, 10, 100))
    counts = {r.trace_seq: r["count"] for r in extract.traces(moved, chained).groupBy("trace_seq").count().collect()}
    assert counts == {0: 6, 1: 6}


def test_random_vehicles(spark):
    rng = random.Random(5)
    vehicles = {}
    for v in range(40):
        t, rs = 0, []
        for _ in range(rng.randrange(0, 80)):
            t += rng.choice([0, 1, 3, 20])
            rs.append((t, rng.choice([1.0, 20.5, 44.0, 46.0]), rng.choice([-1.0, -20.0, -37.0]), rng.choice(["0", "15", "15", "9"])))
        vehicles[str(v)] = rs
    got = extract.extract(frame(spark, vehicles), ["0"], ["15"], 5, 20).collect()
    want = {(v, *a) for v, rs in vehicles.items() for a in machine(rs, {"0"}, {"15"}, 5, 20)}
    assert {(r.vehicle_id, r.chain_seq, r.act_seq, r.start_ts, r.end_ts, round(r.x, 6), round(r.y, 6), r.type) for r in got} == want
    assert len(got) == len(want) > 20


def test_empty(spark):
    assert extract.extract(frame(spark, {}).limit(0), ["0"], ["15"]).count() == 0
