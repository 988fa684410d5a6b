from pyspark.sql import functions as F

from chainhaul.operators import extract
from chainhaul.streaming import chains

GPS = "vehicle_id string, seq long, time long, lon double, lat double, status string, ts timestamp"


def test_stream_finds_the_batch_activities(spark, tmp_path):
    rows = []
    for v in ("a", "b"):
        for k in range(40):
            rows.append((v, k, 1000 + 60 * k, 20.0 + k % 3, -20.0, "stop" if k % 10 in (2, 3, 4) else "go"))
    df = spark.createDataFrame(rows, GPS.rsplit(",", 1)[0]).withColumn("ts", F.timestamp_seconds("time"))
    want = {(r.vehicle_id, r.start_ts, r.end_ts, r.type) for r in extract.activities(extract.moving(df.drop("ts"), ["go"], ["stop"]), 100, 1000).collect()}
    for part, cond in enumerate(("seq < 13", "seq >= 13 and seq < 25", "seq >= 25")):
        df.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(GPS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    q = chains.activities(stream, ["go"], ["stop"], 100, 1000).writeStream.outputMode("append").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.vehicle_id, r.start_ts, r.end_ts, r.type) for r in spark.sql("select * from found").collect()]
    assert set(got) == want and len(got) == len(want) == 8


def test_hourly_counts(spark):
    df = spark.createDataFrame([(0, "minor"), (10, "minor"), (4000, "major")], "t long, type string").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.n for r in chains.hourly_counts(df).collect()) == [1, 2]
