from chainhaul import cli


def test_extract_to_network(spark, tmp_path):
    rows = []
    for v in ("1", "2"):
        for stop in range(3):
            rows += [f"{1000 + 100 * stop},-2{stop}.0,2{stop}.0,50,15,{v}", f"{1050 + 100 * stop},-2{stop}.0,2{stop}.0,50,0,{v}"]
    (tmp_path / "raw.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "status.csv").write_text("Start,0\nStop,15\n")
    out = str(tmp_path / "chains")
    cli.main(["extract", str(tmp_path / "raw.csv"), out, "--status", str(tmp_path / "status.csv"), "--activity", "10", "--major", "40"])
    assert spark.read.parquet(f"{out}/activities").count() == 8
    spark.read.parquet(f"{out}/activities").selectExpr("* except(facility_id)", "cast(x as string) facility_id").write.parquet(f"{out}/known")
    cli.main(["clean", f"{out}/known", f"{out}/clean"])
    cli.main(["network", f"{out}/clean", f"{out}/net"])
    cli.main(["paths", f"{out}/clean", f"{out}/paths"])
    cli.main(["generate", f"{out}/paths", f"{out}/plans", "--number", "5", "--deciles", *map(str, range(11))])
    cli.main(["report", f"{out}/clean", f"{out}/report"])
    assert spark.read.option("header", True).csv(f"{out}/report").count() == 4
