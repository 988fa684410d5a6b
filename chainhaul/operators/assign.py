"""Activities and zones, hulls and areas: spatial joins over grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

KEY = ("vehicle_id", "chain_seq", "act_seq")


def _first(df: DataFrame, *order) -> DataFrame:
    """The first match of each activity."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("_n = 1").drop("_n")


def point_in_zone(acts: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """Activities with the zone that contains them (the least zone_id, if several); those in none are left out.

    zones: zone_id, ring.
    """
    met = geo.cell_join(acts, zones, size, geo.envelope(F.col("ring"))).where(geo.contains(F.col("ring"), F.col("x"), F.col("y")))
    return _first(met, "zone_id").drop("ring")


#: Hulls of a cell that one row holds.
CELL_HULLS = 256


def snap(acts: DataFrame, facilities: DataFrame, reach: float = 1000.0) -> DataFrame:
    """Each activity with the nearest facility (ties: least id) within reach whose hull covers it.

    facilities: facility_id, fx, fy, hull.  A match sets facility_id and moves
    the activity to the hull's centroid; others keep their place and id.

    Cells are as wide as hulls usually are, and a hull lies only in those that
    its envelope and its reach both touch.  A cell's hulls are lists of at most
    CELL_HULLS, which activities meet as they are; only where some cell has
    more than one list are the rows of an activity brought together.
    """
    hulls = facilities.where("size(hull) > 0").select(F.col("facility_id").alias("f_id"), "fx", "fy", "hull", geo.envelope(F.col("hull")).alias("b"))
    box = F.struct(F.greatest("b.minx", F.col("fx") - reach).alias("minx"), F.greatest("b.miny", F.col("fy") - reach).alias("miny"), F.least("b.maxx", F.col("fx") + reach).alias("maxx"), F.least("b.maxy", F.col("fy") + reach).alias("maxy"))
    hulls = hulls.withColumn("b", box).where("b.minx <= b.maxx and b.miny <= b.maxy")
    # by the mean square, all hulls together touch a few cells each, however uneven they are
    wide = hulls.agg(F.sqrt(F.avg(F.pow(F.greatest(F.col("b.maxx") - F.col("b.minx"), F.col("b.maxy") - F.col("b.miny")), 2)))).first()[0]
    size = min(wide or reach, reach) or 1.0
    span = lambda low, high: F.explode(F.sequence(geo.cell(F.col(low), size), geo.cell(F.col(high), size)))
    spread = hulls.withColumn("_cx", span("b.minx", "b.maxx")).withColumn("_cy", span("b.miny", "b.maxy")).select("_cx", "_cy", F.struct("f_id", "fx", "fy", "hull", geo.centroid(F.col("hull")).alias("c")).alias("f"))
    crowded = spread.groupBy("_cx", "_cy").count().where(F.col("count") > CELL_HULLS).limit(1).count() > 0
    if crowded:
        spread = spread.withColumn("_list", F.floor((F.row_number().over(Window.partitionBy("_cx", "_cy").orderBy("f.f_id")) - 1) / CELL_HULLS))
    lists = spread.groupBy("_cx", "_cy", *(["_list"] if crowded else [])).agg(F.collect_list("f").alias("_fs")).drop("_list")
    x, y = F.col("x"), F.col("y")
    met = acts.join(lists, (geo.cell(x, size) == F.col("_cx")) & (geo.cell(y, size) == F.col("_cy")), "left").drop("_cx", "_cy")
    far = lambda f: geo.distance(x, y, f["fx"], f["fy"])
    near = F.filter("_fs", lambda f: (far(f) <= reach) & geo.covers(f["hull"], x, y))
    best = F.array_min(F.transform(near, lambda f: F.struct(far(f).alias("d"), f["f_id"].alias("f_id"), f["c"].alias("c"))))
    met = met.withColumn("_best", best).drop("_fs")
    if crowded:
        # a row without a match has none in its list; the least of the others counts
        met = _first(met, F.col("_best").isNull(), F.col("_best.d"), F.col("_best.f_id"))
    return met.withColumn("facility_id", F.coalesce("_best.f_id", "facility_id")).withColumn("x", F.coalesce("_best.c.x", "x")).withColumn("y", F.coalesce("_best.c.y", "y")).drop("_best")


def gap_recode(acts: DataFrame, zones: DataFrame, reach: float = 20_000.0) -> DataFrame:
    """Activities with a facility take the id and the envelope's centre of the zone that covers them.

    The zone's centre lies within reach; ties go to the least zone_id.
    """
    box = geo.envelope(F.col("ring"))
    own = zones.withColumn("e", box).withColumn("zx", (F.col("e.minx") + F.col("e.maxx")) / 2).withColumn("zy", (F.col("e.miny") + F.col("e.maxy")) / 2).drop("e")
    met = geo.cell_join(acts.where("facility_id is not null").select(*KEY, "x", "y"), own, reach, box)
    met = met.where((geo.distance(F.col("x"), F.col("y"), F.col("zx"), F.col("zy")) <= reach) & geo.covers(F.col("ring"), F.col("x"), F.col("y")))
    best = _first(met, "zone_id").select(*KEY, "zone_id", "zx", "zy")
    out = acts.join(best, list(KEY), "left")
    return out.withColumn("facility_id", F.coalesce("zone_id", "facility_id")).withColumn("x", F.coalesce("zx", "x")).withColumn("y", F.coalesce("zy", "y")).drop("zone_id", "zx", "zy")


def vehicles_in_area(acts: DataFrame, area: Column) -> DataFrame:
    """All rows of vehicles with an activity that the area covers."""
    touched = acts.where(geo.covers(area, F.col("x"), F.col("y"))).select("vehicle_id").distinct()
    return acts.join(touched, "vehicle_id", "left_semi")


def outside_counts(acts: DataFrame, area: Column) -> DataFrame:
    """Vehicles with activities outside the area, and how many."""
    return acts.where(~geo.covers(area, F.col("x"), F.col("y"))).groupBy("vehicle_id").agg(F.count("*").alias("outside"))


def area_class(acts: DataFrame, area: Column, intra: float = 0.6) -> DataFrame:
    """0 for vehicles mostly inside the area, 1 for partly, 2 for never (4, no activities, has no row here)."""
    share = F.avg(geo.contains(area, F.col("x"), F.col("y")).cast("double"))
    out = acts.groupBy("vehicle_id").agg(share.alias("share"))
    return out.withColumn("area_class", F.when(F.col("share") > intra, 0).when(F.col("share") > 0, 1).otherwise(2))


def chains_with_facility(acts: DataFrame, ids: list[str] | None) -> DataFrame:
    """Chains that visit a listed facility: all for no list, none for an empty one."""
    if ids is None:
        return acts
    return acts.join(acts.where(F.col("facility_id").isin(*ids) if ids else F.lit(False)).select("vehicle_id", "chain_seq").distinct(), ["vehicle_id", "chain_seq"], "left_semi")
