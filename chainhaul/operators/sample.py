"""Sampling by inverse cumulative weights; the uniform draws are columns, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pathnet import SINK, SOURCE, UNKNOWN


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


#: Most cells of a group that its running shares and draws meet in; a group has no more of them than keys.
CELLS = 1000


def shares(weights: DataFrame, group: list[str], key: str) -> DataFrame:
    """group..., key, low and high: the interval of running shares that each key fills, in key order; keys: how many the group has.

    Without a group, keys are summed by their first characters and then inside
    those, so that no task holds them all.
    """
    rows = weights.where("weight > 0")
    if not group:
        rows = rows.withColumn("_head", F.substring(F.col(key).cast("string"), 1, 3))
        heads = rows.groupBy("_head").agg(F.sum("weight").alias("_own"))
        order = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
        heads = heads.select(F.col("_head").alias("_h"), F.coalesce(F.sum("_own").over(order), F.lit(0)).alias("_before"), F.sum("_own").over(Window.partitionBy()).alias("_total"))
        rows = rows.join(heads, F.col("_head") == F.col("_h"))
        by = Window.partitionBy("_head")
    else:
        by = Window.partitionBy(*group)
        rows = rows.withColumn("_before", F.lit(0)).withColumn("_total", F.sum("weight").over(by)).withColumn("_keys", F.count("*").over(by))
    upto = F.sum("weight").over(by.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", F.col("_before") + upto)
    keys = ["_keys"] if group else []
    return rows.select(*group, *keys, F.col(key).alias("_key"), ((F.col("_upto") - F.col("weight")) / F.col("_total")).alias("_low"), (F.col("_upto") / F.col("_total")).alias("_high"))


def _cell(v: Column) -> Column:
    return F.greatest(F.least(F.floor(v * F.col("_cells")), F.col("_cells") - 1), F.lit(0)).cast("int")


def intervals(weights: DataFrame, group: list[str], key: str) -> DataFrame:
    """shares, one row for each cell that an interval touches.

    A group has as many cells as keys, up to CELLS, so its intervals take less
    than twice as many rows as it has keys.
    """
    rows = shares(weights, group, key).withColumn("_cells", F.least(F.col("_keys"), F.lit(CELLS)).cast("int") if group else F.lit(CELLS))
    return rows.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_low")), _cell(F.col("_high"))))).drop("_cells", "_keys")


def pick(weights: DataFrame, draws: DataFrame, group: list[str], key: str) -> DataFrame:
    """For each draw (group..., u): the first key, in order, whose running share of the group's weight reaches u.

    Intervals of shares and draws meet in cells, by an equi-join; a draw lies
    in one interval.  Groups without weight give no row.
    """
    if group:
        sizes = weights.where("weight > 0").groupBy(*group).agg(F.least(F.count("*"), F.lit(CELLS)).cast("int").alias("_cells"))
        met = draws.join(sizes, group)
    else:
        met = draws.withColumn("_cells", F.lit(CELLS))
    met = met.withColumn("_cell", _cell(F.col("u"))).join(intervals(weights, group, key), [*group, "_cell"])
    first = (F.col("_low") == 0) & (F.col("u") <= 0)
    return met.where((F.col("u") <= F.col("_high")) & ((F.col("u") > F.col("_low")) | first)).select(*draws.columns, F.col("_key").alias(key))


def bernoulli(vehicles: DataFrame, fraction: float, seed: int) -> DataFrame:
    return vehicles.where(uniform(F.col("vehicle_id"), seed) <= fraction)


def origins(mx: DataFrame, draws: DataFrame) -> DataFrame:
    """draws: id, o_type, u. The origin node by the weight of arcs of that origin type."""
    return pick(mx.groupBy("o_type", "o_id").agg(F.sum("weight").alias("weight")), draws, ["o_type"], "o_id")


def destinations(mx: DataFrame, draws: DataFrame) -> DataFrame:
    """draws: id, o_id, d_type, u. By arcs from the origin to that type; else by all arcs to that type."""
    own = pick(mx.groupBy("o_id", "d_type", "d_id").agg(F.sum("weight").alias("weight")), draws, ["o_id", "d_type"], "d_id")
    left = draws.join(own.select("id"), "id", "left_anti")
    other = pick(mx.groupBy("d_type", "d_id").agg(F.sum("weight").alias("weight")), left, ["d_type"], "d_id")
    return own.select("id", "d_id", F.lit("origin").alias("by")).unionByName(other.select("id", "d_id", F.lit("type").alias("by")))


def start_nodes(pd: DataFrame, draws: DataFrame) -> DataFrame:
    """draws: id, u. By source weight, in id order."""
    weights = pd.where((F.col("prev_id") == SOURCE) & (F.col("next_id") != UNKNOWN)).groupBy("node_id").agg(F.sum("weight").alias("weight"))
    return pick(weights, draws, [], "node_id").select("id", "node_id")


def start_hours(starts: DataFrame, draws: DataFrame) -> DataFrame:
    """draws: id, node_id, u. hour and activities, in the order of their text."""
    weights = starts.select("node_id", F.concat_ws(",", "hour", "activities").alias("start"), F.col("count").alias("weight"))
    out = pick(weights, draws, ["node_id"], "start")
    parts = F.split("start", ",")
    return out.select("id", "node_id", parts[0].cast("int").alias("hour"), parts[1].cast("long").alias("activities"))


def next_nodes(pd: DataFrame, draws: DataFrame) -> DataFrame:
    """draws: id, prev_id, node_id, u. By the context's weights; else by all contexts' candidates and their sink weight; else null."""
    real = pd.where(~F.col("next_id").isin(SINK, UNKNOWN))
    own = pick(real.select("prev_id", "node_id", "next_id", "weight"), draws, ["prev_id", "node_id"], "next_id").select("id", "next_id")
    left = draws.join(own.select("id"), "id", "left_anti")
    sink = pd.where(F.col("next_id") == SINK).groupBy(F.col("node_id").alias("next_id")).agg(F.sum("weight").alias("weight"))
    other = pick(real.select("node_id", "next_id").distinct().join(sink, "next_id"), left, ["node_id"], "next_id").select("id", "next_id")
    return draws.select("id").join(own.unionByName(other), "id", "left")


def end_nodes(pd: DataFrame, draws: DataFrame) -> DataFrame:
    """draws: id, prev_id, node_id, u. Candidates of the context that may end there, by that weight; else by their total sink weight; else null."""
    real = pd.where(~F.col("next_id").isin(SINK, UNKNOWN))
    sink = pd.where(F.col("next_id") == SINK)
    to = sink.select(F.col("prev_id").alias("node_id"), F.col("node_id").alias("next_id"), "weight")
    cand = real.select("prev_id", "node_id", "next_id").distinct()
    own = pick(cand.join(to, ["node_id", "next_id"]), draws, ["prev_id", "node_id"], "next_id").select("id", "next_id")
    left = draws.join(own.select("id"), "id", "left_anti")
    total = sink.groupBy(F.col("node_id").alias("next_id")).agg(F.sum("weight").alias("weight"))
    other = pick(cand.join(total, "next_id"), left, ["prev_id", "node_id"], "next_id").select("id", "next_id")
    return draws.select("id").join(own.unionByName(other), "id", "left")


def inverse_cdf(u: Column, deciles: list[float]) -> Column:
    """Linear inside each tenth; deciles: the eleven bounds."""
    table = F.array(*map(F.lit, map(float, deciles)))
    k = F.least(F.floor(u * 10), F.lit(9)).cast("int")
    low, high = F.element_at(table, k + 1), F.element_at(table, k + 2)
    return F.when(u.between(0, 1), low + (u * 10 - k) * (high - low))


def numbered(rows: DataFrame, keys: list[str], buckets: int = 64) -> DataFrame:
    """rows with nth, from 0: numbered inside hash buckets, which running totals (a row a bucket) put end to end."""
    by = Window.partitionBy("_bucket").orderBy(*keys)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("size"))
    before = sizes.select("_bucket", F.coalesce(F.sum("size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn("nth", F.row_number().over(by) - 1).join(F.broadcast(before), "_bucket").withColumn("nth", F.col("_before") + F.col("nth")).drop("_bucket", "_before")


def bootstrap(chains: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws with replacement from (vehicle_id, chain_seq): draw, vehicle_id, chain_seq; draws are numbers, joined."""
    total = chains.count()
    draws = chains.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(F.col("id"), seed) * total).alias("nth"))
    return draws.join(numbered(chains, ["vehicle_id", "chain_seq"]), "nth").select("draw", "vehicle_id", "chain_seq")


def bootstrap_plans(acts: DataFrame, drawn: DataFrame, prefix: str) -> DataFrame:
    """Plans of drawn chains: activities with legs between, times from midnight of the first day.

    Whole days are deducted from the first end until at most one is left, and
    as many from the last start; between, activities last as they did.
    """
    from ..functions import calendar

    order = Window.partitionBy("draw").orderBy("act_seq")
    rows = drawn.join(acts, ["vehicle_id", "chain_seq"])
    last = F.row_number().over(Window.partitionBy("draw").orderBy(F.col("act_seq").desc())) == 1
    rows = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("is_last", last)
    midnight = F.first(calendar.day_number(F.col("start_ts")) * 86400 - calendar.OFFSET).over(order)
    first_end = F.first("end_ts").over(order) - midnight
    shift = midnight + calendar.surplus_days(first_end) * 86400
    rows = rows.withColumn("end_time", F.when(F.col("place") == 0, F.col("end_ts") - shift)).withColumn("start_time", F.when(F.col("is_last"), F.col("start_ts") - shift)).withColumn("max_dur", F.when((F.col("place") > 0) & ~F.col("is_last"), F.col("end_ts") - F.col("start_ts")))
    person = F.concat(F.lit(prefix + "_"), F.col("draw").cast("string"))
    cols = ["kind", "type", "facility_id", "x", "y", "end_time", "max_dur", "start_time"]
    activity = F.struct((F.col("place") * 2).cast("int").alias("elem_seq"), F.lit("activity").alias("kind"), "type", "facility_id", "x", "y", "end_time", "max_dur", "start_time")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    leg = F.struct((F.col("place") * 2 + 1).cast("int").alias("elem_seq"), F.lit("leg").alias("kind"), F.lit("commercial").alias("type"), none("facility_id", "string"), none("x", "double"), none("y", "double"), none("end_time", "long"), none("max_dur", "long"), none("start_time", "long"))
    out = rows.select(person.alias("person_id"), F.explode(F.when(F.col("is_last"), F.array(activity)).otherwise(F.array(activity, leg))).alias("e"))
    return out.select("person_id", "e.elem_seq", *(f"e.{c}" for c in cols))


def outcomes(picked: DataFrame, by: str = "by") -> DataFrame:
    """How often draws fell back: counts by outcome."""
    return picked.groupBy(by).agg(F.count("*").alias("n"))


def interior_points(zones: DataFrame, seed: int, tries: int = 200) -> DataFrame:
    """A random point inside each zone (zone_id, ring): the first of a zone's draws in its box that lies inside."""
    from ..functions import geo

    box = zones.withColumn("b", geo.envelope(F.col("ring"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    u, v = (uniform(F.concat_ws("-", F.col("zone_id"), F.col("k")), seed + s) for s in (0, 1))
    x, y = F.col("b.minx") + u * (F.col("b.maxx") - F.col("b.minx")), F.col("b.miny") + v * (F.col("b.maxy") - F.col("b.miny"))
    inside = box.withColumn("x", x).withColumn("y", y).where(geo.contains(F.col("ring"), F.col("x"), F.col("y")))
    return inside.groupBy("zone_id").agg(F.min_by(F.struct("x", "y"), "k").alias("p")).select("zone_id", "p.x", "p.y")
