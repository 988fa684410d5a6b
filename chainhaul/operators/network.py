"""First-order multiplex network between facilities.

arcs: o_id, d_id, o_type, d_type, weight; nodes: id, x, y.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sample import numbered


def arcs(acts: DataFrame) -> DataFrame:
    """Consecutive activities of a chain that both have a facility, counted."""
    order = Window.partitionBy("vehicle_id", "chain_seq").orderBy("act_seq")
    nxt = F.lead(F.struct("facility_id", "type")).over(order)
    pairs = acts.select("facility_id", "type", nxt.alias("n")).where("facility_id is not null and n.facility_id is not null")
    return pairs.groupBy(F.col("facility_id").alias("o_id"), F.col("n.facility_id").alias("d_id"), F.col("type").alias("o_type"), F.col("n.type").alias("d_type")).agg(F.count("*").alias("weight"))


def nodes(acts: DataFrame) -> DataFrame:
    """Facilities that are part of an arc, at the place first seen in (vehicle, chain, activity) order."""
    order = Window.partitionBy("vehicle_id", "chain_seq").orderBy("act_seq")
    rows = acts.withColumn("p", F.lag("facility_id").over(order)).withColumn("n", F.lead("facility_id").over(order))
    rows = rows.where(F.col("facility_id").isNotNull() & (F.col("p").isNotNull() | F.col("n").isNotNull()))
    place = F.min_by(F.struct("x", "y"), F.struct("vehicle_id", "chain_seq", "act_seq"))
    return rows.groupBy(F.col("facility_id").alias("id")).agg(place.alias("p")).select("id", "p.x", "p.y")


def edges(mx: DataFrame) -> DataFrame:
    """Weights whatever the types."""
    return mx.groupBy("o_id", "d_id").agg(F.sum("weight").alias("weight"))


def ends(mx: DataFrame) -> DataFrame:
    return mx.select(F.explode(F.array("o_id", "d_id")).alias("id")).distinct()


def stats(mx: DataFrame) -> DataFrame:
    """One row: vertices, edges, density, least and greatest multiplex weight (zeros for an empty network)."""
    v = ends(mx).agg(F.count("*").alias("vertices"))
    e = mx.agg(F.count_distinct("o_id", "d_id").alias("edges"), F.coalesce(F.min("weight"), F.lit(0)).alias("min_weight"), F.coalesce(F.max("weight"), F.lit(0)).alias("max_weight"))
    pairs = F.col("vertices") * (F.col("vertices") - 1)
    return v.join(e).select("vertices", "edges", F.when(pairs > 0, F.col("edges") / pairs).otherwise(0.0).alias("density"), "min_weight", "max_weight")


def _ends_of(e: DataFrame, out_value, in_value) -> DataFrame:
    """Each edge's two ends with what they get: no join of two aggregates."""
    zero = F.lit(0).cast("long")
    rows = e.select(F.explode(F.array(F.struct(F.col("d_id").alias("id"), in_value.cast("long").alias("i"), zero.alias("o")), F.struct(F.col("o_id").alias("id"), zero.alias("i"), out_value.cast("long").alias("o")))).alias("r"))
    return rows.groupBy("r.id").agg(F.sum("r.i").alias("in"), F.sum("r.o").alias("out"))


def node_order(mx: DataFrame) -> DataFrame:
    """Weighted in, out and total order of each node."""
    return _ends_of(edges(mx), F.col("weight"), F.col("weight")).select("id", F.col("in").alias("in_order"), F.col("out").alias("out_order"), (F.col("in") + F.col("out")).alias("total_order"))


def degrees(mx: DataFrame, weighted: bool = False) -> DataFrame:
    """In and out degree: neighbours, or weights if weighted."""
    one = F.col("weight") if weighted else F.lit(1)
    return _ends_of(edges(mx), one, one).select("id", F.col("in").alias("in_degree"), F.col("out").alias("out_degree"), (F.col("in") + F.col("out")).alias("total_degree"))


def degree_distribution(deg: DataFrame) -> DataFrame:
    """kind (in, out, total), degree, freq, share, cumulative; share is of all nodes."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(f"{k}_degree").alias("degree")) for k in ("in", "out", "total")]
    freq = deg.select(F.explode(F.array(*kinds)).alias("k")).groupBy("k.kind", "k.degree").agg(F.count("*").alias("freq"))
    # windows over one row a kind and degree
    by = Window.partitionBy("kind")
    share = F.col("freq") / F.sum("freq").over(by)
    run = F.sum("freq").over(by.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("freq").over(by)
    return freq.select("kind", "degree", "freq", share.alias("share"), run.alias("cumulative"))


def molloy_reed(distribution: DataFrame) -> DataFrame:
    """Q by kind: the sum of p(k) k (k - 2)."""
    k = F.col("degree")
    return distribution.groupBy("kind").agg(F.sum(F.col("share") * k * (k - 2)).alias("q"))


def edge_list(mx: DataFrame, places: DataFrame) -> DataFrame:
    """from, to, weight and the ends' places."""
    o = places.select(F.col("id").alias("o_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = places.select(F.col("id").alias("d_id"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    return edges(mx).join(o, "o_id").join(d, "d_id").select(F.col("o_id").alias("from_id"), F.col("d_id").alias("to_id"), "weight", "ox", "oy", "dx", "dy")


def edges_in_area(e: DataFrame, places: DataFrame, area) -> DataFrame:
    """Edges with an end that the area covers; e: o_id, d_id, ..."""
    from ..functions import geo

    within = places.where(geo.covers(area, F.col("x"), F.col("y"))).select("id")
    o = e.join(within.withColumnRenamed("id", "o_id").withColumn("o_in", F.lit(True)), "o_id", "left")
    both = o.join(within.withColumnRenamed("id", "d_id").withColumn("d_in", F.lit(True)), "d_id", "left")
    return both.where("o_in or d_in").drop("o_in", "d_in")


def artificial_edges(mx: DataFrame, seed: int = 0) -> DataFrame:
    """Dummy arcs of weight 1 for nodes without an arc in or without one out, to a partner drawn by hash."""
    deg = degrees(mx)
    odd = deg.where("in_degree = 0 or out_degree = 0").select("id", (F.col("in_degree") == 0).alias("source"))
    n = ends(mx).count()
    partners = numbered(ends(mx), ["id"]).withColumnRenamed("id", "partner")
    drawn = odd.withColumn("nth", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))))
    # who draws itself takes the next
    drawn = drawn.join(partners, "nth").withColumn("nth", F.when(F.col("id") == F.col("partner"), (F.col("nth") + 1) % max(n, 1)).otherwise(F.col("nth"))).drop("partner")
    both = drawn.join(partners, "nth").where("id <> partner")
    o, d = F.when(F.col("source"), F.col("partner")).otherwise(F.col("id")), F.when(F.col("source"), F.col("id")).otherwise(F.col("partner"))
    return both.select(o.alias("o_id"), d.alias("d_id"), F.lit("dummy").alias("o_type"), F.lit("dummy").alias("d_type"), F.lit(1).cast("long").alias("weight"))
