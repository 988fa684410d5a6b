"""The registered queries: each a function of (spark, sf_dir), and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, geo
from ..operators import assign, clean, cluster, extract, generate, graph, kde, network, pathnet, reports, sample, similarity
from ..sources import exports, readers, writers
from . import adapters as A
from .sql import build, date, hour, second, weekday

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ABNORMAL_DATES = ["2024/01/01", "2024/01/08", "2024/02/05"]
ABNORMAL_DAYS = [1, 8, 36]
DATES_SQL = ", ".join(f"'{d}'" for d in ABNORMAL_DATES)
DAYS_SQL = ", ".join(map(str, ABNORMAL_DAYS))
DECILES = [0, 300, 600, 900, 1500, 2400, 3600, 5400, 9000, 14400, 18000]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(column):
    return F.round(column, 6)


def u_of(key, a: int = 7919, m: int = 10007):
    """The injected uniform draw of a key."""
    return F.pmod(key * a, F.lit(m)) / F.lit(float(m))


# sources and scalar functions


@query(build("SELECT vehicle_id, seq, t AS \"time\", round(lon, 6) lon, lat, status FROM gps", "gps"))
def gps_typed_scan(spark, sf):
    return A.gps(spark, sf).withColumn("lon", r6("lon"))


@query(build("SELECT vehicle_id, seq, t AS \"time\", round(lon, 6) lon, lat, status FROM bounded", "bounded"))
def gps_bounds_filter(spark, sf):
    return extract.in_bounds(A.gps(spark, sf)).withColumn("lon", r6("lon"))


@query(build("SELECT vehicle_id, seq, CAST(rn AS INT) rn, moving FROM moved", "moved"))
def ignition_ffill(spark, sf):
    return A.moved(spark, sf).select("vehicle_id", "seq", "rn", "moving")


@query(build("SELECT min(t) first_time, max(t) last_time FROM gps", "gps"))
def gps_time_range(spark, sf):
    return readers.time_range(A.gps(spark, sf))


@query(None)
def tm_project(spark, sf):
    s = A.table(spark, sf, "supplier").select("s_suppkey", (F.lit(26.0) + (F.col("s_suppkey") % 60) / 10).alias("lon"), (F.lit(-22.0) - (F.col("s_suppkey") % 110) / 10).alias("lat"))
    p = geo.to_transverse_mercator(F.col("lon"), F.col("lat"))
    back = s.withColumn("p", p).withColumn("q", geo.from_transverse_mercator(F.col("p.x"), F.col("p.y")))
    return back.select("s_suppkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round(F.col("q.lon") - F.col("lon"), 7).alias("lon_error"), F.round(F.col("q.lat") - F.col("lat"), 7).alias("lat_error"))


@query("""SELECT s_suppkey, '(' || CAST(x AS VARCHAR) || ';' || CAST(y AS VARCHAR) || '),(' || CAST(x + 5 AS VARCHAR) || ';' || CAST(y AS VARCHAR) || ')' AS "text", 'LineString' AS kind, true AS same
    FROM (SELECT s_suppkey, CAST(s_suppkey % 97 AS DOUBLE) x, CAST(s_suppkey % 89 AS DOUBLE) y FROM supplier)""")
def hull_codec_roundtrip(spark, sf):
    x, y = (F.col("s_suppkey") % 97).cast("double"), (F.col("s_suppkey") % 89).cast("double")
    s = A.table(spark, sf, "supplier").select("s_suppkey", F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 5).alias("x"), y.alias("y"))).alias("hull"))
    s = s.withColumn("text", geo.encode_hull(F.col("hull")))
    return s.select("s_suppkey", "text", geo.hull_kind(F.col("hull")).alias("kind"), (geo.decode_hull(F.col("text")) == F.col("hull")).alias("same"))


@query(f"SELECT o_orderkey, strftime({date('t')}, '%Y/%m/%d') AS \"date\", strftime({date('t')}, '%Y%m') AS \"month\", {hour('t')} AS \"hour\", {second('t')} AS \"second\", {weekday('t')} AS \"weekday\", CASE WHEN strftime({date('t')}, '%Y/%m/%d') IN ({DATES_SQL}) THEN 8 ELSE {weekday('t')} END AS day_type FROM (SELECT o_orderkey, date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) + (o_orderkey * 977) % 86400 t FROM orders)")
def chain_day_type(spark, sf):
    t = F.col("t")
    o = A.table(spark, sf, "orders").select("o_orderkey", (A.epoch("o_orderdate") + (F.col("o_orderkey") * 977) % 86400).alias("t"))
    return o.select("o_orderkey", F.date_format(calendar.date_of(t), "yyyy/MM/dd").alias("date"), calendar.month_key(t).alias("month"), calendar.hour_of(t).alias("hour"), calendar.second_of_day(t).alias("second"), calendar.day_of_week(t).alias("weekday"), calendar.day_type_by_date(t, ABNORMAL_DATES).alias("day_type"))


@query("SELECT o_orderkey, CAST(greatest(ceil((o_orderkey * 7919 % 400000) / 86400.0) - 1, 0) AS BIGINT) AS \"days\" FROM orders")
def surplus_days(spark, sf):
    return A.table(spark, sf, "orders").select("o_orderkey", calendar.surplus_days(F.col("o_orderkey") * 7919 % 400000).cast("long").alias("days"))


# extraction and chains


@query(build("SELECT vehicle_id, CAST(first_rn AS INT) first_rn, CAST(close_rn AS INT) close_rn, start_ts, end_ts, round(x, 6) x, round(y, 6) y, \"type\" FROM acts0", "acts0"))
def activity_extract(spark, sf):
    acts = extract.activities(A.moved(spark, sf), A.ACTIVITY_SECONDS, A.MAJOR_SECONDS)
    return acts.withColumn("x", r6("x")).withColumn("y", r6("y"))


@query(build("SELECT vehicle_id, chain_seq, act_seq, \"type\", start_ts, end_ts FROM chained", "chained"))
def chain_segments(spark, sf):
    return A.chained(spark, sf).select("vehicle_id", "chain_seq", "act_seq", "type", "start_ts", "end_ts")


@query(build("""SELECT c.vehicle_id, chain_seq, act_seq trace_seq, CAST(row_number() OVER (PARTITION BY c.vehicle_id, chain_seq, act_seq ORDER BY rn) - 1 AS INT) pos_seq, t ts, round(lon, 6) x, lat y
    FROM (SELECT *, max(act_seq) OVER (PARTITION BY vehicle_id, chain_seq) top FROM chained) c JOIN moved m ON m.vehicle_id = c.vehicle_id AND rn >= close_rn AND rn < next_rn WHERE act_seq < top""", "chained", "moved"))
def trace_points(spark, sf):
    out = extract.traces(A.moved(spark, sf), A.chained(spark, sf))
    return out.withColumn("x", r6("x"))


@query(build(f"SELECT vehicle_id, chain_seq, strftime({date('t')}, '%Y/%m/%d') AS \"day\", CASE WHEN strftime({date('t')}, '%Y/%m/%d') IN ({DATES_SQL}) THEN 8 ELSE {weekday('t')} END day_type, {hour('t')} AS \"hour\", minors FROM ends2", "ends2"))
def chain_summary(spark, sf):
    return reports.chain_summary(A.acts(spark, sf), ABNORMAL_DATES)


@query(build(f"""SELECT a.vehicle_id, a.chain_seq, {second('e.t')} start_second, e.n activities, round(distance, 6) distance, e.u - e.t duration FROM (
    SELECT vehicle_id, chain_seq, coalesce(sum(step), 0) distance FROM (SELECT *, sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2) step FROM acts WINDOW w AS (PARTITION BY vehicle_id, chain_seq ORDER BY act_seq)) GROUP BY ALL) a JOIN ends2 e USING (vehicle_id, chain_seq)""", "acts", "ends2"))
def chain_start_report(spark, sf):
    return reports.chain_start_report(A.acts(spark, sf)).withColumn("distance", r6("distance"))


@query(build("SELECT vehicle_id, chain_seq, ft = 'major' AND lt = 'major' complete, false inter_out, false inter_in, false in_out FROM ends2", "ends2"))
def chain_complete_flags(spark, sf):
    return reports.chain_flags(A.acts(spark, sf))


@query(build(f"SELECT lpad(CAST({hour('start_ts')} AS VARCHAR), 2, '0') AS \"hour\", count(*) n FROM acts WHERE \"type\" = 'minor' GROUP BY 1", "acts"))
def minor_start_hour_hist(spark, sf):
    return reports.minor_start_hours(A.acts(spark, sf))


@query(build("SELECT vehicle_id, round(avg(CASE WHEN facility_id IS NULL THEN 0.0 ELSE 1.0 END), 6) share FROM acts GROUP BY 1", "acts"))
def facility_share(spark, sf):
    return reports.facility_share(A.acts(spark, sf)).withColumn("share", r6("share"))


@query(build("SELECT vehicle_id, chain_seq, act_seq, end_ts - start_ts AS \"seconds\" FROM acts WHERE \"type\" = 'minor'", "acts"))
def minor_durations(spark, sf):
    return reports.minor_durations(A.acts(spark, sf))


@query(build("SELECT vehicle_id, facility_id, count(*) visits, arg_min(x, (chain_seq, act_seq)) x, arg_min(y, (chain_seq, act_seq)) y FROM ord WHERE \"type\" = 'minor' AND facility_id IS NOT NULL GROUP BY 1, 2", "ord"))
def facility_visits(spark, sf):
    return reports.facility_visits(A.order_acts(spark, sf))


AREA = (100.0, 100.0, 600.0, 700.0)


def area():
    return geo.rectangle(*map(F.lit, AREA))


@query(build("SELECT vehicle_id, count(*) outside FROM ord WHERE NOT (x BETWEEN 100 AND 600 AND y BETWEEN 100 AND 700) GROUP BY 1", "ord"))
def outside_area_count(spark, sf):
    return assign.outside_counts(A.order_acts(spark, sf), area())


@query(build("SELECT vehicle_id, chain_seq, act_seq FROM ord WHERE vehicle_id IN (SELECT vehicle_id FROM ord WHERE x BETWEEN 100 AND 600 AND y BETWEEN 100 AND 700)", "ord"))
def vehicle_in_area_semi(spark, sf):
    return assign.vehicles_in_area(A.order_acts(spark, sf), area()).select("vehicle_id", "chain_seq", "act_seq")


@query(build("SELECT vehicle_id, round(share, 6) share, CASE WHEN share > 0.6 THEN 0 WHEN share > 0 THEN 1 ELSE 2 END area_class FROM (SELECT vehicle_id, avg(CASE WHEN x > 100 AND x < 600 AND y > 100 AND y < 700 THEN 1.0 ELSE 0.0 END) share FROM ord GROUP BY 1)", "ord"))
def intra_inter_extra(spark, sf):
    return assign.area_class(A.order_acts(spark, sf), area()).withColumn("share", r6("share"))


@query(build(f"SELECT CAST(dayofyear({date('t')}) AS INT) AS \"day\", count(*) chains FROM cends WHERE {weekday('t')} BETWEEN 2 AND 6 AND dayofyear({date('t')}) NOT IN ({DAYS_SQL}) GROUP BY 1", "cends"))
def normal_weekday_chains(spark, sf):
    return reports.normal_weekday_chains(A.order_acts(spark, sf), ABNORMAL_DAYS)


MONTHS = ["199501", "199502", "199503", "199504"]


@query(build("SELECT coalesce(a.vehicle_id, b.vehicle_id) vehicle_id, " + ", ".join(f"coalesce(m_{m}, 0) m_{m}" for m in MONTHS) + ", " + ", ".join(f"coalesce(y_{m}, 0) y_{m}" for m in MONTHS)
    + " FROM (SELECT vehicle_id, " + ", ".join(f"count(*) FILTER (strftime({date('t')}, '%Y%m') = '{m}') m_{m}" for m in MONTHS) + " FROM cends WHERE chain_seq % 3 = 0 GROUP BY 1) a FULL JOIN (SELECT vehicle_id, "
    + ", ".join(f"count(*) FILTER (strftime({date('t')}, '%Y%m') = '{m}') y_{m}" for m in MONTHS) + " FROM cends WHERE chain_seq % 3 <> 0 GROUP BY 1) b ON a.vehicle_id = b.vehicle_id", "cends"))
def chain_month_pivot(spark, sf):
    acts = A.order_acts(spark, sf)
    return reports.month_counts(acts.where("chain_seq % 3 = 0"), acts.where("chain_seq % 3 <> 0"), MONTHS)


@query(build(f"""SELECT vehicle_id, chain_seq, facility_id, n chain_length, position, CASE WHEN dayofyear({date('t')}) IN ({DAYS_SQL}) THEN 8 ELSE {weekday('t')} END chain_day,
    CASE WHEN dayofyear({date('start_ts')}) IN ({DAYS_SQL}) THEN 8 ELSE {weekday('start_ts')} END activity_day, x, y, CAST(round((start_ts - pe) / 60.0) AS BIGINT) AS \"between\", CAST(round((start_ts - ps) / 60.0) AS BIGINT) start_to_start, facility_id = pf AS \"duplicate\"
    FROM (SELECT *, lag(facility_id) OVER w pf, lag(start_ts) OVER w ps, lag(end_ts) OVER w pe, CAST(row_number() OVER w AS INT) AS \"position\", count(*) OVER (PARTITION BY vehicle_id, chain_seq) n, first_value(end_ts) OVER w t FROM ord WINDOW w AS (PARTITION BY vehicle_id, chain_seq ORDER BY act_seq))
    WHERE facility_id IS NOT NULL AND pf IS NOT NULL""", "ord"))
def consecutive_activity_report(spark, sf):
    return reports.consecutive_report(A.order_acts(spark, sf), ABNORMAL_DAYS)


@query(build("SELECT vehicle_id, chain_seq, facility_id, min(act_seq) pos FROM acts WHERE facility_id IS NOT NULL GROUP BY 1, 2, 3", "acts"))
def first_positions(spark, sf):
    return A.acts(spark, sf).where("facility_id is not null").groupBy("vehicle_id", "chain_seq", "facility_id").agg(F.min("act_seq").alias("pos"))


@query(build("SELECT vehicle_id, chain_seq, ft first_type, lt last_type, n activities, minors FROM ends2", "ends2"))
def chain_first_last(spark, sf):
    return reports.chain_ends(A.acts(spark, sf)).select("vehicle_id", "chain_seq", "first_type", "last_type", "activities", "minors")


@query(build("SELECT fromId, toId, weight, oX, oY, round(oX / 10, 6) oLon, round(oY / 10, 6) oLat FROM (SELECT o_id fromId, d_id toId, weight, o.x oX, o.y oY FROM edges JOIN places o ON o.id = o_id)", "edges", "places"))
def weighted_edge_list(spark, sf):
    acts = A.order_acts(spark, sf)
    out = exports.weighted_edge_list(network.edges(network.arcs(acts)), network.nodes(acts))
    return out.select("fromId", "toId", "weight", "oX", "oY", r6(F.col("oLon") / 10).alias("oLon"), r6(F.col("oLat") / 10).alias("oLat"))


# cleaning

MERGED = """SELECT vehicle_id, chain_seq, CAST(row_number() OVER (PARTITION BY vehicle_id, chain_seq ORDER BY island) - 1 AS INT) act_seq, "type", start_ts, end_ts, x, y, facility_id, merged FROM (
    SELECT vehicle_id, chain_seq, island, CASE WHEN bool_or("type" = 'major') THEN 'major' ELSE arg_min("type", act_seq) END "type", arg_min(start_ts, act_seq) start_ts, arg_max(end_ts, act_seq) end_ts, arg_min(x, act_seq) x, arg_min(y, act_seq) y, arg_min(facility_id, act_seq) facility_id, count(*) merged
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY vehicle_id, chain_seq ORDER BY act_seq ROWS UNBOUNDED PRECEDING) island FROM (SELECT *, CASE WHEN lower(facility_id) = lower(lag(facility_id) OVER (PARTITION BY vehicle_id, chain_seq ORDER BY act_seq)) THEN 0 ELSE 1 END fresh FROM acts)) GROUP BY 1, 2, 3)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("x", r6("x")).withColumn("y", r6("y"))


@query(build(f"SELECT * REPLACE (round(x, 6) AS x, round(y, 6) AS y) FROM ({MERGED})", "acts"))
def merge_same_facility(spark, sf):
    return rounded(clean.merge_same_facility(A.acts(spark, sf)))


CONSOLIDATED = """SELECT * EXCLUDE (top, low, os, oe) REPLACE (least(start_ts, coalesce(os, start_ts)) AS start_ts, least(end_ts, coalesce(oe, end_ts)) AS end_ts) FROM (SELECT * EXCLUDE (ns, ne, ls, le),
    CASE WHEN act_seq = top THEN ns WHEN act_seq = low THEN ls END os, CASE WHEN act_seq = top THEN ne WHEN act_seq = low THEN le END oe FROM (SELECT *, max(act_seq) OVER c top, min(act_seq) OVER c low, lead(start_ts) OVER w ns, lead(end_ts) OVER w ne, lag(start_ts) OVER w ls, lag(end_ts) OVER w le FROM ({0})
    WINDOW c AS (PARTITION BY vehicle_id, chain_seq), w AS (PARTITION BY vehicle_id ORDER BY chain_seq, act_seq)))"""


@query(build("SELECT vehicle_id, chain_seq, act_seq, start_ts, end_ts FROM (" + CONSOLIDATED.format("SELECT * FROM acts") + ")", "acts"))
def chain_boundary_consolidate(spark, sf):
    return clean.consolidate(A.acts(spark, sf)).select("vehicle_id", "chain_seq", "act_seq", "start_ts", "end_ts")


@query(build("SELECT * REPLACE (round(x, 6) AS x, round(y, 6) AS y) FROM (" + CONSOLIDATED.format(f"SELECT * EXCLUDE (cn) FROM (SELECT *, count(*) OVER (PARTITION BY vehicle_id, chain_seq) cn FROM ({MERGED})) WHERE cn >= 2") + ")", "acts"))
def clean_chains(spark, sf):
    return rounded(clean.clean(A.acts(spark, sf)))


# spatial joins


@query(build("SELECT vehicle_id, chain_seq, act_seq, min(zone_id) zone_id FROM ord JOIN zones ON x > zx AND x < zx + 100 AND y > zy AND y < zy + 100 GROUP BY 1, 2, 3", "ord", "zones"))
def point_in_zone(spark, sf):
    return assign.point_in_zone(A.order_acts(spark, sf), A.zones(spark), 100.0).select("vehicle_id", "chain_seq", "act_seq", "zone_id")


@query(build("""SELECT vehicle_id, chain_seq, act_seq, coalesce(f, facility_id) facility_id, round(coalesce(fx, x), 6) x, round(coalesce(fy, y), 6) y FROM ord LEFT JOIN (
    SELECT vehicle_id, chain_seq, act_seq, arg_min(k.facility_id, (sqrt((x - fx) ^ 2 + (y - fy) ^ 2), k.facility_id)) f, arg_min(fx, (sqrt((x - fx) ^ 2 + (y - fy) ^ 2), k.facility_id)) fx, arg_min(fy, (sqrt((x - fx) ^ 2 + (y - fy) ^ 2), k.facility_id)) fy
    FROM ord o JOIN facs k ON x BETWEEN fx - 5 AND fx + 5 AND y BETWEEN fy - 5 AND fy + 5 GROUP BY 1, 2, 3) USING (vehicle_id, chain_seq, act_seq)""", "ord", "facs"))
def point_in_hull_snap(spark, sf):
    out = assign.snap(A.order_acts(spark, sf), A.facilities(spark, sf), reach=50.0)
    return rounded(out.select("vehicle_id", "chain_seq", "act_seq", "facility_id", "x", "y"))


@query(build("""SELECT vehicle_id, chain_seq, act_seq, coalesce(z, facility_id) facility_id, coalesce(cx, x) x, coalesce(cy, y) y FROM ord LEFT JOIN (
    SELECT vehicle_id, chain_seq, act_seq, min(zone_id) z, arg_min(zx + 50, zone_id) cx, arg_min(zy + 50, zone_id) cy FROM ord JOIN zones ON x BETWEEN zx AND zx + 100 AND y BETWEEN zy AND zy + 100 AND sqrt((x - zx - 50) ^ 2 + (y - zy - 50) ^ 2) <= 60
    WHERE facility_id IS NOT NULL GROUP BY 1, 2, 3) USING (vehicle_id, chain_seq, act_seq)""", "ord", "zones"))
def gap_recode(spark, sf):
    return assign.gap_recode(A.order_acts(spark, sf), A.zones(spark), reach=60.0).select("vehicle_id", "chain_seq", "act_seq", "facility_id", "x", "y")


@query(build("SELECT vehicle_id, chain_seq, act_seq FROM ord WHERE (vehicle_id, chain_seq) IN (SELECT (vehicle_id, chain_seq) FROM ord WHERE facility_id IN ('s1', 's22', 's50'))", "ord"))
def contains_facility_filter(spark, sf):
    return assign.chains_with_facility(A.order_acts(spark, sf), ["s1", "s22", "s50"]).select("vehicle_id", "chain_seq", "act_seq")


# multiplex network


def mx(spark, sf):
    return network.arcs(A.order_acts(spark, sf))


@query(build("SELECT * FROM mx", "mx"))
def mx_arcs(spark, sf):
    return mx(spark, sf)


@query(build("SELECT * FROM edges", "edges"))
def mx_edge_weight(spark, sf):
    return network.edges(mx(spark, sf))


@query(build("SELECT v vertices, e edges, round(CASE WHEN v > 1 THEN e / (v * (v - 1.0)) ELSE 0.0 END, 9) density, lo min_weight, hi max_weight FROM (SELECT count(*) v FROM ends), (SELECT count(*) e FROM edges), (SELECT coalesce(min(weight), 0) lo, coalesce(max(weight), 0) hi FROM mx)", "mx", "edges", "ends"))
def mx_stats(spark, sf):
    return network.stats(mx(spark, sf)).withColumn("density", F.round("density", 9))


@query(build("""SELECT id, CAST(coalesce(i, 0) AS BIGINT) in_order, CAST(coalesce(o, 0) AS BIGINT) out_order, CAST(coalesce(i, 0) + coalesce(o, 0) AS BIGINT) total_order FROM ends LEFT JOIN (SELECT d_id, sum(weight) i FROM edges GROUP BY 1) a ON d_id = id LEFT JOIN (SELECT o_id, sum(weight) o FROM edges GROUP BY 1) b ON o_id = id""", "edges", "ends"))
def mx_node_order(spark, sf):
    return network.node_order(mx(spark, sf))


@query(build("SELECT id, i in_degree, o out_degree, i + o total_degree FROM deg", "deg"))
def mx_degree(spark, sf):
    return network.degrees(mx(spark, sf))


@query(build("SELECT kind, degree, freq, round(share, 9) share, round(cumulative, 9) cumulative FROM dist2", "dist2"))
def mx_degree_distribution(spark, sf):
    out = network.degree_distribution(network.degrees(mx(spark, sf)))
    return out.withColumn("share", F.round("share", 9)).withColumn("cumulative", F.round("cumulative", 9))


@query(build("SELECT kind, round(sum(share * degree * (degree - 2)), 6) q FROM dist2 GROUP BY 1", "dist2"))
def mx_molloy_reed_q(spark, sf):
    return network.molloy_reed(network.degree_distribution(network.degrees(mx(spark, sf)))).withColumn("q", r6("q"))


@query(build("SELECT id, x, y FROM places", "places"))
def mx_nodes(spark, sf):
    return network.nodes(A.order_acts(spark, sf))


@query(build("SELECT o_id from_id, d_id to_id, weight, o.x ox, o.y oy, d.x dx, d.y dy FROM edges JOIN places o ON o.id = o_id JOIN places d ON d.id = d_id", "edges", "places"))
def mx_edge_list(spark, sf):
    acts = A.order_acts(spark, sf)
    return network.edge_list(network.arcs(acts), network.nodes(acts))


@query(build("SELECT o_id, d_id, weight FROM edges WHERE o_id IN (SELECT id FROM places WHERE x BETWEEN 100 AND 600 AND y BETWEEN 100 AND 700) OR d_id IN (SELECT id FROM places WHERE x BETWEEN 100 AND 600 AND y BETWEEN 100 AND 700)", "edges", "places"))
def mx_edges_in_area(spark, sf):
    acts = A.order_acts(spark, sf)
    return network.edges_in_area(network.edges(network.arcs(acts)), network.nodes(acts), area()).select("o_id", "d_id", "weight")


_STEP = "SELECT id, coalesce(g, 0.0) / (SELECT sum(weight * score) FROM edges JOIN {0} ON o_id = id) score FROM ends LEFT JOIN (SELECT d_id, sum(weight * score) g FROM edges JOIN {0} ON o_id = id GROUP BY 1) ON d_id = id"


@query(build("SELECT id, round(score, 9) score FROM (" + _STEP.format("(" + _STEP.format("(" + _STEP.format("(SELECT id, 1.0::DOUBLE score FROM ends)") + ")") + ")") + ")", "edges", "ends"))
def eigenvector_k_steps(spark, sf):
    return graph.eigenvector_steps(network.edges(mx(spark, sf)), 3).withColumn("score", F.round("score", 9))


@query(None)
def betweenness_small(spark, sf):
    return graph.betweenness(network.edges(mx(spark, sf))).withColumn("betweenness", r6("betweenness"))


# second-order network


@query(build("SELECT * FROM pd", "pd"))
def pd_edges(spark, sf):
    return pathnet.edges(A.order_acts(spark, sf))


@query(build("SELECT * FROM starts", "starts"))
def pd_starts(spark, sf):
    return pathnet.starts(A.order_acts(spark, sf))


@query(build("SELECT * FROM ctx", "ctx"))
def pd_contexts(spark, sf):
    return pathnet.contexts(A.order_acts(spark, sf))


@query(build("SELECT node_id, next_id, sum(weight) weight FROM pd WHERE next_id NOT IN ('sink', 'unknown') GROUP BY 1, 2", "pd"))
def pd_collapsed_edges(spark, sf):
    return pathnet.collapsed(pathnet.edges(A.order_acts(spark, sf)))


@query(build("SELECT * FROM pdeg", "pdeg"))
def pd_degrees(spark, sf):
    acts = A.order_acts(spark, sf)
    return pathnet.degrees(pathnet.edges(acts), pathnet.contexts(acts), pathnet.nodes(acts))


@query(build("SELECT n nodes, e edges, round(e * 100.0 / (n * n), 6) density FROM (SELECT count(*) n, CAST(sum(out_degree) AS BIGINT) e FROM pdeg)", "pdeg"))
def pd_stats(spark, sf):
    acts = A.order_acts(spark, sf)
    deg = pathnet.degrees(pathnet.edges(acts), pathnet.contexts(acts), pathnet.nodes(acts))
    return pathnet.stats(deg).withColumn("density", r6("density"))


@query(build("SELECT node_id, coalesce(sum(weight) FILTER (prev_id = 'source' AND next_id <> 'unknown'), 0) source_weight, coalesce(sum(weight) FILTER (next_id = 'sink'), 0) sink_weight FROM pd GROUP BY 1", "pd"))
def pd_source_sink_weight(spark, sf):
    return pathnet.end_weights(pathnet.edges(A.order_acts(spark, sf)))


@query(build("SELECT prev_id, node_id, count(*) out_degree FROM pd WHERE next_id NOT IN ('sink', 'unknown') GROUP BY 1, 2", "pd"))
def pd_context_out_degree(spark, sf):
    return pathnet.context_out_degree(pathnet.edges(A.order_acts(spark, sf)))


@query(build("SELECT o_id, d_id, weight FROM (SELECT node_id o_id, next_id d_id, sum(weight) weight FROM pd WHERE next_id NOT IN ('sink', 'unknown') GROUP BY 1, 2) e JOIN (SELECT DISTINCT id, (s % 97) * 10.0 x, (s % 89) * 10.0 y FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) s FROM born)) a ON a.id = o_id JOIN (SELECT DISTINCT id, (s % 97) * 10.0 x, (s % 89) * 10.0 y FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) s FROM born)) b ON b.id = d_id WHERE (a.x BETWEEN 100 AND 600 AND a.y BETWEEN 100 AND 700) OR (b.x BETWEEN 100 AND 600 AND b.y BETWEEN 100 AND 700)", "pd", "born"))
def pd_edges_in_area(spark, sf):
    acts = A.order_acts(spark, sf)
    e = pathnet.collapsed(pathnet.edges(acts)).select(F.col("node_id").alias("o_id"), F.col("next_id").alias("d_id"), "weight")
    return network.edges_in_area(e, pathnet.nodes(acts), area()).select("o_id", "d_id", "weight")


@query(build("SELECT node_id, string_agg(next_id, ',' ORDER BY next_id) out_ids FROM (SELECT DISTINCT node_id, next_id FROM pd WHERE next_id NOT IN ('sink', 'unknown')) GROUP BY 1", "pd"))
def pd_neighbours(spark, sf):
    return pathnet.neighbours(pathnet.edges(A.order_acts(spark, sf))).withColumn("out_ids", F.array_join("out_ids", ","))


# kernel densities

EXTENT = (0.0, 0.0, 1100.0, 1000.0)


def points(spark, sf):
    s = A.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("id"), ((F.col("s_acctbal") + 1000) / 10).alias("x"), ((F.col("s_suppkey") * 37) % 1000).cast("double").alias("y"), (1 + F.col("s_suppkey") % 3).cast("double").alias("weight"))


def _kde_sql(peak: str, height: str) -> str:
    return build(f"""SELECT CAST(c AS INT) col, CAST(r AS INT) AS \"row\", round(sum(v), 6) AS \"value\" FROM (SELECT c, r, CASE WHEN c = oc AND r = orw THEN {peak} WHEN d <= 60 THEN {height} END v FROM (
        SELECT *, sqrt((x - (c + 0.5) * 25) ^ 2 + (y - (1000 - (r + 0.5) * 25)) ^ 2) d FROM (SELECT *, floor(x / 25) oc, floor((1000 - y) / 25) orw FROM points WHERE x > 0 AND x < 1100 AND y > 0 AND y < 1000), range(44) a(c), range(40) b(r)
        WHERE c BETWEEN floor((x - 60) / 25) AND floor((x + 60) / 25) AND r BETWEEN floor((940 - y) / 25) AND floor((1060 - y) / 25))) WHERE v IS NOT NULL GROUP BY 1, 2""", "points")


def _kde(kind: int):
    return lambda spark, sf: kde.raster(points(spark, sf), kind, 25.0, 60.0, *EXTENT).withColumn("value", r6("value"))


def kde_cell(spark, sf):
    return _kde(kde.CELL)(spark, sf)


query(build("SELECT CAST(floor(x / 25) AS INT) col, CAST(floor((1000 - y) / 25) AS INT) AS \"row\", CAST(count(*) AS DOUBLE) AS \"value\" FROM points WHERE x > 0 AND x < 1100 AND y > 0 AND y < 1000 GROUP BY 1, 2", "points"))(kde_cell)


@query(_kde_sql("weight / 120", "weight / 120"))
def kde_uniform(spark, sf):
    return _kde(kde.UNIFORM)(spark, sf)


@query(_kde_sql("weight / 60", "weight / 60 * (1 - d / 60)"))
def kde_triangular(spark, sf):
    return _kde(kde.TRIANGULAR)(spark, sf)


@query(_kde_sql("weight * 35 / 32", "weight * 35 / 32 * (1 - (d / 60) ^ 2) ^ 3"))
def kde_triweight(spark, sf):
    return _kde(kde.TRIWEIGHT)(spark, sf)


@query(build("SELECT c * 25.0::DOUBLE AS \"xMin\", c * 25.0::DOUBLE + 25 AS \"xMax\", 1000 - r * 25.0::DOUBLE AS \"yMin\", 975 - r * 25.0::DOUBLE AS \"yMax\", n AS \"Value\" FROM (SELECT floor(x / 25) c, floor((1000 - y) / 25) r, CAST(count(*) AS DOUBLE) n FROM points WHERE x > 0 AND x < 1100 AND y > 0 AND y < 1000 GROUP BY 1, 2) WHERE c * 25 + 12.5 > 100 AND c * 25 + 12.5 < 600 AND 987.5 - r * 25 > 100 AND 987.5 - r * 25 < 700", "points"))
def kde_clip(spark, sf):
    return kde.boxes(_kde(kde.CELL)(spark, sf), 25.0, EXTENT[0], EXTENT[3], area())


@query(build("SELECT col, \"row\", CAST(floor(v / max(v) OVER () * 255) AS INT) alpha FROM (SELECT CAST(floor(x / 25) AS INT) col, CAST(floor((1000 - y) / 25) AS INT) AS \"row\", CAST(count(*) AS DOUBLE) v FROM points WHERE x > 0 AND x < 1100 AND y > 0 AND y < 1000 GROUP BY 1, 2)", "points"))
def kde_alpha(spark, sf):
    return kde.alpha(_kde(kde.CELL)(spark, sf))


@query("SELECT \"code\", CAST(floor(x / 50) AS BIGINT) col, CAST(floor(y / 50) AS BIGINT) AS \"row\", CAST(count(*) AS DOUBLE) weight FROM (SELECT CAST(p_size % 9 AS VARCHAR) AS \"code\", p_retailprice x, CAST((p_partkey * 37) % 1000 AS DOUBLE) y FROM part) GROUP BY 1, 2, 3")
def landuse_density(spark, sf):
    p = A.table(spark, sf, "part")
    return kde.land_use(p.select(F.concat((F.col("p_size") % 9).cast("string"), F.lit("."), F.col("p_size").cast("string")).alias("code"), F.col("p_retailprice").alias("x"), ((F.col("p_partkey") * 37) % 1000).cast("double").alias("y")), 50.0)


# similarity


@query(build("""SELECT a.vehicle_id, a.chain_seq chain_1, b.chain_seq chain_2, CAST(sum(CASE WHEN p.pos IS NULL OR q.pos IS NULL THEN 10.0 ELSE (p.pos - q.pos) ^ 2 END) AS DOUBLE) dissimilarity
    FROM ch a JOIN ch b ON a.vehicle_id = b.vehicle_id AND a.chain_seq < b.chain_seq JOIN fac f ON f.vehicle_id = a.vehicle_id LEFT JOIN fp p ON p.vehicle_id = a.vehicle_id AND p.chain_seq = a.chain_seq AND p.f = f.f
    LEFT JOIN fp q ON q.vehicle_id = b.vehicle_id AND q.chain_seq = b.chain_seq AND q.f = f.f GROUP BY 1, 2, 3""", "acts").replace("\nSELECT a.vehicle_id", """,
    fp AS MATERIALIZED (SELECT vehicle_id, chain_seq, coalesce(facility_id, 'p' || x || '_' || y) f, min(act_seq) pos FROM acts GROUP BY 1, 2, 3), ch AS (SELECT DISTINCT vehicle_id, chain_seq FROM fp), fac AS (SELECT DISTINCT vehicle_id, f FROM fp)
    SELECT a.vehicle_id""", 1))
def position_dissimilarity(spark, sf):
    return similarity.position_dissimilarity(A.acts(spark, sf), 10.0)


@query(None)
def chain_overlap(spark, sf):
    return similarity.chain_overlap(A.acts(spark, sf), 2.0).withColumn("overlap", F.round("overlap", 4))


# sampling


def _draws(spark, sf):
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), u_of(F.col("o_orderkey")).alias("u"))


U = "(o_orderkey * 7919 % 10007) / 10007.0::DOUBLE"


@query(build(f"""SELECT id, o_type, min(o_id) o_id FROM (SELECT o_orderkey id, CASE WHEN o_orderkey % 2 = 0 THEN 'major' ELSE 'minor' END o_type, {U} u FROM orders) JOIN (
    SELECT o_type, o_id, sum(w) OVER (PARTITION BY o_type ORDER BY o_id) / sum(w) OVER (PARTITION BY o_type) cum FROM (SELECT o_type, o_id, sum(weight) w FROM mx GROUP BY 1, 2)) USING (o_type) WHERE cum >= u GROUP BY 1, 2""", "mx"))
def weighted_origin_pick(spark, sf):
    draws = _draws(spark, sf).withColumn("o_type", F.when(F.col("id") % 2 == 0, "major").otherwise("minor"))
    return sample.origins(mx(spark, sf), draws).select("id", "o_type", "o_id")


@query(build(f"""SELECT id, coalesce(a, b) d_id, CASE WHEN a IS NULL THEN 'type' ELSE 'origin' END AS \"by\" FROM (SELECT id, min(x.d_id) FILTER (x.cum >= u) a FROM dr LEFT JOIN ow x ON x.o_id = dr.o_id AND x.d_type = dr.d_type GROUP BY 1) JOIN (SELECT id, min(y.d_id) FILTER (y.cum >= u) b FROM dr LEFT JOIN al y ON y.d_type = dr.d_type GROUP BY 1) USING (id) WHERE coalesce(a, b) IS NOT NULL""", "mx").replace("\nSELECT id, coalesce(a, b)", f""",
    dr AS MATERIALIZED (SELECT o_orderkey id, 's' || (o_orderkey % 120) o_id, CASE WHEN o_orderkey % 2 = 0 THEN 'major' ELSE 'minor' END d_type, {U} u FROM orders),
    ow AS MATERIALIZED (SELECT o_id, d_type, d_id, sum(w) OVER (PARTITION BY o_id, d_type ORDER BY d_id) / sum(w) OVER (PARTITION BY o_id, d_type) cum FROM (SELECT o_id, d_type, d_id, sum(weight) w FROM mx GROUP BY 1, 2, 3)),
    al AS MATERIALIZED (SELECT d_type, d_id, sum(w) OVER (PARTITION BY d_type ORDER BY d_id) / sum(w) OVER (PARTITION BY d_type) cum FROM (SELECT d_type, d_id, sum(weight) w FROM mx GROUP BY 1, 2))
    SELECT id, coalesce(a, b)""", 1))
def weighted_destination_pick(spark, sf):
    draws = _draws(spark, sf).withColumn("o_id", F.concat(F.lit("s"), F.col("id") % 120)).withColumn("d_type", F.when(F.col("id") % 2 == 0, "major").otherwise("minor"))
    return sample.destinations(mx(spark, sf), draws)


@query(build(f"SELECT o_orderkey id, min(node_id) node_id FROM orders JOIN (SELECT node_id, sum(w) OVER (ORDER BY node_id) / sum(w) OVER () cum FROM (SELECT node_id, sum(weight) w FROM pd WHERE prev_id = 'source' AND next_id <> 'unknown' GROUP BY 1)) ON cum >= {U} GROUP BY 1", "pd"))
def pd_start_pick(spark, sf):
    return sample.start_nodes(pathnet.edges(A.order_acts(spark, sf)), _draws(spark, sf))


def _contexts(spark, sf):
    """One draw for each context, in place of a walk's state."""
    pd = A.written(pathnet.edges(A.order_acts(spark, sf)))
    ctx = pd.select("prev_id", "node_id").distinct()
    u = (F.length("prev_id") * 7 + F.length("node_id") * 11 + F.ascii(F.right("node_id", F.lit(1))) * 13) % 10 / F.lit(10.0) + 0.05
    return pd, ctx.select(F.concat("prev_id", F.lit(">"), "node_id").alias("id"), "prev_id", "node_id", u.alias("u"))


_CTX = """,
    dr AS MATERIALIZED (SELECT DISTINCT prev_id || '>' || node_id id, prev_id, node_id, (length(prev_id) * 7 + length(node_id) * 11 + ascii(right(node_id, 1)) * 13) % 10 / 10.0::DOUBLE + 0.05 u FROM pd),
    rl AS MATERIALIZED (SELECT * FROM pd WHERE next_id NOT IN ('sink', 'unknown')), sk AS MATERIALIZED (SELECT node_id, sum(weight) w FROM pd WHERE next_id = 'sink' GROUP BY 1),
    {0}
    SELECT id, coalesce(a, b) next_id FROM (SELECT id, min(x.next_id) FILTER (x.cum >= u) a FROM dr LEFT JOIN ow x ON x.prev_id = dr.prev_id AND x.node_id = dr.node_id GROUP BY 1) JOIN (SELECT id, min(y.next_id) FILTER (y.cum >= u) b FROM dr LEFT JOIN al y ON {1} GROUP BY 1) USING (id)"""


@query(build("SELECT 0", "pd").replace("\nSELECT 0", _CTX.format("""ow AS MATERIALIZED (SELECT prev_id, node_id, next_id, sum(weight) OVER (PARTITION BY prev_id, node_id ORDER BY next_id) / sum(weight) OVER (PARTITION BY prev_id, node_id) cum FROM rl),
    al AS MATERIALIZED (SELECT node_id, next_id, sum(w) OVER (PARTITION BY node_id ORDER BY next_id) / sum(w) OVER (PARTITION BY node_id) cum FROM (SELECT DISTINCT r.node_id, next_id, w FROM rl r JOIN sk ON sk.node_id = next_id))""", "y.node_id = dr.node_id")))
def pd_next_pick(spark, sf):
    return sample.next_nodes(*_contexts(spark, sf))


@query(build("SELECT 0", "pd").replace("\nSELECT 0", _CTX.format("""ow AS MATERIALIZED (SELECT prev_id, node_id, next_id, sum(w) OVER (PARTITION BY prev_id, node_id ORDER BY next_id) / sum(w) OVER (PARTITION BY prev_id, node_id) cum FROM (SELECT r.prev_id, r.node_id, r.next_id, s.weight w FROM rl r JOIN pd s ON s.next_id = 'sink' AND s.prev_id = r.node_id AND s.node_id = r.next_id)),
    al AS MATERIALIZED (SELECT prev_id, node_id, next_id, sum(w) OVER (PARTITION BY prev_id, node_id ORDER BY next_id) / sum(w) OVER (PARTITION BY prev_id, node_id) cum FROM (SELECT r.prev_id, r.node_id, next_id, w FROM rl r JOIN sk ON sk.node_id = next_id))""", "y.node_id = dr.node_id AND y.prev_id = dr.prev_id")))
def pd_end_pick(spark, sf):
    return sample.end_nodes(*_contexts(spark, sf))


@query(build(f"""SELECT o_orderkey id, 's' || (o_orderkey % 120) node_id, CAST(split_part(min(s), ',', 1) AS INT) AS \"hour\", CAST(split_part(min(s), ',', 2) AS BIGINT) activities FROM orders JOIN (
    SELECT node_id, s, sum(w) OVER (PARTITION BY node_id ORDER BY s) / sum(w) OVER (PARTITION BY node_id) cum FROM (SELECT node_id, CAST(\"hour\" AS VARCHAR) || ',' || CAST(activities AS VARCHAR) s, \"count\" w FROM starts)) c ON c.node_id = 's' || (o_orderkey % 120) AND cum >= {U} GROUP BY 1, 2""", "starts"))
def pd_start_hour_pick(spark, sf):
    draws = _draws(spark, sf).withColumn("node_id", F.concat(F.lit("s"), F.col("id") % 120))
    return sample.start_hours(pathnet.starts(A.order_acts(spark, sf)), draws)


@query(f"SELECT id, round(list_extract(d, k + 1) + (u * 10 - k) * (list_extract(d, k + 2) - list_extract(d, k + 1)), 6) AS \"seconds\" FROM (SELECT o_orderkey id, {U} u, CAST(least(floor({U} * 10), 9) AS INT) k, {DECILES}::DOUBLE[] d FROM orders)")
def duration_inverse_cdf(spark, sf):
    return _draws(spark, sf).select("id", r6(sample.inverse_cdf(F.col("u"), DECILES)).alias("seconds"))


@query(build("SELECT vehicle_id, count(*) chains, count(*) FILTER (" + weekday("t") + " BETWEEN 2 AND 6) weekday_chains FROM cends GROUP BY 1", "cends"))
def bootstrap_counts(spark, sf):
    ends = reports.chain_ends(A.order_acts(spark, sf))
    return ends.groupBy("vehicle_id").agg(F.count("*").alias("chains"), F.count_if(calendar.day_of_week(F.col("first_end")).between(2, 6)).alias("weekday_chains"))


@query(None)
def bootstrap_population(spark, sf):
    chains = A.order_acts(spark, sf).select("vehicle_id", "chain_seq").distinct()
    return sample.bootstrap(chains, 1000, 20150317)


@query(None)
def generate_chains(spark, sf):
    acts = A.written(A.order_acts(spark, sf))
    return generate.plans(*(A.written(part(acts)) for part in (pathnet.edges, pathnet.starts, pathnet.nodes)), 500, "p", DECILES, seed=7)


@query(None)
def bootstrap_plans(spark, sf):
    acts = A.order_acts(spark, sf)
    drawn = sample.bootstrap(acts.select("vehicle_id", "chain_seq").distinct(), 300, 20150317)
    return sample.bootstrap_plans(acts, drawn, "b")


@query(None)
def zone_interior_points(spark, sf):
    return sample.interior_points(A.zones(spark), 3)


@query(None)
def mx_artificial_edges(spark, sf):
    return network.artificial_edges(mx(spark, sf), 1)


# clusters


def cluster_points(spark, sf):
    p = A.table(spark, sf, "customer")
    return p.select(((F.col("c_nationkey") % 5).cast("string")).alias("zone_id"), F.col("c_custkey").alias("point_id"), ((F.col("c_acctbal") * 7) % 900).alias("x"), ((F.col("c_custkey") * 53) % 600).cast("double").alias("y"))


@query(None)
def dj_cluster(spark, sf):
    return cluster.cluster(cluster_points(spark, sf), 30.0, 4)


@query(None)
def concave_hull(spark, sf):
    out = cluster.facilities(cluster.cluster(cluster_points(spark, sf), 30.0, 4), 25.0)
    return out.withColumn("hull", geo.encode_hull(F.col("hull")))


# files: written by the writers, read again by the readers


@query("""SELECT CAST(user_id AS VARCHAR) vehicle_id, date_diff('second', TIMESTAMP '1970-01-01', ts) AS "time", CAST(event_id % 90 AS DOUBLE) / 4 lon, -CAST(event_id % 70 AS DOUBLE) / 8 lat, CAST(event_id % 16 AS VARCHAR) status, CAST(event_id % 120 AS INT) speed
    FROM events WHERE event_id % 10 > 2""")
def raw_gps_parse(spark, sf):
    """Lines of records in another order of fields, some broken: too few fields, too many, a text for a number."""
    e = A.table(spark, sf, "events")
    k = F.col("event_id") % 10
    line = F.concat_ws(",", A.epoch("ts"), -(F.col("event_id") % 70).cast("double") / 8, (F.col("event_id") % 90).cast("double") / 4, F.col("event_id") % 120, F.col("event_id") % 16, "user_id")
    line = F.when(k == 0, F.substring_index(line, ",", 5)).when(k == 1, F.concat(line, F.lit(",9"))).when(k == 2, F.concat(F.lit("x"), line)).otherwise(line)
    path = A.scratch(spark)
    e.select(line.alias("value")).write.text(path)
    return readers.raw_gps(spark, path, {"time": 0, "lat": 1, "lon": 2, "speed": 3, "status": 4, "vehicle_id": 5}).drop("seq")


@query(build('SELECT vehicle_id, chain_seq, act_seq, "type", start_ts, end_ts, x, y, facility_id FROM ord', "ord"))
def vehicles_xml_roundtrip(spark, sf):
    path = A.scratch(spark)
    writers.write_vehicles(A.order_acts(spark, sf), None, path)
    return _chains_by_order(spark, sf, readers.xml_activities(readers.vehicles_xml(spark, path)))


def _chains_by_order(spark, sf, rows):
    """A file holds chains in order, without numbers: the nth chain of a vehicle gets its number again."""
    place = Window.partitionBy("vehicle_id").orderBy("chain_seq")
    numbers = A.order_acts(spark, sf).select("vehicle_id", "chain_seq").distinct().select("vehicle_id", F.col("chain_seq").alias("number"), (F.row_number().over(place) - 1).alias("chain_seq"))
    return rows.join(numbers, ["vehicle_id", "chain_seq"]).select("vehicle_id", F.col("number").alias("chain_seq"), "act_seq", "type", "start_ts", "end_ts", "x", "y", "facility_id")


def _places(spark, sf):
    a = A.order_acts(spark, sf).where("facility_id is not null")
    return a.groupBy(F.col("facility_id").alias("id")).agg(F.min("x").alias("x"), F.min("y").alias("y"))


@query(build("SELECT mx.*, p.x o_x, p.y o_y FROM mx JOIN (SELECT facility_id id, min(x) x, min(y) y FROM ord WHERE facility_id IS NOT NULL GROUP BY 1) p ON p.id = o_id", "mx", "ord"))
def network_text_roundtrip(spark, sf):
    path = A.scratch(spark)
    arcs = mx(spark, sf)
    ends = arcs.select(F.explode(F.array("o_id", "d_id")).alias("id")).distinct()
    writers.write_network(_places(spark, sf).join(ends, "id", "left_semi"), arcs, path)
    nodes, back = readers.network_text(spark, path)
    return back.join(nodes.select(F.col("id").alias("o_id"), F.col("x").alias("o_x"), F.col("y").alias("o_y")), "o_id")


@query(build("SELECT * FROM pd", "pd"))
def pdnet_xml_roundtrip(spark, sf):
    acts, path = A.order_acts(spark, sf), A.scratch(spark)
    edges = pathnet.edges(acts)
    writers.write_path_network(_places(spark, sf), edges, pathnet.contexts(acts), pathnet.starts(acts), path)
    _, back, _ = readers.path_network_xml(spark, path)
    return back.select(*(F.col(c).cast(dict(edges.dtypes)[c]).alias(c) for c in edges.columns))


@query("""SELECT 'h' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') facility_id, (s_suppkey % 97) * 10.0::DOUBLE + 2 x, (s_suppkey % 89) * 10.0::DOUBLE + 2 y, CAST(s_suppkey % 50 AS BIGINT) activity_count, true same
    FROM supplier WHERE s_suppkey % 7 = 0""")
def facilities_xml_roundtrip(spark, sf):
    path = A.scratch(spark)
    f = A.facilities(spark, sf).select("facility_id", F.col("fx").alias("x"), F.col("fy").alias("y"), "hull", (F.substring("facility_id", 2, 6).cast("long") % 50).alias("activity_count"))
    writers.write_facilities(f, path)
    back = readers.facilities_xml(spark, path)
    return back.join(f.select("facility_id", F.col("hull").alias("given")), "facility_id").select("facility_id", "x", "y", "activity_count", (F.col("hull") == F.col("given")).alias("same"))
