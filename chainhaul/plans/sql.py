"""The same tables as DuckDB SQL: named parts, put together with what they need."""

from __future__ import annotations

V = "PARTITION BY vehicle_id ORDER BY"
C = "PARTITION BY vehicle_id, chain_seq ORDER BY act_seq"

PARTS: dict[str, tuple[str, list[str]]] = {
    "gps": ("""SELECT CAST(user_id AS VARCHAR) vehicle_id, event_id seq, date_diff('second', TIMESTAMP '1970-01-01', ts) t,
        value - 50 * floor(value / 50) lon, CAST(-(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 40) AS DOUBLE) lat, event_type status FROM events""", []),
    "bounded": ("SELECT * FROM gps WHERE lon BETWEEN 0 AND 45 AND lat BETWEEN -36 AND 0", ["gps"]),
    "moved": (f"""SELECT *, row_number() OVER ({V} t, seq) rn, coalesce(last_value(CASE WHEN status IN ('click', 'view') THEN true WHEN status IN ('purchase', 'error') THEN false END IGNORE NULLS)
        OVER ({V} t, seq ROWS UNBOUNDED PRECEDING), true) moving FROM bounded""", ["bounded"]),
    "turns": (f"SELECT *, coalesce(CAST(moving <> lag(moving) OVER ({V} rn) AS INT), 1) turn FROM moved", ["moved"]),
    "runs": (f"SELECT *, sum(turn) OVER ({V} rn ROWS UNBOUNDED PRECEDING) run FROM turns", ["turns"]),
    "stops": ("SELECT vehicle_id, run, min(rn) first_rn, max(rn) + 1 close_rn, arg_min(t, rn) start_ts, sum(lon) sx, sum(lat) sy, count(*) n FROM runs WHERE NOT moving GROUP BY vehicle_id, run", ["runs"]),
    "acts0": ("""SELECT s.vehicle_id, first_rn, close_rn, start_ts, m.t end_ts, (sx + lon) / (n + 1) x, (sy + lat) / (n + 1) y, CASE WHEN m.t - start_ts >= 86400 THEN 'major' ELSE 'minor' END "type"
        FROM stops s JOIN moved m ON s.vehicle_id = m.vehicle_id AND m.rn = s.close_rn WHERE m.t - start_ts >= 3600""", ["stops", "moved"]),
    "acts1": (f"""SELECT *, sum(CAST("type" = 'major' AS INT)) OVER ({V} first_rn ROWS UNBOUNDED PRECEDING) nth, sum(CAST("type" = 'major' AS INT)) OVER (PARTITION BY vehicle_id) majors, lead(first_rn) OVER ({V} first_rn) next_rn FROM acts0""", ["acts0"]),
    "acts2": ("""SELECT *, nth chain FROM acts1 WHERE nth BETWEEN 1 AND majors - 1 UNION ALL SELECT *, nth - 1 FROM acts1 WHERE "type" = 'major' AND nth >= 2""", ["acts1"]),
    "chained": ("SELECT *, CAST(chain AS INT) chain_seq, CAST(row_number() OVER (PARTITION BY vehicle_id, chain ORDER BY first_rn) - 1 AS INT) act_seq FROM acts2", ["acts2"]),
    "acts": ("""SELECT vehicle_id, chain_seq, act_seq, "type", start_ts, end_ts, x, y, CASE WHEN CAST(floor(x / 5) * 10 + floor(-y / 5) AS BIGINT) % 4 <> 0 THEN 'f' || CAST(floor(x / 5) * 10 + floor(-y / 5) AS BIGINT) END facility_id FROM chained""", ["chained"]),
    "ord": ("""SELECT 'c' || o_custkey vehicle_id, CAST(o_orderkey AS INT) chain_seq, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) act_seq,
        CASE WHEN l_returnflag = 'R' THEN 'major' ELSE 'minor' END "type", date_diff('second', TIMESTAMP '1970-01-01', l_shipdate) + l_linenumber * 600 start_ts,
        date_diff('second', TIMESTAMP '1970-01-01', l_shipdate) + l_linenumber * 600 + CAST(l_quantity AS BIGINT) * 60 end_ts, (l_suppkey % 97) * 10.0::DOUBLE x, (l_suppkey % 89) * 10.0::DOUBLE y,
        CASE WHEN l_suppkey % 7 <> 0 THEN 's' || l_suppkey END facility_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", []),
    "pairs": (f"""SELECT * FROM (SELECT facility_id o_id, "type" o_type, lead(facility_id) OVER ({C}) d_id, lead("type") OVER ({C}) d_type FROM ord) WHERE o_id IS NOT NULL AND d_id IS NOT NULL""", ["ord"]),
    "mx": ("SELECT o_id, d_id, o_type, d_type, count(*) weight FROM pairs GROUP BY ALL", ["pairs"]),
    "edges": ("SELECT o_id, d_id, CAST(sum(weight) AS BIGINT) weight FROM mx GROUP BY ALL", ["mx"]),
    "ends": ("SELECT o_id id FROM mx UNION SELECT d_id FROM mx", ["mx"]),
    "places": (f"""SELECT facility_id id, arg_min(x, (vehicle_id, chain_seq, act_seq)) x, arg_min(y, (vehicle_id, chain_seq, act_seq)) y FROM ord WHERE facility_id IN (SELECT id FROM ends) GROUP BY 1""", ["ord", "ends"]),
    "deg": ("SELECT id, CAST((SELECT count(*) FROM edges WHERE d_id = id) AS BIGINT) i, CAST((SELECT count(*) FROM edges WHERE o_id = id) AS BIGINT) o FROM ends", ["edges", "ends"]),
    "dist": ("""SELECT kind, degree, count(*) freq FROM (SELECT 'in' kind, i degree FROM deg UNION ALL SELECT 'out', o FROM deg UNION ALL SELECT 'total', i + o FROM deg) GROUP BY ALL""", ["deg"]),
    "dist2": ("SELECT kind, degree, freq, freq / sum(freq) OVER (PARTITION BY kind) share, sum(freq) OVER (PARTITION BY kind ORDER BY degree) / sum(freq) OVER (PARTITION BY kind) cumulative FROM dist", ["dist"]),
    "pr": (f"""SELECT *, lag(facility_id) OVER ({C}) prev, lead(facility_id) OVER ({C}) nxt, row_number() OVER ({C}) - 1 i, count(*) OVER (PARTITION BY vehicle_id, chain_seq) n,
        sum(CAST(lower("type") = 'minor' AS BIGINT)) OVER (PARTITION BY vehicle_id, chain_seq) minors, (vehicle_id, chain_seq) rk FROM ord""", ["ord"]),
    "made": ("SELECT facility_id id, rk FROM pr WHERE facility_id IS NOT NULL AND i < n - 1 UNION ALL SELECT nxt, rk FROM pr WHERE facility_id IS NOT NULL AND i < n - 1 AND nxt IS NOT NULL", ["pr"]),
    "born": ("SELECT id, min(rk) born FROM made GROUP BY id", ["made"]),
    "pd": ("""SELECT prev_id, node_id, next_id, CAST(count(*) AS DOUBLE) weight FROM (
        SELECT CASE WHEN i = 0 THEN 'source' ELSE coalesce(prev, 'unknown') END prev_id, facility_id node_id, coalesce(nxt, 'unknown') next_id FROM pr WHERE facility_id IS NOT NULL AND n > 1 AND i < n - 1
        UNION ALL SELECT coalesce(prev, 'unknown'), facility_id, 'sink' FROM pr JOIN born ON facility_id = id AND born <= rk WHERE n > 1 AND i = n - 1) GROUP BY ALL""", ["pr", "born"]),
    "ctx": ("SELECT prev_id, node_id FROM pd UNION SELECT facility_id, nxt FROM pr WHERE facility_id IS NOT NULL AND i < n - 1 AND nxt IS NOT NULL", ["pd", "pr"]),
    "pdeg": ("""SELECT id, coalesce(i, 0) in_degree, coalesce(o, 0) out_degree FROM born
        LEFT JOIN (SELECT node_id, count(DISTINCT prev_id) i FROM ctx WHERE prev_id NOT IN ('source', 'unknown') GROUP BY 1) a ON a.node_id = id
        LEFT JOIN (SELECT node_id, count(DISTINCT next_id) o FROM pd WHERE next_id NOT IN ('sink', 'unknown') GROUP BY 1) b ON b.node_id = id""", ["born", "ctx", "pd"]),
    "starts": ("""SELECT facility_id node_id, CAST(floor(((end_ts + 7200) % 86400) / 3600) AS INT) AS "hour", CAST(minors AS BIGINT) activities, count(*) "count" FROM pr WHERE i = 0 AND n > 1 AND facility_id IS NOT NULL GROUP BY ALL""", ["pr"]),
    "ends2": ("""SELECT vehicle_id, chain_seq, arg_min(end_ts, act_seq) t, arg_max(start_ts, act_seq) u, arg_min("type", act_seq) ft, arg_max("type", act_seq) lt, count(*) n, count(*) FILTER (lower("type") = 'minor') minors FROM acts GROUP BY ALL""", ["acts"]),
    "cends": ("""SELECT vehicle_id, chain_seq, arg_min(end_ts, act_seq) t FROM ord GROUP BY ALL""", ["ord"]),
    "zones": ("SELECT 'z' || lpad(CAST(k AS VARCHAR), 3, '0') zone_id, CAST(floor(k / 10) * 100 AS DOUBLE) zx, CAST((k % 10) * 100 AS DOUBLE) zy FROM range(100) r(k)", []),
    "facs": ("SELECT 'h' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') facility_id, (s_suppkey % 97) * 10.0::DOUBLE + 2 fx, (s_suppkey % 89) * 10.0::DOUBLE + 2 fy FROM supplier WHERE s_suppkey % 7 = 0", []),
    "points": ("""SELECT CAST(s_suppkey AS VARCHAR) id, (s_acctbal + 1000) / 10 x, CAST((s_suppkey * 37) % 1000 AS DOUBLE) y, CAST(1 + s_suppkey % 3 AS DOUBLE) weight FROM supplier""", []),
}


def build(select: str, *needs: str) -> str:
    """WITH the named parts and all they need, in order, then the select."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in PARTS[name][1]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name][0]})" for name in order)
    return f"WITH {parts}\n{select}" if order else select


def day(t: str) -> str:
    return f"CAST(floor(({t} + 7200) / 86400) AS BIGINT)"


def date(t: str) -> str:
    return f"(DATE '1970-01-01' + CAST({day(t)} AS INT))"


def second(t: str) -> str:
    return f"CAST(({t} + 7200) % 86400 AS BIGINT)"


def hour(t: str) -> str:
    return f"CAST(floor((({t} + 7200) % 86400) / 3600) AS INT)"


def weekday(t: str) -> str:
    return f"CAST(({day(t)} + 4) % 7 + 1 AS INT)"
