"""Writers: vehicles, facilities, networks and plans, as text built row by row in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar, geo


def _attr(name: str, value: Column) -> Column:
    """ name="value", or nothing for null."""
    safe = F.replace(F.replace(F.replace(value.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.coalesce(F.concat(F.lit(f' {name}="'), safe, F.lit('"')), F.lit(""))


def _number(form: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string(form, value))


def vehicle_elements(acts: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """vehicle_id and its element as text; activities and traces in turn. Without positions: version 1."""
    a = F.concat(F.lit("\t\t\t<activity"), _attr("type", F.col("type")), _attr("start", calendar.stamp(F.col("start_ts"))), _attr("end", calendar.stamp(F.col("end_ts"))), _attr("x", _number("%.2f", F.col("x"))), _attr("y", _number("%.2f", F.col("y"))), _attr("facility", F.col("facility_id")), F.lit("/>\n"))
    parts = acts.select("vehicle_id", "chain_seq", (F.col("act_seq") * 2).alias("place"), a.alias("text"))
    if positions is not None:
        p = F.concat(F.lit("\t\t\t\t<position"), _attr("time", calendar.stamp(F.col("ts"))), _attr("x", _number("%.6f", F.col("x"))), _attr("y", _number("%.6f", F.col("y"))), *([_attr("z", _number("%.6f", F.col("z")))] if "z" in positions.columns else []), F.lit("/>\n"))
        rows = positions.select("vehicle_id", "chain_seq", "trace_seq", "pos_seq", p.alias("text"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos_seq", "text"))), lambda s: s["text"]), "")
        traces = rows.groupBy("vehicle_id", "chain_seq", "trace_seq").agg(F.concat(F.lit("\t\t\t<trace>\n"), text, F.lit("\t\t\t</trace>\n")).alias("text"))
        parts = parts.unionByName(traces.select("vehicle_id", "chain_seq", (F.col("trace_seq") * 2 + 1).alias("place"), "text"))
    joined = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "text"))), lambda s: s["text"]), "")
    chains = parts.groupBy("vehicle_id", "chain_seq").agg(F.concat(F.lit("\t\t<chain>\n"), joined("place"), F.lit("\t\t</chain>\n")).alias("text"))
    return chains.groupBy("vehicle_id").agg(joined("chain_seq").alias("text")).select("vehicle_id", F.concat(F.lit("\t<digicoreVehicle"), _attr("id", F.col("vehicle_id")), F.lit(' type="commercial" timezone="GMT+2" locale="en">\n'), F.col("text"), F.lit("\t</digicoreVehicle>")).alias("text"))


def write_vehicles(acts: DataFrame, positions: DataFrame | None, path: str, crs: str = "Atlantis", trace_crs: str | None = None, description: str | None = None) -> None:
    """A folder of container parts, each a well-formed container; traces of another crs are refused."""
    if positions is not None and trace_crs not in (None, crs):
        raise ValueError(f"traces have the crs {trace_crs}, the container {crs}")
    attributes = f' crs="{crs}"' + (f' desc="{description}"' if description else "")
    write_document(vehicle_elements(acts, positions).select("text"), path, "digicoreVehicles", f"digicoreVehicles_v{1 if positions is None else 2}.dtd", attributes)


def write_document(elements: DataFrame, path: str, root: str, doctype: str | None, attributes: str = "", overwrite: bool = False) -> None:
    """A folder of parts, each a well-formed document with this root around the elements of a column of texts; refuses to overwrite unless asked."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n' + (f'<!DOCTYPE {root} SYSTEM "{doctype}">\n' if doctype else "") + f"<{root}{attributes}>"

    def wrap(batches):
        import pandas as pd

        begun = False
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"value": ([] if begun else [head]) + pdf.iloc[:, 0].tolist()})
                begun = True
        if begun:
            yield pd.DataFrame({"value": [f"</{root}>"]})

    elements.mapInPandas(wrap, "value string").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_facilities(facilities: DataFrame, path: str, overwrite: bool = False) -> None:
    write_document(facility_elements(facilities), path, "facilities", None, "", overwrite)


def write_path_network(nodes: DataFrame, edges: DataFrame, contexts: DataFrame, starts: DataFrame, path: str, description: str | None = None, overwrite: bool = False) -> None:
    """A path-dependent network of version 2."""
    attributes = f' desc="{description}"' if description else ""
    write_document(path_network_elements(nodes, edges, contexts, starts).select("text"), path, "digicoreNetwork", "digicorePathDependentNetwork_v2.dtd", attributes, overwrite)


def write_plans(plans: DataFrame, path: str, overwrite: bool = False) -> None:
    write_document(plan_elements(plans).select("text"), path, "population", None, "", overwrite)


def facility_elements(facilities: DataFrame) -> DataFrame:
    return facilities.select(F.concat(F.lit("<facility"), _attr("id", F.col("facility_id")), _attr("x", F.col("x")), _attr("y", F.col("y")), F.lit('><attributes><attribute name="concaveHull">'), geo.encode_hull(F.col("hull")), F.lit('</attribute><attribute name="digicoreActivityCount">'), F.col("activity_count").cast("string"), F.lit("</attribute></attributes></facility>")).alias("value"))


def facilities_csv(facilities: DataFrame) -> DataFrame:
    return facilities.select("facility_id", F.format_string("%.1f", "x").alias("x"), F.format_string("%.1f", "y").alias("y"), F.col("activity_count").alias("Count"))


def network_lines(nodes: DataFrame, mx: DataFrame) -> DataFrame:
    """section, place and text of a node and arc file, to be written in (section, place, value) order."""
    head = nodes.sparkSession.createDataFrame([(0, 0, "NODES"), (0, 1, "NodeId,Long,Lat"), (1, 0, "ARCS"), (1, 1, "From_Id,To_Id,From_Type,To_Type,Weight")], "section int, place int, value string")
    n = nodes.select(F.lit(0).alias("section"), F.lit(2).alias("place"), F.concat("id", F.format_string(",%.4f,%.4f", "x", "y")).alias("value"))
    a = mx.select(F.lit(1).alias("section"), F.lit(2).alias("place"), F.concat_ws(",", "o_id", "d_id", "o_type", "d_type", "weight").alias("value"))
    return head.unionByName(n).unionByName(a)


def write_network(nodes: DataFrame, mx: DataFrame, path: str, overwrite: bool = False) -> None:
    rows = network_lines(nodes, mx).orderBy("section", "place", "value")
    rows.select("value").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def path_network_elements(nodes: DataFrame, edges: DataFrame, contexts: DataFrame, starts: DataFrame) -> DataFrame:
    """id and element of each node; contexts without an edge get sink with weight 1."""
    bare = contexts.join(edges, ["prev_id", "node_id"], "left_anti").select("prev_id", "node_id", F.lit("sink").alias("next_id"), F.lit(1.0).alias("weight"))
    f = F.concat(F.lit("\t\t\t<following"), _attr("id", F.col("next_id")), _attr("weight", F.col("weight")), F.lit("/>\n"))
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda s: s["text"]), "")
    rows = edges.unionByName(bare).select("node_id", "prev_id", F.col("next_id").alias("key"), f.alias("text")).groupBy("node_id", "prev_id").agg(joined().alias("text"))
    p = rows.select("node_id", F.col("prev_id").alias("key"), F.concat(F.lit("\t\t<preceding"), _attr("id", F.col("prev_id")), F.lit(">\n"), F.col("text"), F.lit("\t\t</preceding>\n")).alias("text")).groupBy("node_id").agg(joined().alias("pre"))
    s = starts.select("node_id", F.concat(F.lpad(F.col("hour").cast("string"), 3, "0"), F.lpad(F.col("activities").cast("string"), 9, "0")).alias("key"), F.concat(F.lit("\t\t<startnode"), _attr("hour", F.col("hour")), _attr("activities", F.col("activities")), _attr("count", F.col("count")), F.lit("/>\n")).alias("text")).groupBy("node_id").agg(joined().alias("start"))
    out = nodes.join(p, F.col("id") == p.node_id, "left").drop("node_id").join(s, F.col("id") == s.node_id, "left").drop("node_id")
    return out.select("id", F.concat(F.lit("\t<node"), _attr("id", F.col("id")), _attr("x", F.col("x")), _attr("y", F.col("y")), F.lit(">\n"), F.coalesce("start", F.lit("")), F.coalesce("pre", F.lit("")), F.lit("\t</node>")).alias("text"))


def plan_elements(plans: DataFrame) -> DataFrame:
    """person_id and its person element, from plans (person_id, elem_seq, kind, type, facility_id, x, y, end_time, max_dur)."""
    act = F.concat(F.lit("\t\t\t<activity"), _attr("type", F.col("type")), _attr("facility", F.col("facility_id")), _attr("x", F.col("x")), _attr("y", F.col("y")), _attr("end_time", F.col("end_time")), _attr("max_dur", F.col("max_dur")), F.lit("/>\n"))
    text = F.when(F.col("kind") == "leg", '\t\t\t<leg mode="commercial"/>\n').otherwise(act)
    rows = plans.select("person_id", F.col("elem_seq").alias("key"), text.alias("text")).groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda s: s["text"]), "").alias("text"))
    return rows.select("person_id", F.concat(F.lit("\t<person"), _attr("id", F.col("person_id")), F.lit('>\n\t\t<plan selected="yes">\n'), F.col("text"), F.lit("\t\t</plan>\n\t</person>")).alias("text"))
