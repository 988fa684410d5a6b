import pytest
from pyspark.sql import functions as F

from chainhaul.operators import assign, clean, generate, graph, network, pathnet, sample, similarity

ACTS = "vehicle_id string, chain_seq int, act_seq int, type string, start_ts long, end_ts long, x double, y double, facility_id string"


def acts(spark, chains, places=None):
    rows = []
    for c, chain in enumerate(chains, 1):
        for k, f in enumerate(chain):
            kind = "major" if k in (0, len(chain) - 1) else "minor"
            x, y = (places or {}).get(f, (float(k), float(c)))
            rows.append(("v", c, k, kind, 1000 * k, 1000 * k + 500, x, y, None if f == "?" else f))
    return spark.createDataFrame(rows, ACTS)


GOLDEN = ["ACD", "ACE", "BCD", "A?BC?", "AB?"]


@pytest.fixture(scope="module")
def golden(spark):
    a = acts(spark, GOLDEN)
    pd = pathnet.edges(a).cache()
    return a, pd


def test_second_order_golden(golden):
    a, pd = golden
    assert {(r.node_id, r.next_id): r.weight for r in pathnet.collapsed(pd).collect()} == {("A", "B"): 1, ("A", "C"): 2, ("B", "C"): 2, ("C", "D"): 2, ("C", "E"): 1}
    deg = {r.id: (r.in_degree, r.out_degree) for r in pathnet.degrees(pd, pathnet.contexts(a), pathnet.nodes(a)).collect()}
    assert deg == {"A": (0, 2), "B": (1, 1), "C": (2, 2), "D": (1, 0), "E": (1, 0)}
    assert {r.node_id: r.source_weight for r in pathnet.end_weights(pd).collect() if r.source_weight} == {"A": 3, "B": 1}
    assert {r.prev_id for r in pathnet.contexts(a).where("node_id = 'B'").collect()} == {"source", "A", "unknown"}
    assert "unknown" not in {r.id for r in pathnet.nodes(a).collect()}


def test_sink_needs_a_node(spark):
    # X ends a chain after an unknown place and nothing made it a node before: no edge
    a = acts(spark, ["A?X", "AXB", "A?X"])
    got = {(r.prev_id, r.node_id, r.next_id): r.weight for r in pathnet.edges(a).collect()}
    assert got["unknown", "X", "sink"] == 1


def test_second_order_sampling(spark, golden):
    _, pd = golden
    draws = spark.createDataFrame([(1, "A", "C", 0.25), (2, "A", "C", 0.75), (3, "B", "C", 0.4), (4, "C", "D", 0.5), (5, "C", "E", 0.5)], "id long, prev_id string, node_id string, u double")
    assert {r.id: r.next_id for r in sample.next_nodes(pd, draws).collect()} == {1: "D", 2: "E", 3: "D", 4: None, 5: None}
    starts = spark.createDataFrame([(k, u) for k, u in enumerate((0.25, 0.5, 0.65, 0.74, 0.76, 0.9))], "id long, u double")
    assert [r.node_id for r in sample.start_nodes(pd, starts).orderBy("id").collect()] == ["A"] * 4 + ["B"] * 2


def test_intervals_take_rows_by_their_keys(spark):
    # groups of one to three keys, as contexts are: no row for each of a thousand cells
    rows = [(f"g{g}", f"k{k}", float(k + 1)) for g in range(20) for k in range(g % 3 + 1)]
    w = spark.createDataFrame(rows, "g string, k string, weight double")
    assert sample.intervals(w, ["g"], "k").count() < 2 * len(rows)
    draws = spark.createDataFrame([(20 * n + g, f"g{g}", n / 20) for n in range(21) for g in range(20)], "id long, g string, u double")
    got = {r.id: r.k for r in sample.pick(w, draws, ["g"], "k").collect()}
    upto = lambda g, k: sum(range(1, k + 2)) / sum(range(1, g % 3 + 2))
    assert got == {20 * n + g: f"k{next(k for k in range(3) if upto(g, k) >= n / 20)}" for n in range(21) for g in range(20)}


def test_generate_is_reproducible(spark, golden):
    a, pd = golden
    run = lambda: sorted(map(tuple, generate.plans(pd, pathnet.starts(a), pathnet.nodes(a), 20, "p", list(range(0, 1100, 100)), 3).collect()), key=str)
    first = run()
    assert first and first == run()
    with pytest.raises(ValueError):
        generate.duration(1.5, list(range(11)))


def test_generate_packs_the_network(spark, golden):
    import pickle
    import random

    a, pd = golden
    # some ten bytes an edge, so that the driver holds what tables of 60 times sf0.1 give
    assert generate.MOST_EDGES >= 23_000_000
    rng = random.Random(1)
    rows = sorted({(rng.randrange(-1, 300), rng.randrange(300), rng.choice((-3, -2, *range(300)))) for _ in range(40_000)})
    import numpy as np

    prev, node, nxt = np.array(rows, dtype=np.int32).T
    weight = np.array([rng.randrange(1, 4) for _ in rows], dtype=float)
    net = generate.Network([generate.pack_contexts(node[part], prev[part], nxt[part], weight[part]) for part in (node % 2 == 0, node % 2 == 1)], [], 300)
    assert len(pickle.dumps(net.packs, 5)) < 20 * len(rows)
    weights = {}
    for (p, n, x), w in zip(rows, weight.tolist(), strict=True):
        weights.setdefault((p, n), {})[x] = w

    def first(own, u):
        keys, run = sorted(k for k in own if own[k] > 0), 0.0
        for k in keys:
            run += own[k]
            if run >= u * sum(own.values()):
                return k
        return None

    sink = lambda n: sum(to.get(-3, 0.0) for (_, m), to in weights.items() if m == n)
    for _ in range(200):
        p, n, u = rng.randrange(-1, 300), rng.randrange(300), rng.random()
        real = {x: w for x, w in weights.get((p, n), {}).items() if x >= 0}
        if real:
            assert net.step(p, n, u) == first(real, u)
            ends = {x: weights.get((n, x), {}).get(-3, 0.0) for x in real}
            want = first(ends, u) if any(ends.values()) else first({x: sink(x) for x in real}, u)
            assert net.last(p, n, u) == want
        else:
            assert net.last(p, n, u) is None
    assert net.source.tolist() == [sum(w for x, w in weights.get((-1, n), {}).items() if x != -2) for n in range(300)]


def test_multiplex_golden(spark):
    a = acts(spark, ["12", "13", "13", "31", "41", "41", "41"]).withColumn("type", F.lit("test"))
    mx = network.arcs(a)
    r = network.stats(mx).first()
    assert (r.vertices, r.edges, r.min_weight, r.max_weight) == (4, 4, 1, 3) and r.density == pytest.approx(4 / 12)
    order = {x.id: (x.in_order, x.out_order) for x in network.node_order(mx).collect()}
    assert order == {"1": (4, 3), "2": (1, 0), "3": (2, 1), "4": (0, 3)}
    assert {x.kind for x in network.degree_distribution(network.degrees(mx)).collect()} == {"in", "out", "total"}
    empty = network.stats(mx.limit(0)).first()
    assert (empty.vertices, empty.edges, empty.density, empty.max_weight) == (0, 0, 0.0, 0)
    assert network.artificial_edges(mx).count() >= 1


def test_chain_filter(spark):
    a = acts(spark, [["?", "1", "?", "4"]])
    kept = lambda ids: assign.chains_with_facility(a, ids).count() > 0
    assert kept(None) and not kept([]) and not kept(["3"]) and kept(["4"]) and kept(["1", "2"]) and not kept(["2", "3"])


def test_clean(spark):
    a = acts(spark, ["AABB", "BBB", "BC"])
    out = clean.clean(a).orderBy("chain_seq", "act_seq").collect()
    assert [(r.chain_seq, r.facility_id, r.merged) for r in out] == [(1, "A", 2), (1, "B", 2), (3, "B", 1), (3, "C", 1)]
    # the last of chain 1 and the first of chain 3 share the earlier start and, by default, the earlier end
    assert out[1].start_ts == out[2].start_ts == 0 and out[1].end_ts == out[2].end_ts == 500
    late = clean.clean(a, "max").orderBy("chain_seq", "act_seq").collect()
    assert late[2].end_ts == 3500


def test_position_dissimilarity(spark):
    place = {"f1": (0.0, 0.0), "f2": (4.0, 0.0), "f3": (6.0, 0.0)}
    rows = [("v", 1, 0, "f1", 0.0), ("v", 1, 1, None, 2.0), ("v", 1, 2, "f2", 4.0), ("v", 1, 3, "f3", 6.0), ("v", 2, 0, "f1", 0.0), ("v", 2, 1, "f2", 4.0), ("v", 2, 2, "f3", 6.0), ("v", 2, 3, None, 8.0)]
    a = spark.createDataFrame([(v, c, k, "minor", 0, 0, x, 0.0, f) for v, c, k, f, x in rows], ACTS)
    assert place
    for penalty, want in ((10, 22), (100, 202)):
        assert similarity.position_dissimilarity(a, penalty).first().dissimilarity == want


def test_snap(spark):
    from chainhaul.functions import geo

    ring = lambda *p: [(float(a), float(b)) for a, b in p]
    hulls = [("f1", 0.5, 5.5, ring((0, 6), (1, 6), (1, 5), (0, 5), (0, 6))), ("f2", 4.0, 2.3, ring((3, 3), (5, 3), (4, 1), (3, 3))), ("f3", 5.0, 6.0, ring((5, 6)))]
    f = spark.createDataFrame(hulls, f"facility_id string, fx double, fy double, hull {geo.RING}")
    pts = [(0, 6), (0, 2), (4, 2), (2, 4), (5, 6)]
    a = spark.createDataFrame([("v", 1, k, "minor", 0, 0, float(x), float(y), None) for k, (x, y) in enumerate(pts)], ACTS)
    got = {r.act_seq: r.facility_id for r in assign.snap(a, f, 1000.0).collect()}
    assert got == {0: "f1", 1: None, 2: "f2", 3: None, 4: "f3"}


def test_snap_small_hulls_wide_reach(spark, monkeypatch):
    # small hulls, a wide reach; the second time a cell's hulls are more than one list
    from chainhaul.functions import geo

    square = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]
    hulls = [(f"h{k:02d}{j:02d}", 10.0 * k, 10.0 * j, square(10.0 * k, 10.0 * j, 6.0)) for k in range(30) for j in range(30)] + [("wide", 150.0, 150.0, square(150.0, 150.0, 400.0)), ("same", 10.0, 10.0, square(10.0, 10.0, 6.0))]
    f = spark.createDataFrame(hulls, f"facility_id string, fx double, fy double, hull {geo.RING}")
    at = [(5.0 * k, 7.0 * j) for k in range(-4, 64) for j in range(-4, 45)] + [(10.0, 10.0), (500.0, 150.0)]
    a = spark.createDataFrame([("v", 1, k, "minor", 0, 0, x, y, None) for k, (x, y) in enumerate(at)], ACTS)

    def nearest(x, y):
        found = [((x - fx) ** 2 + (y - fy) ** 2, i) for i, fx, fy, ring in hulls if (x - fx) ** 2 + (y - fy) ** 2 <= 300.0**2 and ring[0][0] <= x <= ring[1][0] and ring[0][1] <= y <= ring[2][1]]
        return min(found)[1] if found else None

    want = {k: nearest(x, y) for k, (x, y) in enumerate(at)}
    for most in (256, 2):
        monkeypatch.setattr(assign, "CELL_HULLS", most)
        assert {r.act_seq: r.facility_id for r in assign.snap(a, f, 300.0).collect()} == want


def test_betweenness_and_eigenvector(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1), ("b", "d", 1)], "o_id string, d_id string, weight long")
    got = {r.id: r.betweenness for r in graph.betweenness(e, 2).collect()}
    # a>c, a>d, c>b, d>b, d>c, b>a, c>a by the paths through others
    assert got == {"a": 3.0, "b": 3.0, "c": 0.0, "d": 3.0} or sum(got.values()) == 9.0
    s = {r.id: r.score for r in graph.eigenvector(e).collect()}
    assert sum(s.values()) == pytest.approx(1) and s["d"] > s["c"]


def test_betweenness_holds_large_networks(spark):
    # a table of 60 times sf0.1 has some 16 million edges; two components, a loop and a node that only has a loop
    import random

    assert graph.MOST_EDGES >= 16_000_000
    rng = random.Random(5)
    pairs = {(f"{c}{rng.randrange(20)}", f"{c}{rng.randrange(20)}") for c in "ab" for _ in range(60)} | {("c", "c")}
    got = {r.id: r.betweenness for r in graph.betweenness(spark.createDataFrame([(*p, 1) for p in sorted(pairs)], "o_id string, d_id string, weight long"), 3).collect()}
    nodes = sorted({x for p in pairs for x in p})
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        depth, ways, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in sorted(b for a, b in pairs if a == v):
                if w not in depth:
                    depth[w], ways[w] = depth[v] + 1, 0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    ways[w] += ways[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in order:
                if (v, w) in pairs and depth[w] == depth[v] + 1:
                    share[v] += ways[v] / ways[w] * (1 + share[w])
            want[w] += share[w] if w != s else 0
    assert got == pytest.approx(want)
    assert graph.betweenness(spark.createDataFrame([], "o_id string, d_id string, weight long")).count() == 0


def test_betweenness_query_takes_all_edges(spark, tmp_path):
    import random

    from chainhaul.operators import network
    from chainhaul.plans import queries

    rng = random.Random(3)
    stops = [8, 9, 10, 99, 100, 102, 1000, 1002, 12345]
    lines = [(o, k, "2020-01-01", 1, rng.choice(stops), 1.0, "N", 1) for o in range(12) for k in range(3)]
    spark.createDataFrame([(o, o) for o in range(12)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate string, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string, l_quantity int").selectExpr("*", "to_date(l_shipdate) d").drop("l_shipdate").withColumnRenamed("d", "l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = network.edges(queries.mx(spark, str(tmp_path))).collect()
    assert any(e.weight == 1 for e in edges) and any(len(e.o_id) > 3 for e in edges)
    nodes = sorted({x for e in edges for x in (e.o_id, e.d_id)})
    to = {v: {e.d_id for e in edges if e.o_id == v} - {v} for v in nodes}
    far, ways = {}, {}
    for s in nodes:
        far[s, s], ways[s, s], at, depth = 0, 1, [s], 0
        while at:
            depth += 1
            new = {w for v in at for w in to[v] if (s, w) not in far}
            for w in new:
                ways[s, w] = sum(ways[s, v] for v in at if w in to[v])
            far |= dict.fromkeys(((s, w) for w in new), depth)
            at = sorted(new)
    want = {v: sum(ways[s, v] * ways[v, t] / ways[s, t] for s, t in far if v not in (s, t) and far.get((s, v), 99) + far.get((v, t), 99) == far[s, t]) for v in nodes}
    got = {r.id: r.betweenness for r in queries.betweenness_small(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6) and max(want.values()) > 0


def test_betweenness_leaves_most_edges_alone(monkeypatch):
    # two random components of which most nodes are two steps away: a source used to go over all edges of its own
    import numpy as np

    rng = np.random.default_rng(2)
    n, m = 3000, 360_000
    o = rng.integers(0, 2 * n, 2 * m)
    e = np.unique(o * 2 * n + (o + 2 * rng.integers(0, n, 2 * m)) % (2 * n))  # even and odd nodes stay apart
    o, d = e // (2 * n), e % (2 * n)
    o, d = o[o != d], d[o != d].astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(np.bincount(o, minlength=2 * n))])
    monkeypatch.setattr(graph, "TOGETHER", 50_000)
    net = graph.Network(d, starts)
    assert (net.order[:n] % 2 == 0).all() and (net.order[n:] % 2 == 1).all() and net.to.dtype == np.uint16
    seen, joined = [], graph._joined
    monkeypatch.setattr(graph, "_joined", lambda *a: (seen.append(len(got := joined(*a))), got)[1])

    def run(back):
        net.back = back
        total, fresh, mark = np.zeros(2 * n), np.ones(2 * n, dtype=bool), np.zeros(2 * n, dtype=np.int64)
        seen.clear()
        net.add(np.array([7, 4000]), total, fresh, mark)
        assert fresh.all()
        return total, sum(seen)

    got, few = run(net.back)
    want, all_edges = run(None)
    assert got == pytest.approx(want) and want.max() > 1
    assert all_edges > 0.9 * len(d) and few < 0.2 * len(d)
