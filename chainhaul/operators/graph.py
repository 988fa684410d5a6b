"""Centrality on edges (o_id, d_id, weight)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eigenvector_steps(edges: DataFrame, steps: int) -> DataFrame:
    """(id, score) after a fixed number of power iterations with in-weights, scaled by the sum each time.

    A step is one join and one pre-aggregated sum; the plan is a chain of
    ``steps`` of them.  For many steps, use ``eigenvector``.
    """
    nodes = edges.select(F.explode(F.array("o_id", "d_id")).alias("id")).distinct()
    scores = nodes.withColumn("score", F.lit(1.0))
    for _ in range(steps):
        scores = _step(edges, nodes, scores)
    return scores


def _step(edges: DataFrame, nodes: DataFrame, scores: DataFrame) -> DataFrame:
    sent = edges.join(scores.withColumnRenamed("id", "s"), F.col("o_id") == F.col("s")).groupBy(F.col("d_id").alias("d")).agg(F.sum(F.col("weight") * F.col("score")).alias("got"))
    out = nodes.join(sent, F.col("id") == F.col("d"), "left").select("id", F.coalesce("got", F.lit(0.0)).alias("got"))
    total = out.agg(F.sum("got").alias("total"))
    return out.join(total).select("id", F.when(F.col("total") > 0, F.col("got") / F.col("total")).otherwise(0.0).alias("score"))


def eigenvector(edges: DataFrame, most: int = 1000, tolerance: float = 1e-5, every: int = 5) -> DataFrame:
    """Power iteration until the greatest change is within the tolerance; lineage is cut by checkpoints."""
    nodes = edges.select(F.explode(F.array("o_id", "d_id")).alias("id")).distinct().checkpoint()
    edges = edges.checkpoint()
    scores = nodes.withColumn("score", F.lit(1.0))
    for _ in range(0, most, every):
        before = scores
        for _ in range(every):
            before, scores = scores, _step(edges, nodes, scores)
        scores = scores.checkpoint()
        change = scores.join(before.withColumnRenamed("score", "old"), "id").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        if change is None or change <= tolerance:
            break
    return scores


def _joined(lists: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The values of lists[low:high] of each pair of bounds, in a row."""
    many = high - low
    n = int(many.sum())
    if n > 32 * len(low):
        return np.concatenate([lists[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    return lists[np.arange(n) + np.repeat(low - (np.cumsum(many) - many), many)]


def _sums(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sums of values in a row, as many as stated for each."""
    out, some = np.zeros(len(many)), many > 0
    if len(values):
        out[some] = np.add.reduceat(values, (np.cumsum(many) - many)[some])
    return out


#: Levels with fewer edges than this share of the nodes touch what they reach only.
SPARSE = 1 / 8


def brandes(to: np.ndarray, starts: np.ndarray, back: np.ndarray | None, ends: np.ndarray, source: int, total: np.ndarray, fresh: np.ndarray, mark: np.ndarray) -> None:
    """Add to ``total`` what shortest paths from one source give each node's betweenness.

    to, starts: the targets of node k are to[starts[k]:starts[k + 1]]; back,
    ends: likewise the nodes with an edge to k.  Levels are gone through whole,
    over the edges out of them or, where these are fewer, over those into the
    nodes not yet reached; without back, always the former.  fresh (all true,
    and again at the end) and mark have an entry a node.
    """
    size = len(fresh)
    at, paths = np.array([source]), np.ones(1)
    fresh[source] = False
    left, into = size - 1, ends[-1] - ends[0] - (ends[source + 1] - ends[source])
    levels = []
    while len(at) and left and into:
        low, high = starts[at], starts[at + 1]
        many = high - low
        n = int(many.sum())
        if n < SPARSE * size:
            place, node = np.repeat(np.arange(len(at)), many), _joined(to, low, high)
            new = fresh[node]
            place, node = place[new], node[new]
            nth = np.arange(len(node))
            mark[node] = nth
            found = node[mark[node] == nth].astype(np.int64)
            mark[found] = np.arange(len(found))
            how = (0, place, mark[node])
            got = np.bincount(how[2], weights=paths[place], minlength=len(found))
        elif back is None or n <= into + size:
            node = _joined(to, low, high).astype(np.int64)
            got = np.bincount(node, weights=np.repeat(paths, many), minlength=size)
            got[~fresh] = 0
            found = np.flatnonzero(got)
            how = (1, node, many, found)
            got = got[found]
        else:
            rest = np.flatnonzero(fresh)
            low, high = ends[rest], ends[rest + 1]
            node, full = _joined(back, low, high).astype(np.int64), np.zeros(size)
            full[at] = paths
            got = _sums(full[node], high - low)
            own = np.flatnonzero(got)
            found = rest[own]
            how = (2, node, high - low, own)
            got = got[own]
        if not len(found):
            break
        levels.append((at, paths, how))
        fresh[found] = False
        left, into = left - len(found), into - int((ends[found + 1] - ends[found]).sum())
        at, paths = found, got
    fresh[at] = True
    share = np.zeros(len(at))  # none beyond the last level
    for before, ways, (kind, node, *how) in reversed(levels):
        each = (1 + share) / paths
        if kind == 0:
            share = np.bincount(node, weights=each[how[0]], minlength=len(before))
        elif kind == 1:
            full = np.zeros(size)
            full[how[1]] = each
            share = _sums(full[node], how[0])
        else:
            full = np.zeros(len(how[0]))
            full[how[1]] = each
            share = np.bincount(node, weights=np.repeat(full, how[0]), minlength=size)[before]
        share, paths = share * ways, ways
        fresh[before] = True
        if len(before) > 1 or before[0] != source:
            total[before] += share


#: The edges that one worker holds; larger networks are refused, not cut.
MOST_EDGES = 200_000_000
#: Edges that the driver takes up together.
TOGETHER = 1 << 20


def _spans(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Nodes from and to, whose lists together hold about ``TOGETHER`` edges."""
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], TOGETHER)), len(starts) - 1))
    low = 0
    for high in cuts.tolist():
        if high > low:
            yield low, high
            low = high


def components(to: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least node of each node's weak component."""
    least = np.arange(len(starts) - 1)
    merged = True
    while merged:
        merged = False
        for low, high in _spans(starts):
            a = np.repeat(least[low:high], starts[low + 1 : high + 1] - starts[low:high])
            b = least[to[starts[low] : starts[high]]]
            apart = a != b
            if apart.any():
                merged = True
                a, b = a[apart], b[apart]
                np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
                while (least[least] != least).any():
                    least = least[least]
    return least


class Network:
    """Edges by component: nodes of one are in a row, and named by their place in it.

    order: the former number of each node; first, behind: the bounds of its
    component; to, starts, back, ends: as in ``brandes``.  back is left out
    where it would take a worker beyond four bytes an edge of ``MOST_EDGES``.
    """

    def __init__(self, to: np.ndarray, starts: np.ndarray):
        size = len(starts) - 1
        least = components(to, starts)
        self.order = np.argsort(least, kind="stable")
        _, first, many = np.unique(least[self.order], return_index=True, return_counts=True)
        self.first, self.behind = np.repeat(first, many), np.repeat(first + many, many)
        kind = np.uint16 if not size or many.max() <= 1 << 16 else np.int32
        place = np.empty(size, dtype=kind)
        place[self.order] = np.arange(size) - self.first
        counts = np.diff(starts)[self.order]
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.to = np.empty(len(to), dtype=kind)
        for low, high in _spans(self.starts):
            at = self.order[low:high]
            self.to[self.starts[low] : self.starts[high]] = place[_joined(to, starts[at], starts[at + 1])]
        into = np.zeros(size, dtype=np.int64)
        for low, high, aim in self._aims():
            into += np.bincount(aim, minlength=size)
        self.ends = np.concatenate([[0], np.cumsum(into)])
        self.back = None
        if 2 * self.to.nbytes <= 4 * MOST_EDGES:
            self.back, nxt = np.empty_like(self.to), self.ends[:-1].copy()
            for low, high, aim in self._aims():
                o = np.repeat(np.arange(low, high) - self.first[low:high], self.starts[low + 1 : high + 1] - self.starts[low:high]).astype(kind)
                order = np.argsort(aim, kind="stable")
                aim = aim[order]
                n = np.bincount(aim, minlength=size)
                self.back[nxt[aim] + np.arange(len(aim)) - (np.cumsum(n) - n)[aim]] = o[order]
                nxt += n

    def _aims(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for low, high in _spans(self.starts):
            yield low, high, np.repeat(self.first[low:high], self.starts[low + 1 : high + 1] - self.starts[low:high]) + self.to[self.starts[low] : self.starts[high]]

    def add(self, sources: np.ndarray, total: np.ndarray, fresh: np.ndarray, mark: np.ndarray) -> None:
        """What the sources give each node, by new numbers."""
        for source in np.sort(sources):
            a, b = self.first[source], self.behind[source]
            brandes(self.to, self.starts[a : b + 1], self.back, self.ends[a : b + 1], source - a, total[a:b], fresh[a:b], mark[a:b])


def betweenness(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, betweenness) over unweighted directed shortest paths.

    Nodes are numbered by component, so that an end of an edge is one number of
    two or four bytes, in the driver and, twice, in each task's network.
    Sources are dealt over tasks; the network's size is checked before it is
    gathered.
    """
    spark = edges.sparkSession
    pairs = edges.select("o_id", "d_id").distinct().persist(StorageLevel.DISK_ONLY)
    ids = pairs.select(F.explode(F.array("o_id", "d_id")).alias("id")).distinct().toArrow()["id"].to_pylist()
    names = spark.createDataFrame(pd.DataFrame({"id": ids, "nth": np.arange(len(ids), dtype=np.int32)}), "id string, nth int")
    o, d = names.select(F.col("id").alias("o_id"), F.col("nth").alias("o")), names.select(F.col("id").alias("d_id"), F.col("nth").alias("d"))
    n = pairs.count()
    if n > MOST_EDGES:
        pairs.unpersist()
        raise ValueError(f"{n} edges; betweenness holds at most {MOST_EDGES}")
    table = pairs.where("o_id <> d_id").join(o, "o_id").join(d, "d_id").groupBy("o").agg(F.array_sort(F.collect_list("d")).alias("to")).toArrow()
    pairs.unpersist()
    o, lists = table["o"].to_numpy(), table["to"].combine_chunks()
    del table
    order, length = np.argsort(o), lists.value_lengths().to_numpy().astype(np.int64)
    many = np.zeros(len(ids) + 1, dtype=np.int64)
    many[o + 1] = length
    behind = np.cumsum(length)
    to = _joined(lists.flatten().to_numpy(), (behind - length)[order], behind[order]) if len(o) else np.zeros(0, dtype=np.int32)
    del lists
    shared = spark.sparkContext.broadcast(Network(to, np.cumsum(many)))
    del to

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        size = len(net.order)
        total, fresh, mark = np.zeros(size), np.ones(size, dtype=bool), np.zeros(size, dtype=np.int64)
        for pdf in frames:
            net.add(pdf["id"].to_numpy(), total, fresh, mark)
        got = np.flatnonzero(total)
        yield pd.DataFrame({"nth": net.order[got], "part": total[got]})

    dealt = spark.range(len(ids)).repartition(partitions or spark.sparkContext.defaultParallelism, "id")
    sums = dealt.mapInPandas(run, "nth int, part double").groupBy("nth").agg(F.sum("part").alias("part"))
    return names.join(sums, "nth", "left").select("id", F.coalesce("part", F.lit(0.0)).alias("betweenness"))
