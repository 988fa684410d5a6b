"""Synthetic chains by walks over the second-order network, and plans from them."""

from __future__ import annotations

import pickle
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pathnet import SINK, SOURCE, UNKNOWN

#: The network that one worker holds, at some ten bytes an edge; larger ones are refused, not cut.
MOST_EDGES = 50_000_000
#: Rows that one task packs.
PACK_ROWS = 500_000
MOST_ATTEMPTS = 10
SCHEMA = "person_id string, elem_seq int, kind string, type string, facility_id string, x double, y double, end_time double, max_dur double"
#: Numbers of the pseudo ids; nodes are numbered from 0 in the order of their ids.
NUMBERS = {SOURCE: -1, UNKNOWN: -2, SINK: -3}


def choose(keys: Sequence, weights: np.ndarray, u: float):
    """First of the keys, in the order given, whose running share reaches u; None without weight."""
    some = np.flatnonzero(weights > 0)
    if not len(some):
        return None
    run = np.cumsum(weights[some], dtype=float)
    return keys[some[min(int(np.searchsorted(run, u * run[-1])), len(some) - 1)]]


def _small(values: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes, if they are whole."""
    if len(values) and (values < 0).any():
        return values
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.uint8
    small = values.astype(kind)
    return small if (small == values).all() else values


def pack_contexts(node: np.ndarray, prev: np.ndarray, nxt: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Edges of some nodes as arrays: by node the range of its contexts, by context its preceding node, weight to the sink and range of next nodes."""
    order = np.lexsort((nxt, prev, node))
    node, prev, nxt, weight = node[order], prev[order], nxt[order], weight[order]
    first = np.ones(len(node), dtype=bool)
    first[1:] = (node[1:] != node[:-1]) | (prev[1:] != prev[:-1])
    at = np.flatnonzero(first)
    real = nxt >= 0
    nodes, starts = np.unique(node[at], return_index=True)
    add = lambda which: np.add.reduceat(np.where(which, weight, 0.0), at) if len(at) else np.zeros(0)
    source = add((prev == NUMBERS[SOURCE]) & (nxt != NUMBERS[UNKNOWN]))
    sink = add(nxt == NUMBERS[SINK])
    total = lambda v: np.add.reduceat(v, starts) if len(starts) else np.zeros(0)
    places = np.concatenate([[0], np.cumsum(real)]).astype(np.int32)
    return {"nodes": nodes, "contexts": np.append(starts, len(at)).astype(np.int32), "prev": prev[at], "sink": _small(sink), "edges": np.append(places[at], places[-1]), "next": nxt[real], "weight": _small(weight[real]), "node_source": total(source), "node_sink": total(sink)}


def pack_starts(node: np.ndarray, hour: np.ndarray, activities: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    order = np.argsort(node, kind="stable")
    nodes, starts = np.unique(node[order], return_index=True)
    return {"nodes": nodes, "starts": np.append(starts, len(node)).astype(np.int32), "hour": _small(hour[order]), "activities": _small(activities[order]), "count": _small(count[order])}


def _packed(rows: DataFrame, pack: Callable[..., dict[str, np.ndarray]], parts: int) -> list[dict[str, np.ndarray]]:
    """What ``pack`` makes of the rows (node, ...) of each task; they come to the driver one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(pack(*map(np.concatenate, zip(*found, strict=True))), protocol=5)], pa.binary())], names=["pack"])

    return [pickle.loads(bytes(r.pack)) for r in rows.repartition(parts, "node").mapInArrow(run, "pack binary").toLocalIterator()]


class Network:
    """Contexts' weights and what walks need of them; nodes are numbers."""

    def __init__(self, packs: list[dict[str, np.ndarray]], starts: list[dict[str, np.ndarray]], size: int):
        self.packs, self.starts = packs, starts
        self.place = self._places(packs, size)
        self.start_place = self._places(starts, size)
        self.sink, self.source = np.zeros(size), np.zeros(size)
        for p in packs:
            self.sink[p["nodes"]], self.source[p["nodes"]] = p.pop("node_sink"), p.pop("node_source")

    @staticmethod
    def _places(packs: list[dict[str, np.ndarray]], size: int) -> np.ndarray:
        """By node: its pack, and its place there; -1 where it has none."""
        out = np.full((size, 2), -1, dtype=np.int32)
        for k, p in enumerate(packs):
            out[p["nodes"], 0], out[p["nodes"], 1] = k, np.arange(len(p["nodes"]))
        return out

    def _context(self, prev: int, node: int) -> tuple[dict[str, np.ndarray], int] | None:
        k, at = self.place[node]
        if k < 0:
            return None
        pack = self.packs[k]
        low, high = pack["contexts"][at : at + 2]
        found = low + int(np.searchsorted(pack["prev"][low:high], prev))
        return (pack, found) if found < high and pack["prev"][found] == prev else None

    def _next(self, prev: int, node: int) -> tuple[np.ndarray, np.ndarray]:
        context = self._context(prev, node)
        if context is None:
            return np.zeros(0, dtype=np.int32), np.zeros(0)
        pack, at = context
        low, high = pack["edges"][at : at + 2]
        return pack["next"][low:high], pack["weight"][low:high]

    def after(self, node: int) -> np.ndarray:
        """All that may come next, in order."""
        k, at = self.place[node]
        if k < 0:
            return np.zeros(0, dtype=np.int32)
        pack = self.packs[k]
        low, high = pack["edges"][pack["contexts"][at : at + 2]]
        return np.unique(pack["next"][low:high])

    def _ends(self, prev: int, node: int) -> float:
        context = self._context(prev, node)
        return float(context[0]["sink"][context[1]]) if context else 0.0

    def first(self, u: float) -> int | None:
        return choose(range(len(self.source)), self.source, u)

    def start(self, node: int, u: float) -> tuple[int, int]:
        """Hour and activities, in the order of their text; 8 and 0 where nothing is known."""
        k, at = self.start_place[node]
        if k < 0:
            return 8, 0
        pack = self.starts[k]
        low, high = pack["starts"][at : at + 2]
        keys = sorted((f"{h},{a}", c) for h, a, c in zip(pack["hour"][low:high], pack["activities"][low:high], pack["count"][low:high], strict=True))
        return tuple(map(int, (choose([k for k, _ in keys], np.array([c for _, c in keys]), u) or "8,0").split(",")))

    def step(self, prev: int, node: int, u: float) -> int | None:
        own = choose(*self._next(prev, node), u)
        if own is None:
            after = self.after(node)
            own = choose(after, self.sink[after], u)
        return own

    def last(self, prev: int, node: int, u: float) -> int | None:
        cand = self._next(prev, node)[0]
        own = choose(cand, np.array([self._ends(node, x) for x in cand]), u)
        return choose(cand, self.sink[cand], u) if own is None else own


def walk(net: Network, rng: random.Random, restarts: int = 100) -> tuple[list[int], int] | None:
    """Nodes of a chain and its start hour; on a dead end up to a quarter of the way goes back."""
    for _ in range(restarts):
        first = net.first(rng.random())
        if first is None:
            return None
        hour, wanted = net.start(first, rng.random())
        way, attempts = [first], 0
        while attempts <= MOST_ATTEMPTS and way:
            pair = (way[-2] if len(way) > 1 else NUMBERS[SOURCE], way[-1])
            done = len(way) == wanted + 1
            to = net.last(*pair, rng.random()) if done else net.step(*pair, rng.random())
            if to is None:
                attempts += 1
                del way[-max(1, rng.randrange(max(1, round(len(way) / 4)))) :]
                continue
            way.append(to)
            if done:
                return way, hour
    return None


def duration(u: float, deciles: list[float]) -> float:
    if not 0 <= u <= 1:
        raise ValueError("a share lies between 0 and 1")
    k = min(int(u * 10), 9)
    return deciles[k] + (u * 10 - k) * (deciles[k + 1] - deciles[k])


def plans(edges: DataFrame, starts: DataFrame, nodes: DataFrame, n: int, prefix: str, deciles: list[float], seed: int = 0) -> DataFrame:
    """n persons' plans; each walk has a seed of its own, so the deal over tasks changes nothing.

    Tasks pack the network into arrays of node numbers, which the driver only passes on.
    """
    spark = edges.sparkSession
    edges = edges.select("prev_id", "node_id", "next_id", "weight").persist(StorageLevel.DISK_ONLY)
    count = edges.count()
    if count > MOST_EDGES:
        edges.unpersist()
        raise ValueError(f"{count} edges; a worker holds at most {MOST_EDGES}")
    known = edges.select(F.explode(F.array("prev_id", "node_id", "next_id")).alias("id")).distinct().toArrow()["id"].to_pylist()
    names = sorted(set(known) - set(NUMBERS))
    numbers = spark.createDataFrame(pd.DataFrame({"id": names + list(NUMBERS), "nth": np.array([*range(len(names)), *NUMBERS.values()], dtype=np.int32)}), "id string, nth int")
    number = lambda c: numbers.select(F.col("id").alias(f"{c}_id"), F.col("nth").alias(c))
    parts = max(count // PACK_ROWS + 1, spark.sparkContext.defaultParallelism)
    rows = edges
    for c in ("node", "prev", "next"):
        rows = rows.join(number(c), f"{c}_id")
    packs = _packed(rows.select("node", "prev", "next", F.col("weight").cast("double").alias("weight")), pack_contexts, parts)
    edges.unpersist()
    begun = starts.join(number("node"), "node_id").select("node", "hour", "activities", "count")
    net = Network(packs, _packed(begun, pack_starts, parts), len(names))
    places = {r.id: (r.x, r.y) for r in nodes.collect()}  # nodes of checked edges
    shared = spark.sparkContext.broadcast((net, names, places))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network, ids, at = shared.value
        for pdf in frames:
            rows = []
            for i in pdf["id"]:
                rng = random.Random(f"{seed}-{i}")
                found = walk(network, rng)
                if found is None:
                    continue
                way, hour = found
                for k, node in enumerate(ids[w] for w in way):
                    x, y = at.get(node, (None, None))
                    kind = "major" if k in (0, len(way) - 1) else "minor"
                    end = float(round((hour + rng.random()) * 3600)) if k == 0 else None
                    stay = duration(rng.random(), deciles) if kind == "minor" else None
                    if k:
                        rows.append((f"{prefix}_{i}", 2 * k - 1, "leg", "commercial", None, None, None, None, None))
                    rows.append((f"{prefix}_{i}", 2 * k, "activity", kind, node, x, y, end, stay))
            yield pd.DataFrame(rows, columns=["person_id", "elem_seq", "kind", "type", "facility_id", "x", "y", "end_time", "max_dur"])

    return spark.range(n).mapInPandas(run, SCHEMA)
