"""Concave hulls by eroding a triangulation's longest border edges (NumPy, one cluster at a time)."""

from __future__ import annotations

import heapq

import numpy as np


def _visits(q: np.ndarray) -> list[int]:
    """An order of insertion: rounds of twice as many points each, drawn by a fixed seed, along rows of a grid within a round."""
    n = len(q)
    level = np.floor(np.log2(np.random.default_rng(0).permutation(n) + 1)).astype(np.int64)
    rows = np.sqrt(2.0**level).astype(np.int64) + 1
    row = np.minimum((q[:, 1] * rows).astype(np.int64), rows - 1)
    return np.lexsort((np.where(row % 2, -q[:, 0], q[:, 0]), row, level)).tolist()


def triangulate(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles by inserting points one after another; none for points on a line.

    A point is found by walking over triangles, and those whose circle holds it
    lie side by side around it, so that a point costs about the same however
    many there are.  Of points on one circle, the last one in the order given is
    joined with all others, whatever the order of insertion.
    """
    n = len(p)
    low, span = p.min(axis=0), max(float((p.max(axis=0) - p.min(axis=0)).max()), 1e-9)
    q = (p - low) / span
    xs, ys = [*q[:, 0].tolist(), -40.0, 42.0, 0.5], [*q[:, 1].tolist(), -40.0, -40.0, 60.0]
    # by triangle: its corners, anticlockwise; the triangle across from each corner (-1: none); its circle
    corners: list[tuple[int, int, int] | None] = []
    beside: list[list[int]] = []
    circles: list[tuple[float, float, float]] = []

    def turn(a: int, b: int, x: float, y: float) -> float:
        return (xs[b] - xs[a]) * (y - ys[a]) - (ys[b] - ys[a]) * (x - xs[a])

    def add(a: int, b: int, c: int) -> int:
        ax, ay, bx, by, cx, cy = xs[a], ys[a], xs[b], ys[b], xs[c], ys[c]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-14:
            circle = (0.0, 0.0, np.inf)
        else:
            aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
            ux, uy = (aa * (by - cy) + bb * (cy - ay) + cc * (ay - by)) / d, (aa * (cx - bx) + bb * (ax - cx) + cc * (bx - ax)) / d
            circle = (ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2)
        corners.append((a, b, c))
        beside.append([-1, -1, -1])
        circles.append(circle)
        return len(corners) - 1

    def holds(t: int, k: int, x: float, y: float) -> bool:
        """Whether the circle of t holds k; on the circle, whether k is joined with all, or lies across from the corner that is."""
        ux, uy, r = circles[t]
        d = (x - ux) ** 2 + (y - uy) ** 2
        if abs(d - r) > r * 1e-12 or r == np.inf:
            return d <= r
        m = max(corners[t])
        if k > m:
            return True
        at = corners[t].index(m)
        return turn(corners[t][at - 2], corners[t][at - 1], x, y) < 0

    at = add(n, n + 1, n + 2)
    for k in _visits(q):
        x, y = xs[k], ys[k]
        for _ in range(len(corners)):
            a, b, c = corners[at]
            step = 0 if turn(b, c, x, y) < 0 else 1 if turn(c, a, x, y) < 0 else 2 if turn(a, b, x, y) < 0 else -1
            if step < 0 or beside[at][step] < 0:
                break
            at = beside[at][step]
        bad, todo, rim = {at}, [at], []
        while todo:
            t = todo.pop()
            for side, u in enumerate(beside[t]):
                if u in bad:
                    continue
                a, b = corners[t][side - 2], corners[t][side - 1]
                # an edge that the point does not see, by rounding, goes too
                if u >= 0 and (holds(u, k, x, y) or turn(a, b, x, y) <= 0):
                    bad.add(u)
                    todo.append(u)
                else:
                    rim.append((a, b, u))
        # what was on the rim of one may have gone with another
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        for a, b, u in rim:
            if u in bad:
                continue
            at = add(a, b, k)
            beside[at][2] = u
            if u >= 0:
                beside[u][next(j for j in range(3) if corners[u][j] not in (a, b))] = at
            first[a], last[b] = at, at
        for a, t in first.items():
            beside[t][1] = last.get(a, -1)
            beside[t][0] = first.get(corners[t][1], -1)
        for t in bad:
            corners[t] = None
    return [tuple(sorted(t)) for t in corners if t is not None and max(t) < n]


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Corners in order, the first again at the end."""
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out: list = []
        for c in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return np.array([*ring, ring[0]])


def concave_hull(points: np.ndarray, threshold: float = 10.0) -> np.ndarray:
    """Ring of the hull; one point or two for as few distinct points.

    The longest border edge of at least the threshold (later ones longer than
    it) loses its triangle, unless that is its only neighbour's last link or
    all its corners are on the border; equal lengths go by edge.  Without a
    triangulation three points give a triangle and more their mean; a border
    that is no ring gives the convex hull.
    """
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    triangles = triangulate(p)
    if not triangles:
        return np.vstack([p, p[:1]]) if len(p) == 3 else p.mean(axis=0, keepdims=True)
    by_edge: dict[tuple[int, int], set[int]] = {}
    edges_of = []
    for k, (a, b, c) in enumerate(triangles):
        edges_of.append([(a, b), (b, c), (a, c)])
        for e in edges_of[-1]:
            by_edge.setdefault(e, set()).add(k)
    length = lambda e: float(np.hypot(*(p[e[0]] - p[e[1]])))
    border = {e for e, ts in by_edge.items() if len(ts) == 1}
    on = {v for e in border for v in e}
    heap = [(-length(e), e) for e in border if length(e) >= threshold]
    heapq.heapify(heap)
    while heap:
        _, e = heapq.heappop(heap)
        if e not in border:
            continue
        (t,) = by_edge[e]
        neighbours = sum(len(by_edge[f]) == 2 for f in edges_of[t])
        apex = next(v for v in triangles[t] if v not in e)
        if neighbours <= 1 or apex in on:
            continue
        border.discard(e)
        by_edge[e].clear()
        for f in edges_of[t]:
            if f != e:
                by_edge[f].discard(t)
                border.add(f)
                if length(f) > threshold:
                    heapq.heappush(heap, (-length(f), f))
        on.add(apex)
    ring = _ring(border)
    return p[ring] if ring else convex_hull(p)


def _ring(border: set[tuple[int, int]]) -> list[int]:
    """Vertices around, first again at the end; nothing if the edges make no single ring."""
    beside: dict[int, list[int]] = {}
    for a, b in border:
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    if not beside or any(len(v) != 2 for v in beside.values()):
        return []
    start = min(beside)
    ring, before, at = [start], start, min(beside[start])
    while at != start:
        ring.append(at)
        a, b = beside[at]
        before, at = at, b if a == before else a
    return [*ring, start] if len(ring) == len(beside) else []


def centroid(ring: np.ndarray) -> tuple[float, float]:
    if len(ring) < 3:
        return tuple(ring.mean(axis=0).tolist()) if len(ring) else (float("nan"), float("nan"))
    x, y = ring[:, 0], ring[:, 1]
    cross = x[:-1] * y[1:] - x[1:] * y[:-1]
    a = cross.sum() / 2
    if a == 0:
        return tuple(ring[:-1].mean(axis=0).tolist())
    return float(((x[:-1] + x[1:]) * cross).sum() / (6 * a)), float(((y[:-1] + y[1:]) * cross).sum() / (6 * a))
