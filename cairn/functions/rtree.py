"""Bulk-loaded (sort-tile-recursive) R-trees, over points in space and over boxes in the plane, probed for many queries at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 16


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the unit sphere; no seam at the antimeridian and none at the poles."""
    a, o = np.radians(lat), np.radians(lon)
    c = np.cos(a)
    return np.column_stack((c * np.cos(o), c * np.sin(o), np.sin(a)))


class PointTree:
    """Levels of boxes, leaves first. Built by tiling: sort on one axis, cut into slabs, sort the slabs on the next."""

    def __init__(self, xyz: np.ndarray):
        n = len(xyz)
        slabs = max(1, int(np.ceil(np.cbrt(n / FANOUT))))
        order = np.argsort(xyz[:, 0], kind="stable")
        slab = np.minimum(np.arange(n) * slabs // max(n, 1), slabs - 1)
        order = order[np.lexsort((xyz[order, 1], slab))]
        tile = np.minimum(np.arange(n) * slabs * slabs // max(n, 1), slabs * slabs - 1)
        self.order = order[np.lexsort((xyz[order, 2], tile))]
        self.xyz = xyz[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        low = high = self.xyz
        while len(low) > 1 or not self.levels:
            cuts = np.arange(0, max(len(low), 1), FANOUT)
            if not len(low):
                break
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((low, high))

    def balls(self, centres: np.ndarray, radius: float, chunk: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of the centre, index of the point) of all points whose box distance allows `radius`; the caller refines."""
        if not self.levels:
            return
        sizes = [len(self.xyz), *(len(low) for low, _ in self.levels)]
        for at in range(0, len(centres), chunk):
            c = centres[at : at + chunk]
            q, node = np.arange(len(c)), np.zeros(len(c), dtype=np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                low, high = self.levels[depth]
                gap = np.maximum(np.maximum(low[node] - c[q], c[q] - high[node]), 0.0)
                near = np.einsum("ij,ij->i", gap, gap) <= radius * radius
                q, node = q[near], node[near]
                child = node[:, None] * FANOUT + np.arange(FANOUT)
                ok = child < sizes[depth]
                q, node = np.repeat(q, FANOUT).reshape(-1, FANOUT)[ok], child[ok]
            d = self.xyz[node] - c[q]
            near = np.einsum("ij,ij->i", d, d) <= radius * radius
            yield q[near] + at, self.order[node[near]]


class BoxTree:
    """Boxes (x0, y0, x1, y1) of the plane, tiled by their centres."""

    def __init__(self, boxes: np.ndarray):
        n = len(boxes)
        slabs = max(1, int(np.ceil(np.sqrt(n / FANOUT))))
        order = np.argsort(boxes[:, 0] + boxes[:, 2], kind="stable")
        slab = np.minimum(np.arange(n) * slabs // max(n, 1), slabs - 1)
        self.order = order[np.lexsort(((boxes[:, 1] + boxes[:, 3])[order], slab))]
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > 1:
            b = self.levels[-1]
            cuts = np.arange(0, len(b), FANOUT)
            self.levels.append(np.column_stack((np.minimum.reduceat(b[:, :2], cuts), np.maximum.reduceat(b[:, 2:], cuts))))

    def holding(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, index of the box) of all boxes that hold a point, edges included."""
        if not len(self.order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            b = self.levels[depth][node]
            ok = (x[q] >= b[:, 0]) & (y[q] >= b[:, 1]) & (x[q] <= b[:, 2]) & (y[q] <= b[:, 3])
            q, node = q[ok], node[ok]
            if depth:
                child = node[:, None] * FANOUT + np.arange(FANOUT)
                ok = child < len(self.levels[depth - 1])
                q, node = np.repeat(q, FANOUT).reshape(-1, FANOUT)[ok], child[ok]
        return q, self.order[node]
