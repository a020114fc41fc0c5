"""A quadtree over longitude and latitude, built on the driver from a bounded sample; leaves are ranges of Morton codes."""

from __future__ import annotations

import numpy as np

DEPTH = 16
CAP_LAT = 85.0  # beyond it a pole's cap is one leaf: its points are compared in space, not in degrees
NORTH, SOUTH = -1, -2


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def morton(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    top = (1 << DEPTH) - 1
    y = np.clip((lat + 90.0) / 180.0 * (1 << DEPTH), 0, top)
    x = np.clip((lon + 180.0) / 360.0 * (1 << DEPTH), 0, top)
    return ((_spread(np.floor(y)) << np.uint64(1)) | _spread(np.floor(x))).astype(np.int64)


class Quadtree:
    """starts: first code of each leaf, ascending; slices: into how many parts a leaf's probes are cut.

    A leaf is split while it holds more than `most` sample points and its quarters stay wider than twice the radius:
    then a point's reach touches only the leaves in which the corners of its box lie. A leaf that may not be split any
    further but still is too full gets slices: its probes are shared out among them, each slice holding all of its points.
    """

    def __init__(self, lat: np.ndarray, lon: np.ndarray, most: int, radius_deg: float):
        inner = np.abs(lat) <= CAP_LAT
        codes = np.sort(morton(lat[inner], lon[inner]))
        starts, slices = [], []
        stack = [(0, 0)]
        while stack:
            depth, start = stack.pop()
            width = 1 << (2 * (DEPTH - depth))
            held = int(np.searchsorted(codes, start + width) - np.searchsorted(codes, start))
            if held > most and self._may_split(depth, start, radius_deg):
                stack += [(depth + 1, start + k * width // 4) for k in (3, 2, 1, 0)]
            else:
                starts.append(start)
                slices.append(max(1, -(-held // most)))
        order = np.argsort(starts)
        self.starts = np.array(starts, dtype=np.int64)[order]
        caps = [max(1, -(-int(n) // most)) for n in ((lat < -CAP_LAT).sum(), (lat > CAP_LAT).sum())]
        self.slices = np.array([*np.array(slices)[order], *caps], dtype=np.int64)  # [-2] south, [-1] north

    @staticmethod
    def _may_split(depth: int, start: int, radius_deg: float) -> bool:
        if depth >= DEPTH:
            return False
        y = 0
        for bit in range(DEPTH):
            y |= ((start >> (2 * bit + 1)) & 1) << bit
        rows = 1 << (DEPTH - depth)
        low, high = (-90 + 180 * v / (1 << DEPTH) for v in (y, y + rows))
        furthest = min(max(abs(low), abs(high)), CAP_LAT)
        high_enough = 180.0 / (1 << (depth + 1)) > 2.2 * radius_deg
        return high_enough and 360.0 / (1 << (depth + 1)) > 2.2 * radius_deg / np.cos(np.radians(furthest))

    def leaf(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, morton(lat, lon), side="right") - 1
        return np.where(lat > CAP_LAT, NORTH, np.where(lat < -CAP_LAT, SOUTH, at))

    def boxes(self) -> np.ndarray:
        """(lat0, lat1, lon0, lon1) of every leaf, in the order of slices: the two caps last, south first."""
        side, depth = 1 << DEPTH, np.zeros(len(self.starts), dtype=np.int64)
        width = np.diff(np.append(self.starts, 1 << (2 * DEPTH)))
        depth = DEPTH - np.round(np.log2(width) / 2).astype(np.int64)
        x = y = np.zeros(len(self.starts), dtype=np.int64)
        for bit in range(DEPTH):
            x = x | ((self.starts >> (2 * bit)) & 1) << bit
            y = y | ((self.starts >> (2 * bit + 1)) & 1) << bit
        span = 1 << (DEPTH - depth)
        lat = lambda v: -90 + 180.0 * v / side
        lon = lambda v: -180 + 360.0 * v / side
        inner = np.column_stack((lat(y), lat(y + span), lon(x), lon(x + span)))
        return np.vstack((inner, [[-90.0, -CAP_LAT, -180.0, 180.0], [CAP_LAT, 90.0, -180.0, 180.0]]))

    def reach(self, lat: np.ndarray, lon: np.ndarray, radius_deg: float) -> np.ndarray:
        """n x 5: the home leaf, then those of the four corners of the box around each point."""
        dlat = radius_deg * 1.0001
        dlon = dlat / np.cos(np.radians(np.minimum(np.abs(lat) + dlat, CAP_LAT + 2 * dlat)))
        out = [self.leaf(lat, lon)]
        for a in (-1, 1):
            for o in (-1, 1):
                x = (lon + o * dlon + 180.0) % 360.0 - 180.0
                out.append(self.leaf(np.clip(lat + a * dlat, -90, 90), x))
        return np.column_stack(out)
