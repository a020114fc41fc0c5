"""Panorama, viewshed and sight of targets over a height field, with the earth's curve and refraction.

A height field is anything with ``height(lat, lon)`` on arrays (metres, NaN where nothing is known). Kernels are numpy, one
observer at a time; observers are spread over tasks, and only the observer's own samples are in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EARTH_M, REFRACTION = 6_371_008.8, 0.13
NO_DATA = 65535
#: Rays whose samples are made at once.
RAYS = 8


class HeightField(Protocol):
    def height(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray: ...


class Surface:
    """A field from a function of latitude and longitude."""

    def __init__(self, function):
        self.function = function

    def height(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.asarray(self.function(lat, lon), dtype=float)


class TileField:
    """A field from decoded tiles {(z, x, y): 2-D array of quarter metres}; bilinear, the nearest known corner where one is missing, coarser zooms as a fallback."""

    def __init__(self, tiles: dict[tuple[int, int, int], np.ndarray]):
        self.tiles = tiles
        self.zooms = sorted({z for z, _, _ in tiles}, reverse=True)

    def height(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        out = np.full(np.shape(lat), np.nan)
        for z in self.zooms:
            todo = np.isnan(out)
            if todo.any():
                out[todo] = self._level(z, np.asarray(lat)[todo], np.asarray(lon)[todo])
        return out

    def _level(self, z: int, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        size = next(t.shape[0] for k, t in self.tiles.items() if k[0] == z)
        n = (1 << z) * size
        px = (lon + 180) / 360 * n - 0.5
        py = (0.5 - np.arctanh(np.sin(np.radians(np.clip(lat, -85.05112878, 85.05112878)))) / (2 * math.pi)) * n - 0.5
        x0, y0 = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
        fx, fy = px - x0, py - y0
        corners = np.stack([self._pixel(z, size, (x0 + i) % n, np.clip(y0 + j, 0, n - 1)) for j in (0, 1) for i in (0, 1)])
        weights = np.stack([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy])
        blend = (corners * weights).sum(axis=0)
        known = ~np.isnan(corners)
        nearest = corners[np.where(known, weights, -1).argmax(axis=0), np.arange(corners.shape[1])] if corners.shape[1] else blend
        return np.where(known.all(axis=0), blend, np.where(known.any(axis=0), nearest, np.nan))

    def _pixel(self, z: int, size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        key = (x // size) * (1 << 32) + y // size
        for k in np.unique(key):
            t = self.tiles.get((z, int(k >> 32), int(k & 0xFFFFFFFF)))
            if t is not None:
                at = key == k
                v = t[y[at] % size, x[at] % size].astype(float)
                out[at] = np.where(v == NO_DATA, np.nan, v / 4)
        return out


def quantise(metres: np.ndarray) -> np.ndarray:
    """Quarter metres, below the sea as the sea; NaN is no data."""
    return np.where(np.isnan(metres), NO_DATA, np.clip(np.floor(np.nan_to_num(metres) * 4 + 0.5), 0, NO_DATA - 1)).astype(np.uint16)


def terrarium(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres of red, green and blue."""
    return r.astype(float) * 256 + g + b / 256.0 - 32768


def destination(lat: float, lon: float, azimuth: np.ndarray, metres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, d, b = math.radians(lat), metres / EARTH_M, np.radians(azimuth)
    sin_y = np.clip(np.sin(a) * np.cos(d) + np.cos(a) * np.sin(d) * np.cos(b), -1, 1)
    x = lon + np.degrees(np.arctan2(np.sin(b) * np.sin(d) * np.cos(a), np.cos(d) - np.sin(a) * sin_y))
    return np.degrees(np.arcsin(sin_y)), x - 360 * np.floor((x + 180) / 360)


def steps(most: float, least: float = 10.0, share: float = 0.003) -> np.ndarray:
    """Distances along a ray: at least so many metres apart, farther out by a share of the distance."""
    near = np.arange(1, int(least / share / least) + 1) * least
    out = [near[near <= most]]
    d = float(near[-1])
    far = []
    while d < most and len(near) and near[-1] <= most:
        d += max(least, share * d)
        far.append(min(d, most))
    return np.concatenate([out[0], far]) if far else out[0]


def slope(height: np.ndarray, eye: float, metres: np.ndarray, k: float = REFRACTION) -> np.ndarray:
    """Tangent of the angle at which a height is seen over the curved earth."""
    return (height - eye) / metres - metres * (1 - k) / (2 * EARTH_M)


def locate(field: HeightField, lat: float, lon: float, snap: float) -> tuple[float, float, float]:
    """(lat, lon, ground): the highest ground within `snap`, searched in rings; a ring's point must be half a metre higher to win."""
    best = (lat, lon, float(field.height(np.array([lat]), np.array([lon]))[0]))
    for r in np.arange(10.0, snap + 1e-9, 10.0):
        az = np.arange(0, 360, 360 / max(8, int(2 * math.pi * r / 10)))
        y, x = destination(lat, lon, az, np.full(len(az), r))
        h = field.height(y, x)
        if np.isfinite(h).any():
            i = int(np.nanargmax(h))
            if not math.isfinite(best[2]) or h[i] > best[2] + 0.5:
                best = (float(y[i]), float(x[i]), float(h[i]))
    return best


def _horizons(field: HeightField, lat: float, lon: float, eye: float, az: np.ndarray, d: np.ndarray, k: float) -> np.ndarray:
    """The steepest slope up to each distance of each ray; a few rays at a time, so that their samples stay in the processor's cache."""
    out = np.empty((len(az), len(d)))
    for r in range(0, len(az), RAYS):
        y, x = destination(lat, lon, az[r : r + RAYS, None], d[None, :])
        s = slope(field.height(y, x), eye, d[None, :], k)
        np.maximum.accumulate(np.where(np.isnan(s), -np.inf, s), axis=1, out=out[r : r + RAYS])
    return out


def panorama(field: HeightField, lat: float, lon: float, above: float = 2.0, columns: int = 360, most: float = 60_000.0, layers: tuple[float, ...] = (1000.0, 4000.0, 15_000.0), k: float = REFRACTION, snap: float = 0.0) -> pd.DataFrame:
    """(az, layer, horizon_deg, crest_m): the horizon up to the end of each layer, and the crest's distance if it lies in it."""
    lat, lon, ground = locate(field, lat, lon, snap)
    d = steps(most)
    az = np.arange(columns) * 360.0 / columns
    run = _horizons(field, lat, lon, ground + above, az, d, k)
    new = np.concatenate((np.ones((columns, 1), bool), run[:, 1:] > run[:, :-1]), axis=1)
    at = np.maximum.accumulate(np.where(new, np.arange(len(d))[None, :], 0), axis=1)  # where the maximum so far was first reached
    out, low = [], 0.0
    for i, high in enumerate([*[e for e in layers if e < most], most]):
        j = int(np.searchsorted(d, high, side="right")) - 1
        if j < 0:
            continue
        crest = d[at[:, j]]
        out.append(pd.DataFrame({"az": az, "layer": i, "horizon_deg": np.degrees(np.arctan(run[:, j])), "crest_m": np.where(crest > low, crest, np.nan)}))
        low = high
    return pd.concat(out, ignore_index=True)


def viewshed(
    field: HeightField, lat: float, lon: float, above: float = 2.0, most: float = 15_000.0, cell_m: float = 250.0, target: float = 0.0, k: float = REFRACTION, grid_lat: float | None = None
) -> pd.DataFrame:
    """(ix, iy, cell_m2): cells of the Mercator grid that the observer sees. A cell measures `cell_m` at `grid_lat`, by default the
    observer's own; viewsheds of one grid_lat share their cells. Rays are as dense as the outermost cells; a cell is compared
    with the horizons of its two neighbouring rays, blended by azimuth."""
    size = 2 * math.pi * EARTH_M
    n = int(size * math.cos(math.radians(lat if grid_lat is None else grid_lat)) / cell_m)
    unit = 1.0 / n
    cell_m = size * unit * math.cos(math.radians(lat))  # on the observer's ground
    cx, cy = (lon + 180) / 360, 0.5 - math.atanh(math.sin(math.radians(lat))) / (2 * math.pi)
    poleward = math.cos(math.radians(min(abs(lat) + math.degrees(most / EARTH_M), 85.0)))  # cells are smallest there
    half = int(most / (size * unit * poleward)) + 2
    ix, iy = np.meshgrid(np.arange(int(cx / unit) - half, int(cx / unit) + half + 1), np.arange(int(cy / unit) - half, int(cy / unit) + half + 1))
    ix, iy = ix.ravel(), iy.ravel()
    lo, la = (ix + 0.5) * unit * 360 - 180, np.degrees(np.arctan(np.sinh(math.pi * (1 - 2 * (iy + 0.5) * unit))))
    a1, a2, do = math.radians(lat), np.radians(la), np.radians(lo - lon)
    h = np.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * np.cos(a2) * np.sin(do / 2) ** 2
    dist = 2 * EARTH_M * np.arcsin(np.sqrt(h))
    az = np.degrees(np.arctan2(np.sin(do) * np.cos(a2), math.cos(a1) * np.sin(a2) - math.sin(a1) * np.cos(a2) * np.cos(do))) % 360
    keep = (dist <= most) & (dist > 0)
    ix, iy, la, lo, dist, az = (v[keep] for v in (ix, iy, la, lo, dist, az))
    eye = float(field.height(np.array([lat]), np.array([lon]))[0]) + above
    rays = max(360, int(2 * math.pi * most / cell_m))
    d = np.arange(1, int(most / (cell_m / 2)) + 1) * cell_m / 2
    run = _horizons(field, lat, lon, eye, np.arange(rays) * 360.0 / rays, d, k)
    before = np.concatenate((np.full((rays, 1), -np.inf), run), axis=1)  # the horizon of all samples nearer than the cell
    j = np.searchsorted(d, dist - cell_m / 2)
    pos = az / 360 * rays
    r0 = np.floor(pos).astype(int) % rays
    f = pos - np.floor(pos)
    hor0, hor1 = before[r0, j], before[(r0 + 1) % rays, j]
    horizon = np.where(np.isinf(hor0) | np.isinf(hor1), np.minimum(hor0, hor1), hor0 * (1 - f) + hor1 * f)
    seen = slope(field.height(la, lo) + target, eye, dist, k) >= horizon
    area = (size * unit * np.cos(np.radians(la))) ** 2
    return pd.DataFrame({"ix": ix[seen] % n, "iy": iy[seen], "cell_m2": area[seen]})


def sight(field: HeightField, lat: float, lon: float, above: float, targets: pd.DataFrame, k: float = REFRACTION, snap: float = 0.0) -> pd.DataFrame:
    """targets(target, lat, lon, above) with metres, clearance_deg and visible: seen if it stands above the ground before it, the last
    part before the target (2 % of the way, 150 to 1,500 m) left out."""
    lat, lon, ground = locate(field, lat, lon, snap)
    eye = ground + above
    out = []
    for t in targets.itertuples(index=False):
        a1, a2, do = math.radians(lat), math.radians(t.lat), math.radians(t.lon - lon)
        d = 2 * EARTH_M * math.asin(math.sqrt(math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin(do / 2) ** 2))
        az = math.degrees(math.atan2(math.sin(do) * math.cos(a2), math.cos(a1) * math.sin(a2) - math.sin(a1) * math.cos(a2) * math.cos(do)))
        guard = min(max(0.02 * d, 150.0), 1500.0)
        own = math.degrees(math.atan(float(slope(field.height(np.array([t.lat]), np.array([t.lon])) + t.above, eye, np.array([max(d, 1.0)]), k)[0])))
        way = steps(d - guard) if d > guard + 10 else np.zeros(0)
        if len(way):
            y, x = destination(lat, lon, np.full(len(way), az), way)
            before = math.degrees(math.atan(float(np.nanmax(slope(field.height(y, x), eye, way, k)))))
        else:
            before = -90.0
        out.append((t.target, d, own - before, own - before >= -0.002))
    return pd.DataFrame(out, columns=["target", "metres", "clearance_deg", "visible"])


def _spread(observers: DataFrame, *columns: str) -> DataFrame:
    """Observers dealt over all tasks: few bytes, but much work each."""
    n = int(observers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return observers.where("lat is not null and lon is not null").select(*columns).repartition(n)


def panoramas(observers: DataFrame, field: HeightField, **options) -> DataFrame:
    """observers(id, lat, lon, above_ground_m) -> (id, az, layer, horizon_deg, crest_m); nothing for an observer without a position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for o in b.itertuples(index=False):
                yield panorama(field, o.lat, o.lon, o.above_ground_m, **options).assign(id=o.id)[["id", "az", "layer", "horizon_deg", "crest_m"]]

    return _spread(observers, "id", "lat", "lon", "above_ground_m").mapInPandas(run, "id string, az double, layer int, horizon_deg double, crest_m double")


def overlay(observers: DataFrame, field: HeightField, **options) -> DataFrame:
    """(ix, iy, seen_by, cell_m2): how many observers see each cell of one grid, at most 255. Its cells measure `cell_m` at the observers' mean latitude, if `grid_lat` doesn't say another."""
    from pyspark.sql import functions as F

    if options.get("grid_lat") is None:
        options["grid_lat"] = observers.where("lat is not null and lon is not null").agg(F.round(F.avg("lat"), 6)).first()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for o in b.itertuples(index=False):
                yield viewshed(field, o.lat, o.lon, o.above_ground_m, **options)

    cells = _spread(observers, "lat", "lon", "above_ground_m").mapInPandas(run, "ix bigint, iy bigint, cell_m2 double")
    return cells.groupBy("ix", "iy").agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("seen_by"), F.first("cell_m2").alias("cell_m2"))
