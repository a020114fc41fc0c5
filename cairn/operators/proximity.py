"""Points near other points, and the region that holds a point."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.quadtree import NORTH, SOUTH, Quadtree
from cairn.functions.rtree import BoxTree, PointTree, unit_vectors
from cairn.session import plain

EARTH_M = 6_371_000.0
#: Most rows of the sample from which the quadtree is built on the driver, and distinct places aimed at per leaf.
SAMPLE_ROWS = 100_000
LEAF_PLACES = 4_000
#: Records of one place are held in blocks of about so many; pairs of blocks are then spread over tasks.
BLOCK = 256


def usable(lat: Column, lon: Column) -> Column:
    """Both present and numbers, in range, and not both 0."""
    fine = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(fine & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def haversine(lat1, lon1, lat2, lon2, radius_m: float = EARTH_M) -> Column:
    """Great-circle distance of Columns in degrees."""
    h = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius_m * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # not least(), which skips nulls


def repaired(lat: Column, lon: Column) -> tuple[Column, Column]:
    """A position whose parts were exchanged, put right where that shows; null where it is of no use."""
    swapped = (F.abs(lat) > 90) & (F.abs(lon) <= 90) & (F.abs(lat) <= 180)
    y, x = F.when(swapped, lon).otherwise(lat), F.when(swapped, lat).otherwise(lon)
    fine = usable(y, x)
    return F.when(fine, y), F.when(fine, x)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    la, lb = np.radians(a[:, 0]), np.radians(b[:, 0])
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[:, 1] - a[:, 1]) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def near_places(places: DataFrame, metres: float, sample_rows: int = SAMPLE_ROWS, leaf_places: int = LEAF_PLACES) -> DataFrame:
    """(a, b, metres) of all pairs a < b of rows of places(place BIGINT, lat, lon) within `metres`, each pair once.

    A bounded sample makes a quadtree. Each place goes to its own leaf as a probe and to every leaf its reach touches as
    something to be found; each leaf is loaded into an R-tree and probed. A pair belongs to the leaf of its reference
    point, the place with the smaller number, so none comes out twice.
    """
    radius_deg = math.degrees(metres / EARTH_M)
    n = places.count()
    share = min(1.0, sample_rows / max(n, 1))
    sample = places if share == 1 else places.where(F.pmod(F.xxhash64("place"), F.lit(1 << 40)) < int(share * (1 << 40)))
    got = sample.select("lat", "lon").toPandas()
    tree = Quadtree(got["lat"].to_numpy(float), got["lon"].to_numpy(float), max(16, int(leaf_places * share)), radius_deg)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lat, lon, place = b["lat"].to_numpy(float), b["lon"].to_numpy(float), b["place"].to_numpy()
            leaves = tree.reach(lat, lon, radius_deg)
            rows, parts, homes, own = [], [], [], (place * 2654435761) % (1 << 31)
            for k in range(5):
                fresh = np.ones(len(b), bool)
                for j in range(k):
                    fresh &= leaves[:, j] != leaves[:, k]
                at = np.flatnonzero(fresh)
                cuts = tree.slices[leaves[at, k]]
                row = np.repeat(at, cuts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                rows.append(row)
                parts.append(part)
                homes.append((own[row] % np.repeat(cuts, cuts) == part) if k == 0 else np.zeros(len(row), bool))
            row = np.concatenate(rows)
            leaf = np.concatenate([leaves[r, k] for k, r in enumerate(rows)])
            yield pd.DataFrame({"leaf": leaf, "part": np.concatenate(parts), "place": place[row], "lat": lat[row], "lon": lon[row], "home": np.concatenate(homes)})

    def probe(b: pd.DataFrame) -> pd.DataFrame:
        ll, place, home = b[["lat", "lon"]].to_numpy(float), b["place"].to_numpy(), np.flatnonzero(b["home"].to_numpy())
        xyz = unit_vectors(ll[:, 0], ll[:, 1])
        chord = 2 * math.sin(min(metres / EARTH_M, math.pi) / 2) * (1 + 1e-9) + 1e-12
        out = []
        for q, p in PointTree(xyz).balls(xyz[home], chord):
            q = home[q]
            keep = place[q] < place[p]
            q, p = q[keep], p[keep]
            d = _distance(ll[q], ll[p])
            keep = d <= metres
            out.append(pd.DataFrame({"a": place[q][keep], "b": place[p][keep], "metres": d[keep]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "metres": pd.Series(dtype="float64")})

    cells = places.select("place", "lat", "lon").mapInPandas(spread, "leaf bigint, part bigint, place bigint, lat double, lon double, home boolean")
    return cells.groupBy("leaf", "part").applyInPandas(probe, "a bigint, b bigint, metres double")


def near_pairs(df: DataFrame, metres: float, key: str = "record_id", lat: str = "lat", lon: str = "lon", sample_rows: int = SAMPLE_ROWS, leaf_places: int = LEAF_PLACES) -> DataFrame:
    """(record_id_a, record_id_b) of all pairs of rows within `metres`, a < b, each once.

    Rows without a usable position (see usable) have no pairs; an empty table gives none. Rows at one and the same
    position are one place while places are compared, so a hot position costs nothing there; its pairs are then made
    from blocks of its rows. A repeated key counts once; other columns are ignored.
    """
    points = df.where(usable(F.col(lat), F.col(lon))).select(F.col(key).cast("bigint").alias("id"), (F.col(lat) + 0.0).alias("lat"), (F.col(lon) + 0.0).alias("lon"))
    places = points.groupBy("lat", "lon").agg(F.min("id").alias("place"), F.count(F.lit(1)).alias("n"))
    pairs = near_places(places, metres, sample_rows, leaf_places).select("a", "b")
    blocks = (
        points.join(places, ["lat", "lon"])
        .withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)))
        .groupBy("place", "block")
        .agg(F.collect_set("id").alias("ids"))
    )
    own = places.where("n > 1").select(F.col("place").alias("a"), F.col("place").alias("b"))
    left = blocks.select(F.col("place").alias("a"), F.col("block").alias("block_a"), F.col("ids").alias("ids_a"))
    right = blocks.select(F.col("place").alias("b"), F.col("block").alias("block_b"), F.col("ids").alias("ids_b"))
    return (
        pairs.union(own)
        .join(left, "a")
        .join(right, "b")
        .where((F.col("a") != F.col("b")) | (F.col("block_a") <= F.col("block_b")))
        .select("a", "b", "block_a", "block_b", F.explode("ids_a").alias("x"), "ids_b")
        .select("a", "b", "block_a", "block_b", "x", F.explode("ids_b").alias("y"))
        .where((F.col("a") != F.col("b")) | (F.col("block_a") != F.col("block_b")) | (F.col("x") < F.col("y")))
        .select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b"))
    )


def crossings(rings: Column, lon: Column, lat: Column) -> Column:
    """How many edges of the rings a ray to the east crosses; odd: the point is inside (holes count by themselves)."""

    def of_ring(ring: Column) -> Column:
        edges = F.zip_with(ring, F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        hit = lambda e: ((e.p.lat > lat) != (e.q.lat > lat)) & (lon < (e.q.lon - e.p.lon) * (lat - e.p.lat) / (e.q.lat - e.p.lat) + e.p.lon)
        return F.size(F.filter(edges, lambda e: e.q.isNotNull() & F.coalesce(hit(e), F.lit(False))))

    return F.aggregate(F.coalesce(rings, F.array()), F.lit(0), lambda n, r: n + F.greatest(of_ring(F.concat(r, F.slice(r, 1, 1))), F.lit(0)))


def region_of(df: DataFrame, polygons: DataFrame, key: str = "record_id", lat: str = "lat", lon: str = "lon", sample_rows: int = SAMPLE_ROWS, leaf_places: int = LEAF_PLACES) -> DataFrame:
    """(key, code) for each row whose point lies in a polygon: even-odd rule over all rings, smallest code where several hold it.

    A bounded sample of the points makes a quadtree. A point goes to its own leaf, so it is looked up once; a polygon goes to
    every leaf its box touches, with those of its edges that can cross a ray to the east within the leaf. Each leaf's
    polygons are loaded into an R-tree of their boxes, the points are probed, and the even-odd rule decides. A leaf with too
    many points is shared out to several tasks. Polygons with an empty box, and rows without a usable position, give nothing.
    """
    points = df.where(usable(F.col(lat), F.col(lon))).select(F.col(key).alias("_key"), F.col(lat).alias("y"), F.col(lon).alias("x"))
    share = min(1.0, sample_rows / max(points.count(), 1))
    sample = points if share == 1 else points.where(F.pmod(F.xxhash64("_key", "x", "y"), F.lit(1 << 40)) < int(share * (1 << 40)))
    got = sample.select("y", "x").toPandas()
    tree = Quadtree(got["y"].to_numpy(float), got["x"].to_numpy(float), max(16, int(leaf_places * share)), 0.0)
    kind = points.schema["_key"].dataType.simpleString()

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf = tree.leaf(b["y"].to_numpy(float), b["x"].to_numpy(float))
            yield b.assign(leaf=leaf, part=np.arange(len(b)) % tree.slices[leaf])

    ring = lambda r: F.zip_with(r, F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    edges = F.flatten(F.transform(F.filter("rings", lambda r: F.size(r) > 0), ring))
    end = lambda at, c: F.transform("e", lambda e: e[at][c]).alias(f"{c}_{at}")
    flat = polygons.where("x0 <= x1 and y0 <= y1").select("code", "x0", "y0", "x1", "y1", edges.alias("e")).select("code", "x0", "y0", "x1", "y1", end("p", "lon"), end("p", "lat"), end("q", "lon"), end("q", "lat"))
    boxes, slices = tree.boxes(), tree.slices
    number = np.append(np.arange(len(boxes) - 2), [SOUTH, NORTH])

    def touched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):  # a row is a polygon: few, and its edges are arrays
                ax, ay, bx, by = (np.asarray(v, dtype=float) for v in r[5:9])
                low, high, east = np.minimum(ay, by), np.maximum(ay, by), np.maximum(ax, bx)
                out = []
                for i in np.flatnonzero((boxes[:, 0] <= r.y1) & (boxes[:, 1] >= r.y0) & (boxes[:, 2] <= r.x1) & (boxes[:, 3] >= r.x0)):
                    keep = (high >= boxes[i, 0]) & (low <= boxes[i, 1]) & (east >= boxes[i, 2])
                    if keep.any():
                        out += [(number[i], part, r.code, r.x0, r.y0, r.x1, r.y1, ax[keep], ay[keep], bx[keep], by[keep]) for part in range(slices[i])]
                yield pd.DataFrame(out, columns=["leaf", "part", "code", "x0", "y0", "x1", "y1", "ax", "ay", "bx", "by"])

    def probe(p: pd.DataFrame, polys: pd.DataFrame) -> pd.DataFrame:
        x, y = p["x"].to_numpy(float), p["y"].to_numpy(float)
        q, at = BoxTree(polys[["x0", "y0", "x1", "y1"]].to_numpy(float)).holding(x, y)
        hits = np.zeros(len(q), bool)
        for i in np.unique(at):
            e = [np.asarray(polys[c].iloc[i], dtype=float) for c in ("ax", "ay", "bx", "by")]
            for k in np.array_split(np.flatnonzero(at == i), 1 + (at == i).sum() * len(e[0]) // 4_000_000):
                hits[k] = _odd(x[q[k]], y[q[k]], *e)
        found = pd.DataFrame({key: p["_key"].to_numpy()[q[hits]], "row": q[hits], "code": polys["code"].to_numpy(object)[at[hits]]})
        return plain(found.groupby("row", sort=False).agg({key: "first", "code": "min"})[[key, "code"]], ["code"])

    there = points.mapInPandas(homes, f"_key {kind}, y double, x double, leaf bigint, part bigint").groupBy("leaf", "part")
    here = flat.mapInPandas(touched, "leaf bigint, part bigint, code string, x0 double, y0 double, x1 double, y1 double, ax array<double>, ay array<double>, bx array<double>, by array<double>").groupBy("leaf", "part")
    return there.cogroup(here).applyInPandas(probe, f"{key} {kind}, code string").groupBy(key).agg(F.min("code").alias("code"))


def _odd(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each point whether a ray to the east crosses an odd number of edges."""
    with np.errstate(divide="ignore", invalid="ignore"):
        across = (ay > y[:, None]) != (by > y[:, None])
        return ((across & (x[:, None] < (bx - ax) * (y[:, None] - ay) / (by - ay) + ax)).sum(axis=1) % 2).astype(bool)
