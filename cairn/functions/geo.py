"""Geodesy as Columns: distances, bearings, Mercator, tiles, crossings, datums and projections."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
REFRACTION = 0.13
MERCATOR_MAX = 85.05112878


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return wrap360(F.degrees(F.atan2(y, x)))


def wrap360(deg: Column) -> Column:
    return F.pmod(deg, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Signed turn from a to b, in (-180, 180]."""
    d = F.pmod(b - a, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def destination(lat: Column, lon: Column, bearing: Column, metres: Column, radius: float = EARTH_M) -> tuple[Column, Column]:
    d, b, a = metres / radius, F.radians(bearing), F.radians(lat)
    y = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    x = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(y))
    return F.degrees(y), F.pmod(F.degrees(x) + 180, F.lit(360.0)) - 180


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in [0, 1], y to the south."""
    a = F.radians(F.greatest(F.least(lat, F.lit(MERCATOR_MAX)), F.lit(-MERCATOR_MAX)))
    return (lon + 180) / 360, 0.5 - F.atanh(F.sin(a)) / (2 * math.pi)


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon)."""
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y)))), x * 360 - 180


def tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    x, y = mercator(lat, lon)
    n = 1 << zoom
    return F.pmod(F.floor(x * n), F.lit(n)), F.greatest(F.least(F.floor(y * n), F.lit(n - 1)), F.lit(0))


def cell(lat: Column, lon: Column) -> Column:
    """Name of the one-degree cell."""
    return F.concat_ws("_", F.floor(lat).cast("string"), F.floor(lon).cast("string"))


def tiles_for_disc(lat: Column, lon: Column, radius_m: float, zoom: int) -> Column:
    """Tiles (x, y) whose nearest point lies within the radius. Columns wrap around the globe."""
    n = 1 << zoom
    dlat = math.degrees(radius_m / EARTH_M)
    dlon = F.least(dlat / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + dlat, F.lit(89.0)))), F.lit(1e-6)), F.lit(180.0))
    _, y0 = mercator(lat + dlat, lon)
    _, y1 = mercator(lat - dlat, lon)
    x0, x1 = (lon - dlon + 180) / 360, (lon + dlon + 180) / 360
    xs = F.sequence(F.floor(x0 * n), F.floor(x1 * n))
    ys = F.sequence(F.greatest(F.floor(y0 * n), F.lit(0)), F.least(F.floor(y1 * n), F.lit(n - 1)))
    cx, cy = mercator(lat, lon)

    def near(x: Column, y: Column) -> Column:
        px = F.greatest(F.least(cx, (x + 1) / n), x / n)
        py = F.greatest(F.least(cy, (y + 1) / n), y / n)
        a, o = unmercator(px, py)
        return distance_m(lat, lon, a, o) <= radius_m

    every = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
    kept = F.filter(every, lambda t: near(t.x, t.y))
    return F.array_distinct(F.transform(kept, lambda t: F.struct(F.pmod(t.x, F.lit(n)).alias("x"), t.y.alias("y"))))


def _vector(lat: Column, lon: Column) -> list[Column]:
    a, o = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _pole(lat: Column, lon: Column, bearing: Column) -> list[Column]:
    """The pole of the great circle that leaves a point in a direction, and so the circle itself."""
    a, o, b = F.radians(lat), F.radians(lon), F.radians(bearing)
    return [F.sin(o) * F.cos(b) - F.sin(a) * F.cos(o) * F.sin(b), -F.cos(o) * F.cos(b) - F.sin(a) * F.sin(o) * F.sin(b), F.cos(a) * F.sin(b)]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once: an expression is evaluated again wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def crossing(lat1: Column, lon1: Column, b1: Column, lat2: Column, lon2: Column, b2: Column, most_m: float = 150_000.0) -> Column:
    """STRUCT(lat, lon) where two bearings meet ahead of both and within most_m of each, else null."""
    given = F.struct(*[c.alias(n) for n, c in (("lat1", lat1), ("lon1", lon1), ("b1", b1), ("lat2", lat2), ("lon2", lon2), ("b2", b2))])
    vector = lambda v: F.struct(*[x.alias(n) for n, x in zip("xyz", v, strict=True)])
    parts = lambda v: [v[n] for n in "xyz"]

    def met(g: Column) -> Column:
        line = vector(_cross(_pole(g["lat1"], g["lon1"], g["b1"]), _pole(g["lat2"], g["lon2"], g["b2"])))
        return _let(line, lambda c: _let(F.sqrt(_dot(parts(c), parts(c))), lambda size: _let(spot(g, parts(c), size), lambda p: F.when(fine(g, p, size), p))))

    def spot(g: Column, c: list[Column], size: Column) -> Column:
        ends = _dot(c, _vector(g["lat1"], g["lon1"])) + _dot(c, _vector(g["lat2"], g["lon2"]))
        u = [x * F.when(ends < 0, -1.0).otherwise(1.0) / size for x in c]
        return F.struct(F.degrees(F.asin(F.greatest(F.least(u[2], F.lit(1.0)), F.lit(-1.0)))).alias("lat"), F.degrees(F.atan2(u[1], u[0])).alias("lon"))

    def fine(g: Column, p: Column, size: Column) -> Column:
        ahead = lambda i: F.abs(angle_between(g[f"b{i}"], bearing_deg(g[f"lat{i}"], g[f"lon{i}"], p["lat"], p["lon"]))) < 90
        near = lambda i: distance_m(g[f"lat{i}"], g[f"lon{i}"], p["lat"], p["lon"]) <= most_m
        return (size > 1e-12) & ahead(1) & ahead(2) & near(1) & near(2)

    return _let(given, met)


def cut_angle(b1: Column, b2: Column) -> Column:
    """Angle between two lines of sight, 0 to 180; 90 makes the best fix."""
    return F.abs(angle_between(b2, b1))


def fix_score(metres: Column) -> Column:
    """3, 2 or 1 for a fix nearer than 400, 1,500 and 5,000 m."""
    return F.when(metres < 400, 3).when(metres < 1500, 2).when(metres < 5000, 1).otherwise(0)


def compass16(deg: Column) -> Column:
    names = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.floor(wrap360(deg) / 22.5 + 0.5), F.lit(16)) + 1).cast("int"))


#: Shifts in metres from WGS84 to NAD27.
SHIFTS = {"conus": (8.0, -160.0, -176.0), "alaska": (5.0, -135.0, -172.0)}
_WGS84, _CLARKE = (6378137.0, 1 / 298.257223563), (6378206.4, 1 / 294.9786982)


def to_nad27(lat: Column, lon: Column, area: str = "conus") -> tuple[Column, Column]:
    """Molodensky's standard formulas at height 0, from WGS84 to NAD27: (lat, lon). As in DMA Technical Report 8350.2."""
    dx, dy, dz = SHIFTS[area]
    a, f = _WGS84
    da, df = _CLARKE[0] - a, _CLARKE[1] - f
    e2, b = f * (2 - f), a * (1 - f)
    p, o = F.radians(lat), F.radians(lon)
    sp, cp, so, co = F.sin(p), F.cos(p), F.sin(o), F.cos(o)
    w = 1 - e2 * sp * sp
    m, n = a * (1 - e2) / F.pow(w, 1.5), a / F.sqrt(w)
    north = -dx * sp * co - dy * sp * so + dz * cp + da * n * e2 * sp * cp / a + df * (m * a / b + n * b / a) * sp * cp
    east = -dx * so + dy * co
    return lat + F.degrees(north / m), lon + F.degrees(east / (n * cp))


def meridian_m(lat: Column, a: float = _CLARKE[0], f: float = _CLARKE[1]) -> Column:
    """Length of the meridian from the equator (Snyder, Map Projections, equation 3-21)."""
    e = f * (2 - f)
    p = F.radians(lat)
    c0, c2, c4, c6 = 1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256, 3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024, 15 * e**2 / 256 + 45 * e**3 / 1024, 35 * e**3 / 3072
    return a * (c0 * p - c2 * F.sin(2 * p) + c4 * F.sin(4 * p) - c6 * F.sin(6 * p))


def polyconic(lat: Column, lon: Column, lon0: float, lat0: float = 0.0, a: float = _CLARKE[0], f: float = _CLARKE[1]) -> tuple[Column, Column]:
    """(x, y) in metres."""
    e = f * (2 - f)
    p, d = F.radians(lat), F.radians(lon - lon0)
    n = a / F.sqrt(1 - e * F.sin(p) ** 2)
    m0 = meridian_m(F.lit(lat0), a, f)
    turn = d * F.sin(p)
    x = F.when(F.abs(p) < 1e-12, a * d).otherwise(n * F.cot(p) * F.sin(turn))
    y = F.when(F.abs(p) < 1e-12, -m0).otherwise(meridian_m(lat, a, f) - m0 + n * F.cot(p) * (1 - F.cos(turn)))
    return x, y


def transverse_mercator(lat: Column, lon: Column, lon0: float, k0: float = 0.9996, x0: float = 500_000.0, a: float = _CLARKE[0], f: float = _CLARKE[1]) -> tuple[Column, Column]:
    """(x, y) in metres."""
    e = f * (2 - f)
    p = F.radians(lat)
    ep = e / (1 - e)
    n = a / F.sqrt(1 - e * F.sin(p) ** 2)
    t, c, q = F.tan(p) ** 2, ep * F.cos(p) ** 2, F.radians(lon - lon0) * F.cos(p)
    x = k0 * n * (q + (1 - t + c) * q**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep) * q**5 / 120) + x0
    y = k0 * (meridian_m(lat, a, f) + n * F.tan(p) * (q**2 / 2 + (5 - t + 9 * c + 4 * c**2) * q**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep) * q**6 / 720))
    return x, y


def parse_dms(text: Column) -> Column:
    """Degrees of a position such as 52° 30' 15" N or 52 30.25 N; null if a part is out of range."""
    pattern = r"""^\s*(\d{1,3})\D+(\d{1,2}(?:\.\d+)?)(?:\D+(\d{1,2}(?:\.\d+)?))?\D*?([NSEW])\s*$"""
    part = lambda i: F.nullif(F.regexp_extract(F.upper(text), pattern, i), F.lit(""))
    d, m, s = (part(i).cast("double") for i in (1, 2, 3))
    v = d + m / 60 + F.coalesce(s, F.lit(0.0)) / 3600
    side = part(4)
    fine = (m < 60) & (F.coalesce(s, F.lit(0.0)) < 60) & (v <= F.when(side.isin("N", "S"), 90).otherwise(180))
    return F.when(fine, F.when(side.isin("S", "W"), -v).otherwise(v))


def vector_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance by the angle of two unit vectors, sound for points near each other and for antipodes."""
    a, b = _vector(lat1, lon1), _vector(lat2, lon2)
    c = _cross(a, b)
    return radius * F.atan2(F.sqrt(_dot(c, c)), _dot(a, b))


def mercator_metres(lat: Column, radius: float = EARTH_M) -> Column:
    """Metres on the ground of one unit of Mercator's square at a latitude."""
    return F.cos(F.radians(lat)) * 2 * math.pi * radius


def pixel_metres(lat: Column, zoom: int, tile_px: int = 256) -> Column:
    return mercator_metres(lat) / (tile_px * (1 << zoom))


#: Zoom of the terrain up to a distance in metres.
LEVELS = ((12, 4_000.0), (10, 40_000.0), (9, 100_000.0), (8, math.inf))


def panorama_levels(most_m: float, light: bool = False) -> list[tuple[int, float]]:
    """(zoom, up to metres) for a view of that reach, finest first; light: without zoom 9."""
    out: list[tuple[int, float]] = []
    for zoom, reach in LEVELS:
        if (not out or out[-1][1] < most_m) and not (light and zoom == 9):
            out.append((zoom, min(reach, most_m)))
    return out


def viewshed_levels(radius_m: float) -> list[tuple[int, float]]:
    """Zoom 12 near by, 10 beyond."""
    near = LEVELS[0]
    return [(near[0], min(near[1], radius_m)), *([(10, radius_m)] if radius_m > near[1] else [])]


#: Keys of georeferenced images, units in metres, codes of datums and methods.
KEYS = {"model": 1024, "unit": 3076, "system": 3072, "geographic": 2048, "axis": 2057, "method": 3075, "lon0": (3080, 3088), "lat0": (3081, 3089), "k0": 3092, "east": 3082, "north": 3083}
UNITS_M = {9001: 1.0, 9002: 0.3048, 9003: 1200 / 3937}
DATUMS = {4267: "nad27", 4269: "wgs84", 4326: "wgs84", 4152: "wgs84"}
METHODS = {1: "transverse_mercator", 22: "polyconic"}
ZONES = {267: "nad27", 269: "wgs84", 326: "wgs84"}


def georeference(keys: Column, lat: Column, lon: Column) -> Column:
    """STRUCT(kind, datum, shift, lon0, lat0, k0, east, north, unit, unsupported) of an image's keys MAP<INT, DOUBLE>.

    shift: the area of the datum shift, null where there is none; unsupported: why the keys can't be used, and all else null.
    Codes of UTM zones stand for their projection; a projection of the image's own needs datum, method and central meridian.
    """
    get = lambda k: F.coalesce(*[F.try_element_at(keys, F.lit(x)) for x in (k if isinstance(k, tuple) else (k,))])
    pick = lambda table, code: F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in table.items()])
    unit = pick(UNITS_M, F.coalesce(get(KEYS["unit"]), F.lit(9001.0)))
    system, geographic, axis = get(KEYS["system"]), get(KEYS["geographic"]), get(KEYS["axis"])
    own = system.isNull() | (system == 32767)
    zone = F.when(~own & pick(ZONES, F.floor(system / 100)).isNotNull(), system % 100)
    unnamed = geographic.isNull() | (geographic == 32767)
    by_axis = F.when(F.abs(axis - _CLARKE[0]) < 0.5, "nad27").when(F.abs(axis - _WGS84[0]) < 0.5, "wgs84")
    datum = F.when(zone.isNotNull(), pick(ZONES, F.floor(system / 100))).otherwise(F.when(unnamed, by_axis).otherwise(pick(DATUMS, geographic)))
    kind = F.when(zone.isNotNull(), "transverse_mercator").otherwise(pick(METHODS, get(KEYS["method"])))
    lon0 = F.when(zone.isNotNull(), -183 + 6 * zone).otherwise(get(KEYS["lon0"]))
    wrong = (
        F.when(F.coalesce(get(KEYS["model"]), F.lit(0.0)) != 1, "not a projected map").when(unit.isNull(), "linear unit").when(~own & zone.isNull(), "coordinate system")
        .when(datum.isNull(), "datum").when(kind.isNull(), "projection method").when(lon0.isNull(), "no central meridian")
    )
    shift = F.when(datum == "nad27", F.when((lat > 51) & (lon < -129), "alaska").otherwise("conus"))
    utm = lambda of_zone, otherwise: F.when(zone.isNotNull(), of_zone).otherwise(otherwise)
    fields = {"kind": kind, "datum": datum, "shift": shift, "lon0": lon0, "lat0": utm(0.0, F.coalesce(get(KEYS["lat0"]), F.lit(0.0))), "k0": utm(0.9996, F.coalesce(get(KEYS["k0"]), F.lit(1.0))), "east": utm(500_000.0, F.coalesce(get(KEYS["east"]), F.lit(0.0)) * unit), "north": utm(0.0, F.coalesce(get(KEYS["north"]), F.lit(0.0)) * unit), "unit": unit}
    return F.struct(*[F.when(wrong.isNull(), c).alias(n) for n, c in fields.items()], wrong.alias("unsupported"))
