"""Joins of places: boxes, gazetteer look-ups, nearest neighbours, distance bands, redirects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import geo
from cairn.operators.proximity import near_pairs, region_of, usable
from cairn.session import cut


def in_boxes(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(key, code) for every box(code, lat0, lat1, lon0, lon1) that holds a point, by an equi join on one-degree cells."""
    p = points.where(usable(F.col("lat"), F.col("lon"))).select(key, "lat", "lon", F.floor("lat").cast("int").alias("cy"), F.floor("lon").cast("int").alias("cx"))
    b = boxes.withColumn("cy", F.explode(F.sequence(F.floor("lat0").cast("int"), F.floor("lat1").cast("int")))).withColumn("cx", F.explode(F.sequence(F.floor("lon0").cast("int"), F.floor("lon1").cast("int"))))
    return p.join(b, ["cx", "cy"]).where("lat between lat0 and lat1 and lon between lon0 and lon1").select(key, "code").distinct()


def coordinate_flag(lat: Column, lon: Column, boxes: Column) -> Column:
    """Why a position can't be in its region, null if it can: boxes ARRAY<STRUCT(lat0, lat1, lon0, lon1)>, null for an unknown region.

    The continent lies west of Greenwich and north of the equator, so outside the boxes a longitude above 0 or a latitude
    below 0 is a slip of the sign, whatever the region.
    """
    inside = F.coalesce(F.exists(boxes, lambda b: lat.between(b.lat0, b.lat1) & lon.between(b.lon0, b.lon1)), F.lit(False))
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(~known | inside, None).when(lon > 0, "lon_positive_sign").when(lat < 0, "lat_negative_sign").when(F.size(boxes) > 0, "outside_state_bbox")


def within(points: DataFrame, others: DataFrame, metres: float, key: str, other_key: str) -> DataFrame:
    """(key, other_key, metres) of points and others within a distance: cells of at least that height, their neighbours, then the distance.

    The others are repeated in the cells around theirs; cells are an equi join, which Spark splits where they are skewed.
    Beyond 85 degrees of latitude columns of cells are as wide as at 85 and neighbours as many as it takes.
    """
    step = max(math.degrees(metres / geo.EARTH_M) * 1.001, 1e-4)
    rows = lambda c: F.floor(c / step)
    p = points.where(usable(F.col("lat"), F.col("lon"))).select(F.col(key), F.col("lat").alias("_a"), F.col("lon").alias("_o"), rows(F.col("lat")).alias("_cy"))
    o = others.where(usable(F.col("lat"), F.col("lon"))).select(F.col(other_key), F.col("lat").alias("_b"), F.col("lon").alias("_q"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: rows(F.col("lat")) + d)).alias("_cy"))
    # the width of a row's cells is set by its edge nearest to a pole, so one column to either side is enough
    edge = F.least((F.greatest(F.abs("_cy"), F.abs(F.col("_cy") + 1)) + 1) * step, F.lit(89.9))
    width = F.lit(step) / F.cos(F.radians(edge))
    count = F.greatest(F.floor(360 / width), F.lit(1))
    column = lambda c: F.pmod(F.floor((c + 180) / (F.lit(360.0) / count)), count)
    p = p.withColumn("_cx", column(F.col("_o")))
    around = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(column(F.col("_q")) + d, count)))
    o = o.withColumn("_cx", F.explode(around))
    d = geo.distance_m(F.col("_a"), F.col("_o"), F.col("_b"), F.col("_q"))
    return p.join(o, ["_cy", "_cx"]).withColumn("metres", d).where(F.col("metres") <= metres).select(key, other_key, "metres")


def nearest(points: DataFrame, others: DataFrame, metres: float, k: int, key: str, other_key: str, beyond: float = 0.0) -> DataFrame:
    """(key, other_key, metres, place) of the k nearest others farther than `beyond` and within `metres`; ties by other_key."""
    near = within(points, others, metres, key, other_key).where(F.col("metres") > beyond)
    return near.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("metres", other_key))).where(F.col("place") <= k)


def look_up(records: DataFrame, gazetteer: DataFrame, key: str) -> DataFrame:
    """(key, outcome, place_id): the gazetteer's place of a record's region, county and name key if it is the only one.

    outcome: no_name, no_county (then the whole region is looked through), county_unknown, none, ambiguous or found.
    gazetteer(place_id, region, county_key, name_key).
    """
    g = gazetteer.select("place_id", F.col("region").alias("g_region"), F.col("county_key").alias("g_county"), F.col("name_key").alias("g_name"))
    counties = g.select(F.col("g_region").alias("region"), F.col("g_county").alias("county_key")).distinct().withColumn("known", F.lit(True))
    r = records.join(counties, ["region", "county_key"], "left")
    hits = r.join(g, (r.region == g.g_region) & (r.name_key == g.g_name) & (r.county_key.isNull() | (r.county_key == g.g_county)), "left")
    per = hits.groupBy(key, "name_key", "county_key", "known").agg(F.count("place_id").alias("n"), F.min("place_id").alias("place_id"))
    outcome = (
        F.when(F.coalesce("name_key", F.lit("")) == "", "no_name")
        .when(F.col("county_key").isNotNull() & F.col("known").isNull(), "county_unknown")
        .when(F.col("n") == 0, "none")
        .when(F.col("n") > 1, "ambiguous")
        .when(F.col("county_key").isNull(), "no_county")
        .otherwise("found")
    )
    return per.select(key, outcome.alias("outcome"), F.when(outcome.isin("found", "no_county"), F.col("place_id")).alias("place_id"))


#: Degrees by which a point beside all polygons is nudged, about 5 km.
NUDGE = 0.05


def nearest_region(points: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """(key, code, nudged): the polygon that holds a point; else the only one that its eight neighbours at NUDGE degrees lie in."""
    held = region_of(points, polygons, key).withColumn("nudged", F.lit(False))
    rest = points.where(usable(F.col("lat"), F.col("lon"))).join(held.select(key), key, "left_anti").select(key, "lat", "lon")
    ways = F.array(*[F.struct(F.lit(a * NUDGE).alias("dy"), F.lit(b * NUDGE).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    moved = rest.select(key, "lat", "lon", F.posexplode(ways).alias("way", "d")).select(F.to_json(F.struct(F.col(key).alias("k"), "way")).alias("at"), (F.col("lat") + F.col("d.dy")).alias("lat"), (F.col("lon") + F.col("d.dx")).alias("lon"))
    near = region_of(moved, polygons, "at").groupBy(F.from_json("at", f"k {points.schema[key].dataType.simpleString()}")["k"].alias(key)).agg(F.min("code").alias("code"), F.max("code").alias("other")).where("code = other")
    return held.unionByName(near.select(key, "code", F.lit(True).alias("nudged")))


def country_at(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(key, country) of points that boxes(code, country, lat0, lat1, lon0, lon1) of one country alone hold."""
    codes = in_boxes(points, boxes, key).join(boxes.select("code", "country").distinct(), "code")
    return codes.groupBy(key).agg(F.min("country").alias("country"), F.max("country").alias("_o")).where("country = _o").select(key, "country")


def near_misses(places: DataFrame, key: str, metres: float, name_metres: float, similarity: Column) -> DataFrame:
    """(key_a, key_b, metres, score) to look at: two places within `metres`, or within name_metres under names that are alike (0.5 or more).

    places(key, lat, lon, name_key); similarity: a score in [0, 1] of the columns name_a and name_b. Each pair once.
    """
    a = places.select(F.col(key).alias(f"{key}_a"), "lat", "lon")
    b = places.select(F.col(key).alias(f"{key}_b"), "lat", "lon")
    met = within(a, b, max(metres, name_metres), f"{key}_a", f"{key}_b").where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    for side in "ab":
        met = met.join(places.select(F.col(key).alias(f"{key}_{side}"), F.col("name_key").alias(f"name_{side}")), f"{key}_{side}")
    scored = met.withColumn("score", similarity)
    return scored.where((F.col("metres") <= metres) | ((F.col("metres") <= name_metres) & (F.col("score") >= 0.5))).select(f"{key}_a", f"{key}_b", "metres", "score")


def dead_reckoned(notes: DataFrame, towns: DataFrame, key: str) -> DataFrame:
    """(key, lat, lon) of notes(key, town, bearing, miles) reckoned from towns(town, lat, lon), to five decimals."""
    j = notes.join(towns.select("town", "lat", "lon"), "town")
    y, x = geo.destination(F.col("lat"), F.col("lon"), F.col("bearing"), F.col("miles") * 1609.344)
    return j.select(key, F.round(y, 5).alias("lat"), F.round(x, 5).alias("lon"))


def place_rentals(rentals: DataFrame, towers: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(key, tower, stage): listed rentals put to their towers.

    rentals(key, region, facility, name_key, loose_key), towers(tower, region, facility, name_key, loose_key, status). In this
    order: an override(key, tower); the booking system's facility number; the name in the region, if one tower bears it, or
    among several one alone that is rented (has a facility), or one alone that isn't known to be gone; the loose name, for the
    one rented tower that bears it. Else tower is null and the stage `several` or `none`.
    """
    r = rentals.select("key", "region", "facility", "name_key", "loose_key")
    t = towers.select("tower", F.col("region").alias("t_region"), F.col("facility").alias("t_facility"), F.col("name_key").alias("t_name"), F.col("loose_key").alias("t_loose"), (F.coalesce("status", F.lit("unknown")) == "gone").alias("gone"))
    rented = F.col("t_facility").isNotNull()

    def sole(found: DataFrame, stage: str, better: int) -> DataFrame:
        """Of each key the only tower of the best class there is; a class of several is none."""
        n = lambda c: F.count_if(c)
        g = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("tower").alias("one"), n(rented).alias("nr"), F.min(F.when(rented, F.col("tower"))).alias("r"), n(~F.col("gone")).alias("ns"), F.min(F.when(~F.col("gone"), F.col("tower"))).alias("s"))
        pick = F.when(F.col("n") == 1, F.col("one")).when(F.col("nr") == 1, F.col("r")).when(F.col("ns") == 1, F.col("s"))
        return g.select("key", pick.alias("tower"), F.when(pick.isNotNull(), stage).otherwise("several").alias("stage"), F.when(pick.isNotNull(), better).otherwise(9).alias("rank"))

    facility = r.join(t, (F.col("facility") == F.col("t_facility"))).groupBy("key").agg(F.min("tower").alias("tower"), F.lit("facility").alias("stage"), F.lit(2).alias("rank"))
    named = sole(r.where("name_key <> ''").join(t, (F.col("region") == F.col("t_region")) & (F.col("name_key") == F.col("t_name"))).select("key", "tower", "t_facility", "gone"), "name", 3)
    loosely = r.where("loose_key <> ''").join(t.where(rented), (F.col("region") == F.col("t_region")) & (F.col("loose_key") == F.col("t_loose"))).groupBy("key").agg(F.min("tower").alias("tower"), F.count(F.lit(1)).alias("n")).where("n = 1").select("key", "tower", F.lit("loose name").alias("stage"), F.lit(4).alias("rank"))
    every = facility.unionByName(named).unionByName(loosely)
    if overrides is not None:
        every = every.unionByName(overrides.join(t.select("tower"), "tower").select("key", "tower", F.lit("override").alias("stage"), F.lit(1).alias("rank")))
    best = every.groupBy("key").agg(F.min_by(F.struct("tower", "stage"), "rank").alias("b"))
    return r.select("key").join(best, "key", "left").select("key", "b.tower", F.coalesce("b.stage", F.lit("none")).alias("stage"))


def named_by_summits(records: DataFrame, summits: DataFrame, symbols: DataFrame, taken: DataFrame, near_m: float = 2000.0, taken_m: float = 500.0) -> DataFrame:
    """(symbol, key, names): symbols that a record known by name alone can claim.

    records(key, region, name_key), summits(summit, region, name_key, lat, lon), symbols(symbol, lat, lon), taken(place, lat, lon).
    A record's name must be one summit's of its region; one symbol alone must lie near that summit, and no taken place near
    the symbol; records under several names claim nothing. key: the first record, names: how many claim it.
    """
    one = lambda d, by, what: d.groupBy(by).agg(F.min(what).alias(what), F.count_distinct(what).alias("_n")).where("_n = 1").select(by, what)
    named = records.where("name_key <> ''").join(summits.select("summit", "region", "name_key"), ["region", "name_key"])
    sole = one(named, "key", "summit")
    at = summits.join(sole.select("summit").distinct(), "summit")
    beside = one(within(at, symbols, near_m, "summit", "symbol"), "summit", "symbol")
    free = beside.join(within(symbols, taken, taken_m, "symbol", "place").select("symbol").distinct(), "symbol", "left_anti")
    claims = sole.join(free, "summit").join(records.select("key", "name_key"), "key")
    got = claims.groupBy("symbol").agg(F.min("key").alias("key"), F.count_distinct("key").alias("names"), F.count_distinct("name_key").alias("_k"))
    return got.where("_k = 1").select("symbol", "key", "names")


def smoke_sites(cells: DataFrame, pair: DataFrame, least: int = 10) -> DataFrame:
    """(pair, lat, lon) of ground both towers of a pair see, 4 to 28 km from each, where their lines cut at 35 to 145 degrees; only of pairs with `least` such cells.

    cells(pair, lat, lon, seen_by), pair(pair, lat1, lon1, lat2, lon2).
    """
    j = cells.where("seen_by >= 2").join(pair, "pair")
    d = [geo.distance_m(F.col(f"lat{i}"), F.col(f"lon{i}"), F.col("lat"), F.col("lon")) for i in (1, 2)]
    b = [geo.bearing_deg(F.col("lat"), F.col("lon"), F.col(f"lat{i}"), F.col(f"lon{i}")) for i in (1, 2)]
    fine = j.where(d[0].between(4000, 28_000) & d[1].between(4000, 28_000)).where(geo.cut_angle(*b).between(35, 145)).select("pair", "lat", "lon")
    enough = fine.groupBy("pair").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("pair")
    return fine.join(enough, "pair", "left_semi")


def centroid(rings: Column) -> Column:
    """STRUCT(lat, lon): area centroid of the first, outer ring; the mean of its corners where it has no area."""
    ring = rings[0]
    first = ring[0]
    moved = F.transform(ring, lambda p: F.struct((p.lon - first.lon).alias("x"), (p.lat - first.lat).alias("y")))
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(moved, i).alias("p"), F.get(moved, F.pmod(i + 1, n)).alias("q")))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        c = e.p.x * e.q.y - e.q.x * e.p.y
        return F.struct((s.a + c).alias("a"), (s.x + (e.p.x + e.q.x) * c).alias("x"), (s.y + (e.p.y + e.q.y) * c).alias("y"))

    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda s, p: s + f(p)) / n
    area = F.aggregate(edges, start, add, lambda s: F.when(F.abs(s.a) >= 1e-15, F.struct((first.lat + s.y / (3 * s.a)).alias("lat"), (first.lon + s.x / (3 * s.a)).alias("lon"))))
    return F.when(n > 0, F.coalesce(area, F.struct(mean(lambda p: p.lat).alias("lat"), mean(lambda p: p.lon).alias("lon"))))


def resolve_redirects(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 64) -> DataFrame:
    """(src, final): where each id leads in the end; ids on or before a loop have no final. Chains are halved each round."""
    now = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("final")).dropna().groupBy("src").agg(F.min("final").alias("final")))
    for _ in range(rounds):
        onward = now.select(F.col("src").alias("final"), F.col("final").alias("next"))
        stepped = cut(now.join(onward, "final", "left").select("src", F.coalesce("next", "final").alias("final"), F.col("next").isNotNull().alias("moved")))
        now = stepped.select("src", "final")
        if stepped.where("moved").isEmpty():
            return now
        # an id whose chain still moves after more doublings than there are ids is in a loop
        if 2**_ > stepped.count():
            return stepped.where("not moved").select("src", "final")
    return now


def collapse(points: DataFrame, metres: float, key: str) -> DataFrame:
    """(key, survivor): greedy collapse of points within a distance, the lowest key first; not transitive.

    A point survives unless a surviving point of lower key is near. Decided in rounds: a point all of whose lower
    neighbours are decided is decided.
    """
    pairs = cut(near_pairs(points, metres, key).select(F.col("record_id_a").alias("low"), F.col("record_id_b").alias("high")))
    ids = points.where(usable(F.col("lat"), F.col("lon"))).select(F.col(key).cast("bigint").alias("id")).distinct()
    done = cut(ids.join(pairs.select(F.col("high").alias("id")).distinct(), "id", "left_anti").withColumn("survivor", F.col("id")))
    open_ = cut(ids.join(done.select("id"), "id", "left_anti"))
    while not open_.isEmpty():
        below = open_.join(pairs, open_.id == pairs.high).join(done.select(F.col("id").alias("low"), (F.col("id") == F.col("survivor")).alias("stays")), "low", "left")
        ready = below.groupBy("high").agg(F.min(F.when(F.col("stays"), F.col("low"))).alias("over"), F.count_if(F.col("stays").isNull()).alias("waiting"))
        new = cut(ready.where("waiting = 0").select(F.col("high").alias("id"), F.coalesce("over", "high").alias("survivor")))
        done = cut(done.union(new))
        open_ = cut(open_.join(new.select("id"), "id", "left_anti"))
    return done.withColumnRenamed("id", key)
