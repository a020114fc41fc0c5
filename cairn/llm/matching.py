"""Records matched to entities of another table without a common key, with a confidence.

Sorted neighbourhood: every row stands in several orders, by composite keys of name, place and county; within a sliding
window of each order, rows are compared by weighted similarities of their fields. Records of one thing are made classes, and
classes and entities are assigned one to one at the highest total confidence.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.quadtree import morton
from cairn.llm.edits import Words
from cairn.llm.names import BYNAMES, parse, slips
from cairn.llm.variants import county_key
from cairn.operators.graph import components
from cairn.operators.proximity import repaired
from cairn.session import cut, plain, written

WINDOW = 12
#: Least confidence of a match.
LEAST = 0.5
_COLUMNS = "side int, id string, region string, core string, kind string, qualifiers string, lat double, lon double, county string"
_EARTH_KM = 6371.0


def profiles(rows: DataFrame, side: int) -> DataFrame:
    """One row for each entity and name: rows(id, region, name, lat, lon, county), its place and county gathered over its rows."""
    lat, lon = repaired(F.col("lat"), F.col("lon"))
    base = rows.where("region is not null and id is not null").select("id", "region", "name", lat.alias("lat"), lon.alias("lon"), county_key(F.col("county")).alias("county"))
    about = base.groupBy("id", "region").agg(F.percentile_approx("lat", 0.5).alias("lat"), F.percentile_approx("lon", 0.5).alias("lon"), F.min("county").alias("county"))
    named = base.select("id", "region", "name").distinct().join(about, ["id", "region"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [parse(n if isinstance(n, str) else None) for n in b["name"]]
            out = pd.DataFrame({"side": side, "id": b["id"], "region": b["region"], "core": [x.core for x in p], "kind": [x.kind for x in p], "qualifiers": [" ".join(x.qualifiers) for x in p]})
            yield out.assign(lat=b["lat"], lon=b["lon"], county=b["county"])

    return named.mapInPandas(run, _COLUMNS).distinct()


def _keys(b: pd.DataFrame) -> list[tuple[str, pd.Series]]:
    """The orders: name, name from its end, consonants with county, place."""
    region, core = b["region"], b["core"]
    name = region + "|" + core + "|" + b["qualifiers"] + "|" + b["kind"]
    back = region + "|" + core.str[::-1] + "|" + b["qualifiers"] + "|" + b["kind"]
    bones = region + "|" + core.str.slice(0, 1) + core.str.slice(1).str.replace("[aeiouyhw]", "", regex=True).str.replace(r"(.)\1+", r"\1", regex=True) + "|" + b["county"].fillna("")
    placed = b["lat"].notna() & b["lon"].notna()
    code = morton(b["lat"].fillna(0).to_numpy(float), b["lon"].fillna(0).to_numpy(float))
    fine = pd.Series([f"{c:010d}" for c in code], index=b.index) + b["lat"].map("{:.5f}".format)
    place = (region + "|" + fine).where(placed)
    shifted = morton(np.clip(b["lat"].fillna(0).to_numpy(float) + 0.02, -90, 90), b["lon"].fillna(0).to_numpy(float) + 0.02)
    other = (region + "|" + pd.Series([f"{c:010d}" for c in shifted], index=b.index) + b["lat"].map("{:.5f}".format)).where(placed)
    has = core != ""
    return [("name", name.where(has)), ("back", back.where(has)), ("bones", bones.where(has)), ("place", place), ("other", other)]


class _Side:
    """Profiles as arrays, worked out once for all the pairs of a batch."""

    def __init__(self, b: pd.DataFrame):
        code = lambda c: pd.factorize(b[c].to_numpy(object))
        self.core, names = code("core")
        self.words = Words([*map(str, names)])
        self.own = b["core"].to_numpy(object) != ""
        self.kind, kinds = code("kind")
        self.byname, self.bare = np.isin(kinds.astype(str), BYNAMES)[self.kind], (kinds == "")[self.kind]
        self.qualifiers, _ = code("qualifiers")
        self.county, counties = code("county")  # -1: none
        self.counties = Words([*map(str, counties)])
        self.lat, self.lon = np.radians(b["lat"].to_numpy(float)), np.radians(b["lon"].to_numpy(float))
        self.slips = np.fromiter(map(slips, names), np.int64, len(names))


def similarity(s: _Side, i: np.ndarray, j: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Confidence in [0, 1] that the rows i and j are one thing; 0 where names, place and county rule it out.

    alike: where both rows are records. There a place alone says nothing, as a thing of its own may stand beside another.
    """
    lat1, lon1, lat2, lon2 = s.lat[i], s.lon[i], s.lat[j], s.lon[j]
    km = np.full(len(i), np.inf)
    for sign in (1, -1):  # a longitude typed without its sign is as near as with it
        h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((sign * lon2 - lon1) / 2) ** 2
        km = np.fmin(km, 2 * _EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1))))
    placed = ~np.isnan(lat1 + lon1 + lat2 + lon2)
    near, far = placed & (km <= 8), placed & (km > 30)
    both = (s.county[i] >= 0) & (s.county[j] >= 0)
    same_county = both & (s.county[i] == s.county[j])
    k = np.flatnonzero(both & ~same_county)
    same_county[k] = s.counties.transposing(s.county[i[k]], s.county[j[k]], 1) <= 1
    other_county = both & ~same_county
    by_a, by_b = s.byname[i], s.byname[j]
    byname = by_a & ~by_b & s.own[j]  # of the record only: an entity's by-name says nothing about a record's full name
    unnamed = ~s.own[i] | ~s.own[j] | (by_a != by_b)
    open_kind, same_kind = (s.bare[i] != s.bare[j]) & ~by_a & ~by_b, s.kind[i] == s.kind[j]
    may = ~unnamed & (s.qualifiers[i] == s.qualifiers[j]) & (open_kind | same_kind)
    edits = np.where(may & (s.core[i] == s.core[j]), 0, 9)
    k = np.flatnonzero(may & (edits > 0))
    x, y = s.core[i[k]], s.core[j[k]]
    d = s.words.transposing(x, y, 3)
    longer = np.where(s.words.lengths[x] > s.words.lengths[y], x, y)
    ok = (d <= s.slips[longer]) | ((d == 3) & (s.words.lengths[x] > 6) & placed[k] & (km[k] < 1))
    edits[k] = np.where(ok, d, 9)
    place = np.where(placed, np.where(km <= 8, 1 - km / 16, np.where(far, -1.0, 0.0)), 0.0)
    county = np.where(same_county, 1.0, np.where(other_county, -1.0, 0.0))
    name = 1.0 - 0.18 * edits - np.where(open_kind, 0.1, 0.0)
    fits = np.where(edits == 0, same_kind | near | same_county | (~placed & ~other_county), np.where(edits == 1, np.where(same_kind, near | same_county | (~far & ~other_county), near | (same_county & ~far)), np.where(same_kind, near | (~placed & same_county), near & ~other_county)))
    score = np.where((edits < 9) & fits, 0.62 * name + 0.2 * place + 0.1 * county + 0.08, 0.0)
    alone = ((~s.own[i] | ~s.own[j]) & (km <= 1.5) | (byname & (km <= 0.3))) & placed & ~(other_county & (km > 0.3)) & ~alike
    return np.clip(np.where(alone, 0.75 - 0.12 * np.where(placed, km, 0.0) + 0.03 * county, score), 0.0, 1.0)


_FOUND = "record string, entity string, confidence double, alike boolean"


def _compare(b: pd.DataFrame, i: np.ndarray, j: np.ndarray, least: float) -> pd.DataFrame:
    """The pairs (i, j) of rows of b that are similar enough; of a record and an entity, or of two records (alike)."""
    side = b["side"].to_numpy()
    i, j = np.where(side[i] <= side[j], i, j), np.where(side[i] <= side[j], j, i)
    alike = side[j] == 0
    c = similarity(_Side(b), i, j, alike) if len(i) else np.zeros(0)
    keep, ids = c >= least, b["id"].to_numpy(object)
    return pd.DataFrame({"record": ids[i[keep]], "entity": ids[j[keep]], "confidence": c[keep], "alike": alike[keep]})


def candidates(records: DataFrame, entities: DataFrame, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """(record, entity, confidence, alike) of the pairs that some window holds; records and entities are profiles.

    alike: a pair of two records, `record` and `entity`, once for each window that held it; false for a record and an entity,
    of which each pair comes once. All orders are one
    range-partitioned sort. A partition compares its own rows and hands out its first and last rows, so that windows reach
    over partitions' edges. Where more rows share one key than a window holds, its records meet its entities in a join on the
    key, so a run of equal keys, whatever its length, hides none.
    """
    rows = records.unionByName(entities)
    key_schema = f"ordering string, key string, {_COLUMNS}"
    columns = ["ordering", "key", *[c.split()[0] for c in _COLUMNS.split(", ")]]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, key in _keys(b):
                yield plain(b.assign(ordering=name, key=key)[key.notna()][columns])

    every = written(rows.mapInPandas(keyed, key_schema))  # read for the ranges, for the windows and for runs of equal keys
    placed = every.repartitionByRange("ordering", "key", "id").sortWithinPartitions("ordering", "key", "id")

    def compare(b: pd.DataFrame, fresh: int) -> pd.DataFrame:
        """Pairs of b within the window, the later row at or after `fresh`."""
        left, right = [], []
        side, region, ordering = b["side"].to_numpy(), pd.factorize(b["region"].to_numpy(object))[0], pd.factorize(b["ordering"].to_numpy(object))[0]
        for step in range(1, window + 1):
            j = np.arange(max(step, fresh), len(b))
            i = j - step
            ok = ((side[i] == 0) | (side[j] == 0)) & (region[i] == region[j]) & (ordering[i] == ordering[j])
            left.append(i[ok])
            right.append(j[ok])
        i, j = (np.concatenate(x).astype(int) if x else np.zeros(0, int) for x in (left, right))
        return _compare(b, i, j, least)

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, at = None, 0
        for b in batches:
            for start in range(0, len(b), 20_000):
                piece = b.iloc[start : start + 20_000]
                if at < window:
                    yield piece.iloc[: window - at].assign(part=part, edge=0)
                at += len(piece)
                whole = piece if held is None else pd.concat([held, piece], ignore_index=True)
                yield compare(whole, 0 if held is None else len(held))
                held = whole.iloc[-window:]
        if held is not None:
            yield held.assign(part=part, edge=1)

    out = f"{_FOUND}, part int, edge int, {key_schema}"

    def padded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in out.split(", ")]
        text = [c.split()[0] for c in out.split(", ") if c.endswith(" string")]
        for f in slide(batches):
            yield plain(f.reindex(columns=names).astype({"part": "Int32", "edge": "Int32", "side": "Int32", "alike": "boolean"}), text)

    got = written(placed.mapInPandas(padded, out))
    edges = got.where("edge is not null")
    # partitions that hold rows, numbered without gaps: one row each, of as many partitions as the shuffle has
    parts = sorted(r["part"] for r in edges.select("part").distinct().collect())
    number = records.sparkSession.createDataFrame([(p, i) for i, p in enumerate(parts)], "part int, seam int")
    seams = edges.join(F.broadcast(number), "part").withColumn("seam", F.when(F.col("edge") == 1, F.col("seam")).otherwise(F.col("seam") - 1))

    def over(b: pd.DataFrame) -> pd.DataFrame:
        b = plain(b).sort_values(["edge", "ordering", "key", "id"], ascending=[False, True, True, True], ignore_index=True)
        return compare(b, int((b["edge"] == 1).sum()))

    across = seams.groupBy("seam").applyInPandas(over, _FOUND)
    names = ["record", "entity", "confidence", "alike"]
    both = got.where("record is not null").select(names).union(across).union(_tied(every, window, least))
    matches = both.where("not alike").groupBy("record", "entity").agg(F.max("confidence").alias("confidence"), F.lit(False).alias("alike"))
    return matches.select(names).union(both.where("alike"))


def _tied(every: DataFrame, window: int, least: float) -> DataFrame:
    """Records and entities that share one key of an order with more rows than a window holds."""
    run = every.groupBy("ordering", "key").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("side") == 1).alias("_e"))
    # written, so that the planner knows how few they are before it shuffles every row for them
    long = written(run.where(F.col("_n") > window).where("_e > 0 and _e < _n").select("ordering", "key"))
    crowded = every.join(long, ["ordering", "key"])
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    a = crowded.where("side = 0").select("ordering", "key", F.struct(*names).alias("a"))
    b = crowded.where("side = 1").select("ordering", "key", F.struct(*names).alias("b"))
    met = a.join(b, ["ordering", "key"]).where("a.region = b.region")
    flat = met.select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in names])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m in batches:
            n = len(m)
            sides = [m[[f"{c}_{x}" for c in names]].set_axis(names, axis=1) for x in "ab"]
            yield plain(_compare(pd.concat(sides, ignore_index=True), np.arange(n), np.arange(n, 2 * n), least))

    return flat.mapInPandas(compare, _FOUND)


def best_matches(pairs: DataFrame) -> DataFrame:
    """(record, entity, confidence): of each record the entity of highest confidence, on a tie the smallest id."""
    best = pairs.groupBy("record").agg(F.min(F.struct((-F.round("confidence", 6)).alias("c"), "entity")).alias("b"))
    return best.select("record", F.col("b.entity").alias("entity"), (-F.col("b.c")).alias("confidence"))


def assign(pairs: list[list[tuple[int, float]]]) -> list[tuple[int, int]]:
    """One-to-one pairs (i, j) of highest total weight; pairs[i] holds i's possible (j, weight > 0), and i may stay alone.

    Shortest augmenting paths over the given pairs alone, with prices: each i in turn takes the cheapest way to a free j, or
    to leaving some i on the way alone.
    """
    price: dict[tuple[int, int], float] = {}
    holder: dict[tuple[int, int], int] = {}
    # (0, j): a partner; (1, i): staying alone
    ways = [[((0, j), -w) for j, w in p] + [((1, i), 0.0)] for i, p in enumerate(pairs)]
    cost = [dict(w) for w in ways]
    for start in range(len(pairs)):
        far: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], int] = {}
        done: dict[tuple[int, int], float] = {}
        heap: list[tuple[float, tuple[int, int]]] = []
        at, base = start, 0.0
        while True:
            for j, c in ways[at]:
                d = base + c - price.get(j, 0.0)
                if j not in done and d < far.get(j, math.inf):
                    far[j], back[j] = d, at
                    heapq.heappush(heap, (d, j))
            d, j = heapq.heappop(heap)
            while j in done:
                d, j = heapq.heappop(heap)
            if j not in holder:
                break
            done[j] = d
            at = holder[j]
            base = d - (cost[at][j] - price.get(j, 0.0))
        for k, dk in done.items():
            price[k] = price.get(k, 0.0) + dk - d
        held = {i: k for k, i in holder.items() if k in done}
        while True:
            i = back[j]
            holder[j] = i
            if i == start:
                break
            j = held[i]
    return sorted((i, j) for (alone, j), i in holder.items() if not alone)


#: Most pairs of one component of contested pairs that one task solves (about 1 GB); more are an error, never another method.
MOST_PAIRS = 5_000_000


def one_to_one(pairs: DataFrame) -> DataFrame:
    """(record, entity, confidence): no record and no entity twice, of highest total confidence over all pairs.

    Pairs of a confidence above 0; repeated pairs count once, with the highest. A pair whose record and entity have no other is
    taken as it is; the others are solved component by component with shortest augmenting paths, exactly at any size.
    """
    p = cut(pairs.where("confidence > 0").groupBy("record", "entity").agg(F.max("confidence").alias("confidence")))
    more = lambda side: p.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(side)
    # contested: some pair of the record, or of the entity, isn't the only one
    marked = p.join(more("record").withColumn("_r", F.lit(1)), "record", "left").join(more("entity").withColumn("_e", F.lit(1)), "entity", "left")
    touched = marked.where("_r is not null or _e is not null").select("record", "entity", "confidence")
    sole = marked.where("_r is null and _e is null").select("record", "entity", "confidence")
    contested = cut(touched)
    if contested.isEmpty():
        return sole
    nodes = components(contested.select(F.concat(F.lit("r"), "record").alias("src"), F.concat(F.lit("e"), "entity").alias("dst")))
    of = nodes.where("node like 'r%'").select(F.expr("substring(node, 2)").alias("record"), "component")
    tagged = contested.join(of, "record")
    largest = tagged.groupBy("component").count().agg(F.max("count")).first()[0]
    if largest > MOST_PAIRS:
        raise ValueError(f"a component of {largest} contested pairs; the bound is {MOST_PAIRS}")

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        r, records = pd.factorize(b["record"], sort=True)
        e, entities = pd.factorize(b["entity"], sort=True)
        ways: list[list[tuple[int, float]]] = [[] for _ in records]
        for i, j, w in zip(r.tolist(), e.tolist(), b["confidence"].tolist(), strict=True):
            ways[i].append((j, w))
        return pd.DataFrame([(records[i], entities[j], dict(ways[i])[j]) for i, j in assign(ways)], columns=["record", "entity", "confidence"])

    return sole.union(tagged.groupBy("component").applyInPandas(solve, "record string, entity string, confidence double"))


#: From this confidence on, records of one best entity are one class; a weaker one joins it through a record it resembles.
SURE = 0.65


def classes(pairs: DataFrame) -> DataFrame:
    """(record, class): records of one thing, from the pairs of candidates().

    Records whose best entity is one and the same are one class if they are sure of it, or resemble a record that is. A record
    that is neither is a class of its own, and must stand up for its entity alone.
    """
    best = written(best_matches(pairs.where("not alike")))
    sure = best.where(F.col("confidence") >= SURE).select("record", "entity")
    weak = best.where(F.col("confidence") < SURE).select("record", "entity")
    alike = pairs.where("alike").select(F.col("record").alias("a"), F.col("entity").alias("b"))
    links = alike.union(alike.select("b", "a"))
    joined = weak.join(links, F.col("record") == F.col("a")).select("record", "entity", "b").join(sure.select(F.col("record").alias("b"), "entity"), ["b", "entity"]).select("record", "entity").distinct()
    alone = weak.join(joined, ["record", "entity"], "left_anti")
    return sure.union(joined).select("record", F.concat(F.lit("e"), "entity").alias("class")).union(alone.select("record", F.concat(F.lit("r"), "record").alias("class")))


def record_profiles(records: DataFrame) -> DataFrame:
    bearer = F.coalesce(F.concat(F.lit("k:"), "rec_key"), F.concat(F.lit("r:"), F.col("record_id").cast("string")))
    return profiles(records.select(bearer.alias("id"), "region", "name", "lat", "lon", "county"), 0)


def tower_profiles(towers: DataFrame) -> DataFrame:
    names = F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("other_names", F.array()))))
    return profiles(towers.select("id", "region", names.alias("name"), F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"), "county"), 1)


def match_records(records: DataFrame, towers: DataFrame) -> DataFrame:
    """(record_id, tower_id, confidence) of every record whose class of records is assigned to a tower.

    Classes of records and towers are paired one to one at the highest total confidence, and a class's records all get its
    tower. Deliveries of one rec_key are matched as one and come out one by one, repeated rows repeatedly; a record without
    region has no match. confidence: the record's own with the tower, or its class's where it has none.
    """
    pairs = written(candidates(record_profiles(records), tower_profiles(towers)))
    of = written(classes(pairs))
    own = pairs.where("not alike").select("record", "entity", F.round("confidence", 6).alias("confidence"))
    of_class = own.join(of, "record").groupBy(F.col("class").alias("record"), "entity").agg(F.max("confidence").alias("confidence"))
    paired = one_to_one(of_class).select(F.col("record").alias("class"), "entity", F.col("confidence").alias("_of_class"))
    found = of.join(paired, "class").join(own, ["record", "entity"], "left").select("record", "entity", F.coalesce("confidence", "_of_class").alias("confidence"))
    bearer = F.coalesce(F.concat(F.lit("k:"), "rec_key"), F.concat(F.lit("r:"), F.col("record_id").cast("string")))
    return records.select("record_id", bearer.alias("record")).join(found, "record").select("record_id", F.col("entity").alias("tower_id"), "confidence")
