"""Queries of designs, georeferences, naming, further rules, sets and small views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import designs, geo
from cairn.operators import audit, places
from cairn.plans.entities import _DIST, _KEY, _boxes, _key
from cairn.session import table
from cairn.vocab import COUNTRIES, MATERIALS, VERIFICATIONS

OWNERSHIPS = ("federal", "state", "tribal", "private", "unknown")


def _r(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_record")


def _t(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tower")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf).where("location.lat is not null and location.lon is not null").select("id", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))


FAMILY = {"aermotor_mc39": "aermotor", "aermotor_ls40": "aermotor"}
PARTS = {"cab": ("l4", "d6", "r6"), "tower": ("aermotor", "r6_timber_towers"), "whole": ("cdf_809r",)}


def design_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """F-21, F-22, U-09: designs that towers' fields name, and what they make together."""
    m = designs.mentions(F.concat_ws(" with ", "design", "status_note", "name"))
    found = _t(spark, sf).select("id", m.alias("m")).where("size(m) > 0")
    ids = designs.most_specific(designs.with_families(F.transform("m", lambda x: x.design), FAMILY), FAMILY)
    return found.select("id", F.array_join(F.transform("m", lambda x: x.design), ",").alias("designs"), F.array_join(F.transform("m", lambda x: x.words), ",").alias("words"), designs.pair(ids, PARTS)["cab"].alias("cab"))


def mention_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """A-26: pages of each source, read ones, and those that name a design."""
    d = table(spark, sf, "documents").select("source", "text", F.size(designs.mentions(F.col("text"))).alias("n"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.count("text").alias("read"), F.count_if(F.col("n") > 0).alias("with_mentions"))


def georeferences(spark: SparkSession, sf: str) -> DataFrame:
    """G-26: keys made up for each county, UTM or of their own."""
    n = F.pmod(F.xxhash64("county_id"), F.lit(6))
    zone = F.floor((F.col("lon") + 180) / 6) + 1
    utm = F.create_map(F.lit(1024), F.lit(1.0), F.lit(3072), 26700.0 + zone)
    own = F.create_map(F.lit(1024), F.lit(1.0), F.lit(2048), F.lit(4267.0), F.lit(3075), F.lit(22.0), F.lit(3080), F.round("lon", 0), F.lit(3082), F.lit(1000.0), F.lit(3076), F.lit(9002.0))
    keys = F.when(n < 2, utm).when(n < 4, own).when(n == 4, F.create_map(F.lit(1024), F.lit(2.0))).otherwise(F.create_map(F.lit(1024), F.lit(1.0), F.lit(3072), F.lit(5070.0)))
    c = table(spark, sf, "county").select("county_id", "lat", "lon", keys.alias("keys"), F.when(n < 2, "utm").when(n < 4, "own").otherwise("none").alias("given"))
    return c.select("county_id", "given", geo.georeference(F.col("keys"), F.col("lat"), F.col("lon")).alias("g")).select("county_id", "given", "g.kind", "g.shift", "g.lon0", "g.k0", F.round("g.east", 4).alias("east"), "g.unsupported")


def named_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """J-13: towers as summits, records with a position as symbols, hidden towers as what is taken."""
    t = _t(spark, sf)
    summits = t.where("location.lat is not null").select(F.col("id").alias("summit"), "region", F.coalesce(_key("name"), F.lit("")).alias("name_key"), F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))
    unplaced = _r(spark, sf).where("lat is null").select(F.col("record_id").alias("key"), "region", F.coalesce(_key("name"), F.lit("")).alias("name_key"))
    symbols = _r(spark, sf).where("lat is not null").select(F.col("record_id").alias("symbol"), "lat", "lon")
    taken = t.where("hidden and location.lat is not null").select(F.col("id").alias("place"), F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))
    return places.named_by_summits(unplaced, summits, symbols, taken)


def further_rules(spark: SparkSession, sf: str) -> DataFrame:
    """V-01, F-55"""
    b = _boxes(spark, sf).groupBy("country").agg(F.collect_list(F.struct("lat0", "lat1", "lon0", "lon1")).alias("_boxes"))
    t = _t(spark, sf).join(F.broadcast(b), "country", "left")  # a row for each country
    return audit.violations(t, "id", audit.record_rules(F.col("_boxes"), COUNTRIES, OWNERSHIPS, MATERIALS, VERIFICATIONS))


def vector_distances(spark: SparkSession, sf: str) -> DataFrame:
    """G-02, G-06: from each tower to the middle of the land, and the size of a pixel there."""
    d = geo.vector_distance(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(-110.0))
    return _points(spark, sf).select("id", F.round(d, 2).alias("metres"), F.round(geo.pixel_metres(F.col("lat"), 12), 6).alias("pixel"))


def visible_targets(spark: SparkSession, sf: str) -> DataFrame:
    """P-16: other towers farther than 150 m and within 20 km."""
    p = _points(spark, sf)
    near = places.within(p, p.withColumnRenamed("id", "target"), 20_000.0, "id", "target").where("metres > 150 and id <> target")
    return near.select("id", "target", F.round("metres", 3).alias("metres"))


def smoke_sites(spark: SparkSession, sf: str) -> DataFrame:
    """M-03: counties as ground that the two first towers of their region see."""
    w = W.partitionBy("region").orderBy("id")
    t = _t(spark, sf).where("location.lat is not null and location.lon is not null").select("region", F.col("location.lat").alias("lat1"), F.col("location.lon").alias("lon1"), F.lead("location.lat").over(w).alias("lat2"), F.lead("location.lon").over(w).alias("lon2"), F.row_number().over(w).alias("n"))
    pair = t.where("n = 1 and lat2 is not null").select(F.col("region").alias("pair"), "lat1", "lon1", "lat2", "lon2")
    grid = F.explode(F.sequence(F.lit(-20), F.lit(20))).alias
    cells = pair.select("pair", "lat1", "lon1", grid("i")).select("pair", "lat1", "lon1", "i", grid("j")).select("pair", (F.col("lat1") + F.col("i") * 0.01).alias("lat"), (F.col("lon1") + F.col("j") * 0.01).alias("lon"), F.lit(2).alias("seen_by"))
    return places.smoke_sites(cells, pair).select("pair", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def stories_and_towers(spark: SparkSession, sf: str) -> DataFrame:
    """J-05: towers without a story, and stories of towers that are hidden or none."""
    told = table(spark, sf, "documents").where("source = 'story' and tower_id is not null").select("tower_id").distinct()
    t = _t(spark, sf).where("not hidden").select(F.col("id").alias("tower_id"), F.lit(1).alias("t"))
    return t.join(told.withColumn("s", F.lit(1)), "tower_id", "full_outer").where("t is null or s is null").select("tower_id", F.when(F.col("s").isNull(), "no story").otherwise("no tower").alias("what"))


def picked_places(spark: SparkSession, sf: str) -> DataFrame:
    """J-24, J-29: a person's pick of a record's position goes before the tower's own: here the first record under the tower's very name."""
    pick = _r(spark, sf).where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and name is not null").groupBy("region", "name").agg(F.min_by(F.struct("lat", "lon"), "record_id").alias("p"))
    t = _t(spark, sf).join(pick, ["region", "name"], "left")
    return t.select("id", F.coalesce("p.lat", "location.lat").alias("lat"), F.coalesce("p.lon", "location.lon").alias("lon"), F.col("p").isNotNull().alias("picked"))


def change_list(spark: SparkSession, sf: str) -> DataFrame:
    """O-08: of the changes between builds the first fifty, and how many there are more: a report."""
    from cairn.plans.entities import snapshot_changes

    c = snapshot_changes(spark, sf).select(F.concat("i", F.lit(": "), "change", F.lit(" "), "fields").alias("line"))
    first = c.orderBy("line").limit(50)
    more = c.agg(F.greatest(F.count(F.lit(1)) - 50, F.lit(0)).alias("n")).where("n > 0").select(F.concat(F.lit("...and "), F.col("n").cast("string"), F.lit(" more")).alias("line"))
    return first.union(more)


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """M-09: shape by kind, fill by status."""
    shape = F.when(F.col("k").isin("tower", "enclosed_tower", "platform"), "triangle").when(F.col("k").isin("camp", "tree", "point"), "ring").otherwise("square")
    fill = F.when(F.col("s").isin("standing", "replica"), "full").when(F.col("s").isin("gone", "ruins", "relocated"), "empty").otherwise("half")
    return table(spark, sf, "map_feature").groupBy(shape.alias("shape"), fill.alias("fill")).agg(F.count(F.lit(1)).alias("n"))


def briefs(spark: SparkSession, sf: str) -> DataFrame:
    """R-05: a tower's brief, without what is empty."""
    names = F.when(F.size("other_names") > 0, F.col("other_names"))
    return _t(spark, sf).select("id", F.to_json(F.struct("id", "name", names.alias("other_names"), "region", "status", "height_m")).alias("brief"))


def whole_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """F-61: an altitude in half metres rounded as pages, as reports and as terrain do."""
    x = F.floor("elevation_m") + 0.5
    return _t(spark, sf).where("elevation_m is not null").select("id", F.floor(x + 0.5).alias("up"), F.bround(x, 0).cast("bigint").alias("even"), F.round(x, 0).cast("bigint").alias("away"))


def survey_rows(spark: SparkSession, sf: str) -> DataFrame:
    """P-19: rows of the survey (source surveycards) that no bulk register has under their name."""
    name = lambda d: d.select("region", _key("name").alias("k")).where("k <> ''")
    bulk = name(_r(spark, sf).where("source in ('natreg', 'oldreg', 'stateroll')")).distinct()
    mine = _r(spark, sf).where("source = 'surveycards'").select("record_id", "region", _key("name").alias("k"))
    return mine.join(bulk, ["region", "k"], "left_anti").select("record_id")


def credits_of_licences(spark: SparkSession, sf: str) -> DataFrame:
    """A-10, M-13: licences of sources, with the sources under each."""
    return table(spark, sf, "source_info").groupBy("license").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("|", F.array_sort(F.collect_set("source"))).alias("sources"))


QUERIES = {
    f.__name__: f
    for f in (
        design_mentions, mention_statistics, georeferences, named_symbols, further_rules, vector_distances, visible_targets, smoke_sites, stories_and_towers, picked_places, change_list, markers, briefs, whole_numbers,
        survey_rows, credits_of_licences,
    )
}

_P = "p as (select id, location.lat as lat, location.lon as lon from tower where location.lat is not null and location.lon is not null)"
_BX = "bx as (select country, y0 as a0, y1 as a1, x0 as o0, x1 as o1 from region_polygon join (select distinct region, country from county) on code = region)"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_RULES = {
    "id is too long": ("error", "length(id) > 120"), "id country differs from country": ("error", "split_part(id, '-', 1) <> lower(country)"), "country is not one covered": ("error", "coalesce(country not in ('US', 'CA'), true)"),
    "coordinates are outside the country": ("error", "location.lat is not null and location.lon is not null and not exists (select 1 from bx where bx.country = tower.country and tower.location.lat between a0 and a1 and tower.location.lon between o0 and o1)"),
    "ownership is not in the vocabulary": ("error", f"coalesce(ownership not in {_IN(OWNERSHIPS)}, true)"), "verification is not in the vocabulary": ("error", f"coalesce(verification not in {_IN(VERIFICATIONS)}, true)"),
    "material is not in the vocabulary": ("error", f"material not in {_IN(MATERIALS)}"), "status_note is neither null nor text": ("error", "trim(status_note) = ''"), "elevation_m is not a number": ("error", "isnan(elevation_m)"), "height_m is not a number": ("error", "isnan(height_m)"),
    "hidden is not true or false": ("error", "hidden is null"), "other_names is not a list": ("error", "other_names is null"), "other_names is malformed": ("error", "len(list_filter(other_names, lambda x: coalesce(trim(x), '') = '')) > 0"),
    "locked is not a list": ("error", "locked is null"), "approximate but held for verified": ("warning", "location.approximate and verification <> 'unverified'"),
}
_BEAR = "((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360) % 360)"

ORACLE: dict[str, str] = {
    # towers name no design but L-4, D-6 and plans without a pattern; a name holds none
    "design_mentions": r"with m as (select id, list_filter([case when regexp_matches(concat_ws(' with ', design, status_note, name), '(?i)\bL[\s.-]?4\b') then 'l4' end, case when regexp_matches(concat_ws(' with ', design, status_note, name), '(?i)\bD[\s.-]?6\b') then 'd6' end], lambda x: x is not null) as d from tower) select id, array_to_string(d, ',') as designs, array_to_string(list_transform(d, lambda x: case x when 'l4' then 'L-4' else 'D-6' end), ',') as words, case when len(d) = 1 then d[1] end as cab from m where len(d) > 0",
    "named_symbols": f"""with s as (select id as summit, region, coalesce({_KEY.format('name')}, '') as k, location.lat as lat, location.lon as lon from tower where location.lat is not null), u as (select record_id as key, region, coalesce({_KEY.format('name')}, '') as k from source_record where lat is null),
 y as (select record_id as symbol, lat, lon from source_record where lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)), o as (select key, min(summit) as summit, any_value(u.k) as k from u join s using (region, k) where u.k <> '' group by key having count(distinct summit) = 1),
 b as (select s.summit, min(symbol) as symbol from s join y on abs(s.lat - y.lat) < 0.03 where s.summit in (select summit from o) and s.lon is not null and {_DIST.format(a='s.lat', b='s.lon', c='y.lat', d='y.lon')} <= 2000 group by 1 having count(distinct symbol) = 1),
 x as (select distinct y.symbol from y join tower t on abs(y.lat - t.location.lat) < 0.01 where t.hidden and {_DIST.format(a='y.lat', b='y.lon', c='t.location.lat', d='t.location.lon')} <= 500)
 select symbol, min(key) as key, count(distinct key) as names from o join b using (summit) where symbol not in (select symbol from x) group by symbol having count(distinct k) = 1""",
    "further_rules": f"with {_BX} " + " union all ".join(f"select id, '{lv}' as level, '{m}' as message from tower where {c}" for m, (lv, c) in _RULES.items()),
    "vector_distances": f"with {_P} select id, round({_DIST.format(a='lat', b='lon', c='45.0', d='-110.0')}, 2) as metres, round(cos(radians(lat)) * 2 * pi() * 6371008.8 / (256 * 4096), 6) as pixel from p",
    "visible_targets": f"with {_P}, d as (select a.id, b.id as target, {_DIST.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} as m from p a join p b on a.id <> b.id and abs(a.lat - b.lat) < 0.3) select id, target, round(m, 3) as metres from d where m > 150 and m <= 20000",
    "smoke_sites": f"""with t as (select region as pair, location.lat as lat1, location.lon as lon1, lead(location.lat) over w as lat2, lead(location.lon) over w as lon2, row_number() over w as n from tower where location.lat is not null and location.lon is not null window w as (partition by region order by id)),
 c as (select pair, lat1, lon1, lat2, lon2, lat1 + i * 0.01 as lat, lon1 + j * 0.01 as lon from t, (select unnest(range(-20, 21)) as i), (select unnest(range(-20, 21)) as j) where n = 1 and lat2 is not null),
 f as (select *, {_DIST.format(a='lat1', b='lon1', c='lat', d='lon')} as d1, {_DIST.format(a='lat2', b='lon2', c='lat', d='lon')} as d2, {_BEAR.format(a='lat', b='lon', c='lat1', d='lon1')} as b1, {_BEAR.format(a='lat', b='lon', c='lat2', d='lon2')} as b2 from c),
 g as (select * from f where d1 between 4000 and 28000 and d2 between 4000 and 28000 and abs((b1 - b2 + 540) % 360 - 180) between 35 and 145) select pair, round(lat, 6) as lat, round(lon, 6) as lon from g qualify count(*) over (partition by pair) >= 10""",
    "stories_and_towers": "with s as (select distinct tower_id from documents where source = 'story' and tower_id is not null), t as (select id as tower_id from tower where not hidden) select tower_id, 'no story' as what from t where tower_id not in (select tower_id from s) union all select tower_id, 'no tower' from s where tower_id not in (select tower_id from t)",
    "picked_places": "with k as (select region, name, arg_min(struct_pack(lat := lat, lon := lon), record_id) as p from source_record where lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and name is not null group by 1, 2) select id, coalesce(p.lat, location.lat) as lat, coalesce(p.lon, location.lon) as lon, p is not null as picked from tower t left join k using (region, name)",
    "markers": "select case when k in ('tower', 'enclosed_tower', 'platform') then 'triangle' when k in ('camp', 'tree', 'point') then 'ring' else 'square' end as shape, case when s in ('standing', 'replica') then 'full' when s in ('gone', 'ruins', 'relocated') then 'empty' else 'half' end as fill, count(*) as n from map_feature group by 1, 2",
    "whole_numbers": "select id, floor(elevation_m)::bigint + 1 as up, case when floor(elevation_m)::bigint % 2 = 0 then floor(elevation_m)::bigint else floor(elevation_m)::bigint + 1 end as even, case when elevation_m >= 0 then floor(elevation_m)::bigint + 1 else floor(elevation_m)::bigint end as away from tower where elevation_m is not null",
    "survey_rows": f"with b as (select distinct region, {_KEY.format('name')} as k from source_record where source in ('natreg', 'oldreg', 'stateroll') and {_KEY.format('name')} <> '') select record_id from source_record r where source = 'surveycards' and not exists (select 1 from b where b.region = r.region and b.k = {_KEY.format('r.name')})",
    "credits_of_licences": "select license, count(*) as n, string_agg(distinct source, '|' order by source) as sources from source_info group by 1",
}
