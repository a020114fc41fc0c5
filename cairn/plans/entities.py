"""Queries of joins, audits, windows, sets, entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import mining as M
from cairn.functions import text as T
from cairn.operators import audit, graph, places, resolve
from cairn.session import table
from cairn.vocab import KINDS, STATUSES

_US = "lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)"


def _r(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_record")


def _t(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tower")


def _key(c: str):
    return F.regexp_replace(F.lower(T.unaccent(F.col(c))), "[^a-z]", "")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf).select("id", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))


def first_address_join(spark: SparkSession, sf: str) -> DataFrame:
    """J-01: customers with their first order, if any."""
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return c.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "first_order")


def activity_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """J-02: records of a source with some restored event."""
    e = _r(spark, sf).select("record_id", F.explode("events").alias("x")).where("x.event = 'restored'").select("record_id")
    return _r(spark, sf).select("record_id", "source").join(e, "record_id", "left_semi")


def dangling_towers(spark: SparkSession, sf: str) -> DataFrame:
    """J-04, V-04: features of the map whose tower is none, or is hidden."""
    shown = _t(spark, sf).where("not coalesce(hidden, false)").select(F.col("id").alias("i"))
    return table(spark, sf, "map_feature").where("i is not null").join(shown, "i", "left_anti").select("feature_id", "i")


def unmatched_counties(spark: SparkSession, sf: str) -> DataFrame:
    """V-11: counties of records that the list of counties lacks, with the number of records."""
    c = table(spark, sf, "county").select("region", _key("name").alias("ck")).distinct()
    r = _r(spark, sf).where("county is not null").select("region", _key("county").alias("ck"))
    return r.join(c, ["region", "ck"], "left_anti").groupBy("region", "ck").agg(F.count(F.lit(1)).alias("n"))


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of the regions with their countries."""
    b = table(spark, sf, "region_polygon").select(F.col("code").alias("region"), F.col("y0").alias("lat0"), F.col("y1").alias("lat1"), F.col("x0").alias("lon0"), F.col("x1").alias("lon1"))
    return b.join(table(spark, sf, "county").select("region", "country").distinct(), "region")


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    """Records against those of towers and ground cabs as what entities hold: hidden when gone, approximate without a position."""
    held = _r(spark, sf).where("kind in ('tower', 'ground')").select("rec_key", (F.col("status") == "gone").alias("hidden"), F.col("lat").isNull().alias("approximate"))
    return audit.coverage(_r(spark, sf).select("record_id", "source", "rec_key", "name", "country", "region", "lat", "lon"), held, _boxes(spark, sf))


def audit_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """V-06, A-01, J-03"""
    return audit.coverage_report(_audited(spark, sf))


def not_held(spark: SparkSession, sf: str) -> DataFrame:
    """O-02: sorted by source, region, name and key."""
    return _audited(spark, sf).where("not held").select("source", F.coalesce("region", F.lit("")).alias("region"), F.coalesce("name", F.lit("")).alias("name"), "rec_key", "record_id", "reason").orderBy("source", "region", "name", "rec_key", "record_id")


def validate_towers(spark: SparkSession, sf: str) -> DataFrame:
    return audit.violations(_t(spark, sf), "id", audit.tower_rules(STATUSES, KINDS))


def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    """V-04: record keys of one region under one name, but for the words any lookout may have."""
    return _r(spark, sf).groupBy("region", resolve.name_key(F.col("name")).alias("name_key")).agg(F.count_distinct("rec_key").alias("n")).where("n > 1")


def story_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    return audit.footnotes(table(spark, sf, "documents")).select("doc_id", F.array_join(F.transform("undefined", lambda x: x.cast("string")), ",").alias("undefined"), F.array_join(F.transform("unused", lambda x: x.cast("string")), ",").alias("unused"))


def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    """J-30: map builds before and after 2024, the latest feature of each tower compared."""
    f = table(spark, sf, "map_feature")
    last = lambda d: d.groupBy("i").agg(F.max(F.struct("built_at", "feature_id", "s", "v", "b")).alias("x")).select("i", "x.s", "x.v", "x.b")
    return audit.snapshot_diff(last(f.where("built_at < timestamp_ntz'2024-01-01'")), last(f.where("built_at >= timestamp_ntz'2024-01-01'")), "i", ["s", "v", "b"])


def _tiered(rows: DataFrame) -> DataFrame:
    registers, kinds = F.transform("registers", lambda x: x.register), F.transform("links", lambda x: x.kind)
    t = audit.tier(F.coalesce("rental.available", F.lit(False)), F.col("status"), F.col("kind"), F.col("country"), registers, kinds, F.col("lat").isNull(), gone_all=True)
    return rows.withColumn("tier", t)


def research_queue(spark: SparkSession, sf: str) -> DataFrame:
    """R-03, R-04, O-03: keys by tier, then most deliveries, most links, key; without those that have been restored, as what is researched already."""
    last = F.max_by(F.struct("rental", "status", "kind", "country", "registers", "links", "lat", "events"), "record_id").alias("x")
    keys = _r(spark, sf).where("rec_key is not null").groupBy("rec_key").agg(last, F.count(F.lit(1)).alias("sources")).select("rec_key", "sources", "x.*")
    done = keys.where(F.exists("events", lambda e: e.event == "restored")).select("rec_key")
    queue = _tiered(keys).join(done, "rec_key", "left_anti").where("tier is not null")
    return queue.select("tier", "sources", F.coalesce(F.size("links"), F.lit(0)).alias("n_links"), "rec_key").orderBy("tier", F.desc("sources"), F.desc("n_links"), "rec_key")


def tier_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """A-15"""
    return _tiered(_r(spark, sf)).rollup("country", "region", "tier").agg(F.count(F.lit(1)).alias("n"))


def repeat_keys(spark: SparkSession, sf: str) -> DataFrame:
    """W-10: repeated keys numbered key, key:1, key:2."""
    n = F.row_number().over(W.partitionBy("rec_key").orderBy("record_id")) - 1
    return _r(spark, sf).select("record_id", F.when(n > 0, F.concat_ws(":", "rec_key", n.cast("string"))).otherwise(F.col("rec_key")).alias("numbered"))


def reprint_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """W-07: of each exact text the oldest document, null dates last. Texts meet by their digest, so none is shuffled."""
    first = F.min(F.struct(F.coalesce("loaded_at", F.lit("9999-01-01").cast("timestamp_ntz")).alias("at"), "doc_id")).alias("m")
    d = table(spark, sf, "documents").where("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(first, F.count(F.lit(1)).alias("copies"))
    return d.select(F.col("m.doc_id").alias("doc_id"), "copies")


#: Records of one source and region that are filled in one go.
_FILL = 1_000_000


def heading_fill(spark: SparkSession, sf: str) -> DataFrame:
    """W-12: the last register number seen before each delivery of a source and region.

    Filled within blocks of records; what a block ends with is carried on over the blocks, so no source or region is one task.
    """
    number = F.get("registers", F.lit(0))["number"]
    r = _r(spark, sf).select("record_id", "source", "region", number.alias("n"), F.floor(F.col("record_id") / _FILL).alias("block"))
    w = W.partitionBy("source", "region", "block").orderBy("record_id").rowsBetween(W.unboundedPreceding, 0)
    ends = r.groupBy("source", "region", "block").agg(F.max_by("n", F.when(F.col("n").isNotNull(), F.col("record_id"))).alias("end"))
    over = W.partitionBy("source", "region").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col("source").alias("s"), F.col("region").alias("g"), F.col("block").alias("b"), F.last("end", ignorenulls=True).over(over).alias("carried"))
    filled = r.withColumn("own", F.last("n", ignorenulls=True).over(w))
    return filled.join(carried, F.col("source").eqNullSafe(F.col("s")) & F.col("region").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))).select("record_id", "source", "region", F.coalesce("own", "carried").alias("heading"))


def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    """J-10: source records within 500 m of a tower."""
    return places.within(_r(spark, sf).select("record_id", "lat", "lon"), _points(spark, sf), 500.0, "record_id", "id").select("record_id", "id", F.round("metres", 3).alias("metres"))


def nearest_towers(spark: SparkSession, sf: str) -> DataFrame:
    """M-01: the four nearest other towers of each, farther than 200 m, within 30 km."""
    return places.nearest(_points(spark, sf), _points(spark, sf).withColumnRenamed("id", "other"), 30_000.0, 4, "id", "other", 200.0).select("id", "other", F.round("metres", 3).alias("metres"), "place")


def band_partners(spark: SparkSession, sf: str) -> DataFrame:
    """M-02: standing towers with two standing partners or more at 12 to 32 km."""
    p = _t(spark, sf).where("status = 'standing' and not coalesce(location.approximate, false)").select("id", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))
    near = places.within(p, p.withColumnRenamed("id", "other"), 32_000.0, "id", "other").where("metres >= 12000 and id <> other")
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("partners")).where("partners >= 2")


def box_join(spark: SparkSession, sf: str) -> DataFrame:
    """J-09: towers in their regions' boxes, and in others'."""
    b = table(spark, sf, "region_polygon").select("code", F.col("y0").alias("lat0"), F.col("y1").alias("lat1"), F.col("x0").alias("lon0"), F.col("x1").alias("lon1"))
    return places.in_boxes(_points(spark, sf), b, "id")


def coordinate_flags(spark: SparkSession, sf: str) -> DataFrame:
    """P-11, M-14"""
    b = _boxes(spark, sf).groupBy(F.col("region").alias("code")).agg(F.collect_list(F.struct("lat0", "lat1", "lon0", "lon1")).alias("boxes"))
    r = _r(spark, sf).join(F.broadcast(b), F.col("region") == F.col("code"), "left")  # a row for each region
    return r.select("record_id", places.coordinate_flag(F.col("lat"), F.col("lon"), F.col("boxes")).alias("flag")).where("flag is not null")


def gazetteer_look_up(spark: SparkSession, sf: str) -> DataFrame:
    """J-18: records without a position looked up among the towers' names as a gazetteer."""
    g = _t(spark, sf).where("location.lat is not null").select(F.col("id").alias("place_id"), "region", _key("county").alias("county_key"), _key("name").alias("name_key"))
    r = _r(spark, sf).where("lat is null or lon is null").select("record_id", "region", _key("county").alias("county_key"), F.coalesce(_key("name"), F.lit("")).alias("name_key"))
    return places.look_up(r, g, "record_id")


def redirect_closure(spark: SparkSession, sf: str) -> DataFrame:
    """J-17: a part leads to the one of half its number; those that end in 7 and 8 lead to each other, as a loop."""
    p = F.col("p_partkey")
    target = F.when(p % 10 == 7, p + 1).when(p % 10 == 8, p - 1).otherwise(F.floor(p / 2))
    return places.resolve_redirects(table(spark, sf, "part").where("p_partkey > 3").select(p.alias("src"), target.alias("dst"))).withColumnRenamed("src", "p_partkey")


def shared_points(spark: SparkSession, sf: str) -> DataFrame:
    """J-11: chains of source records within 500 m of each other, with three distinct names or more, the words fire, tower and lookout left out."""
    from cairn.operators.proximity import near_pairs

    r = _r(spark, sf)
    comp = graph.components(near_pairs(r, 500.0), "record_id_a", "record_id_b").withColumnRenamed("node", "record_id")
    core = F.trim(F.regexp_replace(F.regexp_replace(T.fold(F.col("name")), r"\b(fire|tower|lookout)\b", ""), r"\s+", " "))
    named = comp.join(r.select("record_id", core.alias("k")), "record_id")
    return named.groupBy("component").agg(F.count_distinct("k").alias("names"), F.count(F.lit(1)).alias("records")).where("names >= 3")


def greedy_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """J-12"""
    return places.collapse(_r(spark, sf), 50.0, "record_id").where("record_id <> survivor")


def resolution(spark: SparkSession, sf: str) -> DataFrame:
    """J-21: the cascade's stages over all record keys, against the towers; every delivery's names and register numbers count."""
    number = F.explode_outer(F.array_compact(F.transform("registers", lambda y: y.number))).alias("number")
    flat = _r(spark, sf).where("rec_key is not null").select(F.col("rec_key").alias("key"), "record_id", "source", "country", "region", _key("county").alias("county_key"), resolve.name_key(F.col("name")).alias("name_key"), F.when(F.expr(_US), F.struct("lat", "lon")).alias("p"), number)
    rec = flat.groupBy("key").agg(
        F.max_by(F.struct("source", "country", "region", "county_key"), "record_id").alias("x"), F.min("p").alias("p"),
        F.array_sort(F.collect_set(F.nullif("name_key", F.lit("")))).alias("name_keys"), F.array_sort(F.collect_set("number")).alias("registers"),
    ).select("key", "x.*", "name_keys", "p.lat", "p.lon", "registers")
    tow = _t(spark, sf).select(F.col("id").alias("tower"), "country", "region", _key("county").alias("county_key"), resolve.name_key(F.col("name")).alias("name_key"), F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"), F.col("location.approximate").alias("approximate"), F.array().cast("array<string>").alias("registers"))
    return resolve.cascade(rec, tow)


def merged_fields(spark: SparkSession, sf: str) -> DataFrame:
    """E-01, E-05: one record for each key, by source order of delivery."""
    return resolve.merge_fields(_r(spark, sf).where("rec_key is not null"), "rec_key", ["kind", "status", "built", "agency", "county"], "record_id")


def lineage_verification(spark: SparkSession, sf: str) -> DataFrame:
    """E-03, E-04: regions' names by how many sources have them."""
    m = _r(spark, sf).where("name is not null").select(F.concat_ws("|", "region", T.fold(F.col("name"))).alias("g"), "source", (F.col("lat").isNull()).alias("ap"))
    return resolve.verification(m, "g", "source", "ap")


def allocated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """E-12"""
    new = _r(spark, sf).where("name is not null and region is not null and country is not null").select("record_id", "country", "region", "name")
    return resolve.allocate_ids(new, F.concat_ws("-", F.lower("country"), F.lower("region")), T.slug(F.col("name")), _t(spark, sf).select("id"), ["record_id"]).select("record_id", "id")


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """U-01, U-02: (keys standing, with rental) without rejects."""
    r = _r(spark, sf)
    a, b, c = r.where("status = 'standing'").select("rec_key"), r.where("rental is not null").select("rec_key"), r.where("kind = 'unknown'").select("rec_key")
    return a.union(b).distinct().subtract(c)


def second_without_first(spark: SparkSession, sf: str) -> DataFrame:
    """U-03"""
    r = _r(spark, sf).where("region is not null")
    one = r.where("source = 'openpins'").select("region", T.fold(F.col("name")).alias("k")).distinct()
    two = r.where("source = 'oldreg'").select("region", T.fold(F.col("name")).alias("k")).distinct()
    return one.union(two.join(one, ["region", "k"], "left_anti")).where("k is not null")


def quote_containment(spark: SparkSession, sf: str) -> DataFrame:
    """J-26, F-38: titles of documents as quotes of their own text."""
    d = table(spark, sf, "documents").where("title is not null and text is not null")
    return d.select("doc_id", T.quote_match(F.col("title"), T.quote_form(F.col("text"))).alias("match"))


def text_lines_context(spark: SparkSession, sf: str) -> DataFrame:
    """M-12: lines that mention lightning with one line around them. A text's lines are looked at where it is read."""
    lines = F.split("text", "\n")
    hit = F.transform(lines, lambda t: t.contains("lightning"))
    at = lambda i: F.coalesce(F.get("hit", i), F.lit(False))
    near = F.filter(F.sequence(F.lit(0), F.size("hit") - 1), lambda i: at(i) | at(i + 1) | F.when(i > 0, at(i - 1)).otherwise(False))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", hit.alias("hit")).select("doc_id", F.explode(near).alias("line"))


def stratified_cap(spark: SparkSession, sf: str) -> DataFrame:
    """O-06: at most three records of each region, in the order of a digest."""
    n = F.row_number().over(W.partitionBy("region").orderBy(F.sha1(F.col("record_id").cast("string").cast("binary"))))
    return _r(spark, sf).select("record_id", "region", n.alias("place")).where("place <= 3")


def top_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """A-11"""
    return _r(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(8)


def slug_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf).select("id", T.slug(F.col("name")).alias("slug"), T.fold(F.col("name")).alias("folded"), T.normal(F.col("name")).alias("normal"))


def sentence_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _r(spark, sf).where("url is not null").select("record_id", T.register_url_key(F.col("url")).alias("url_key"))


def mined_facts(spark: SparkSession, sf: str) -> DataFrame:
    """F-29, F-37: year of building, feet and number of footnotes' urls that texts state."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", M.last_built_year(F.col("text")).alias("built"), M.feet(F.col("text")).alias("feet"), F.size(M.footnote_urls(F.col("text"))).alias("urls"))


QUERIES = {
    f.__name__: f
    for f in (
        first_address_join, activity_semi_join, dangling_towers, unmatched_counties, audit_coverage, not_held, validate_towers, duplicate_names, story_footnotes, snapshot_changes, research_queue, tier_rollup,
        repeat_keys, reprint_dedupe, heading_fill, radius_join, nearest_towers, band_partners, box_join, coordinate_flags, gazetteer_look_up, redirect_closure, shared_points, greedy_collapse, resolution,
        merged_fields, lineage_verification, allocated_ids, set_operations, second_without_first, quote_containment, text_lines_context, stratified_cap, top_kinds, slug_ids, sentence_count, url_keys, mined_facts,
    )
}

_FOLD = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"
_NORM = "trim(regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_SLUG = "trim(regexp_replace(regexp_replace(replace(replace(lower(strip_accents({0})), '&amp;', ' and '), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"
_KEY = "regexp_replace(lower(strip_accents({0})), '[^a-z]', '', 'g')"
_DIST = "2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
_P = "p as (select id, location.lat as lat, location.lon as lon, status, coalesce(location.approximate, false) as ap from tower where location.lat is not null and location.lon is not null)"
_BOX = "bx as (select region, country, y0 as a0, y1 as a1, x0 as o0, x1 as o1 from region_polygon join (select distinct region, country from county) on code = region)"
_AUD = f"""{_BOX}, h as (select rec_key, bool_or(not coalesce(status = 'gone', false)) as vis, bool_or(not coalesce(status = 'gone', false) and lat is null) as apx from source_record where kind in ('tower', 'ground') and rec_key is not null group by 1),
 a as (select r.*, h.rec_key is not null as held, coalesce(vis, false) as visible, coalesce(apx, false) as approximate, row_number() over (partition by source, r.rec_key order by record_id) as n,
  coalesce({_US} and exists (select 1 from bx where bx.country = r.country and lat between a0 and a1 and lon between o0 and o1), false) as inside from source_record r left join h on r.rec_key = h.rec_key where r.rec_key <> ''),
 b as (select *, case when held then null when n > 1 then 'duplicate_key' when inside then 'unmatched' when lat is not null and lon is not null then 'coordinates_outside_country' else 'no_coordinates' end as reason from a)"""
_ON = "(len(list_filter(coalesce(registers, []), lambda x: x.register in ({0}))) > 0 or (coalesce(country, 'US') <> 'US' and (len(coalesce(registers, [])) > 0 or len(list_filter(coalesce(links, []), lambda x: x.kind = 'register')) > 0)))"
_BUILT = "coalesce(kind not in ('camp', 'tree', 'point'), true)"
_TIER = f"""case when coalesce(rental.available, false) then 1 when status = 'standing' and {_ON.format("'NHLR'")} then 2 when status = 'standing' then 3
 when {_BUILT} and {_ON.format("'NHLR', 'FFLOS'")} and status in ('relocated', 'ruins', 'replica') then 4 when {_BUILT} and {_ON.format("'NHLR', 'FFLOS'")} and status = 'gone' then 5
 when {_BUILT} and lat is not null and status in ('relocated', 'ruins', 'replica', 'gone') then 6 when {_BUILT} and lat is not null and coalesce(status, 'unknown') = 'unknown' then 7 end"""
_RULES = {
    "id is malformed": ("error", "not regexp_matches(id, '^(us|ca)-[a-z]{2}-[a-z0-9-]+$')"), "id and region differ": ("error", "upper(string_split(id, '-')[2]) <> region"), "name is missing": ("error", "coalesce(trim(name), '') = ''"),
    "status is unknown to the vocabulary": ("error", f"status not in {STATUSES}"), "kind is unknown to the vocabulary": ("error", f"kind not in {KINDS}"), "latitude without longitude": ("error", "(location.lat is null) <> (location.lon is null)"),
    "position is out of range": ("error", "abs(location.lat) > 90 or abs(location.lon) > 180"), "no position": ("warning", "location.lat is null"), "no county": ("warning", "county is null"), "name repeats in other names": ("warning", "list_contains(other_names, name)"),
    "other name is blank": ("error", "len(list_filter(other_names, lambda x: coalesce(trim(x), '') = '')) > 0"), "verified without a design": ("warning", "verification = 'verified' and design is null"), "height is implausible": ("warning", "height_m <= 0 or height_m > 70"),
    "elevation is implausible": ("warning", "elevation_m < -100 or elevation_m > 6200"), "updated is no date": ("error", "not regexp_matches(updated, '^\\d{4}-\\d{2}-\\d{2}$')"),
}

ORACLE = {
    "first_address_join": "select c_custkey, n_name, min(o_orderkey) as first_order from customer left join orders on c_custkey = o_custkey left join nation on c_nationkey = n_nationkey group by c_custkey, n_name",
    "activity_semi_join": "select record_id, source from source_record where len(list_filter(events, lambda x: x.event = 'restored')) > 0",
    "dangling_towers": "select feature_id, i from map_feature where i is not null and i not in (select id from tower where not coalesce(hidden, false))",
    "unmatched_counties": f"select region, {_KEY.format('county')} as ck, count(*) as n from source_record r where county is not null and not exists (select 1 from county c where c.region = r.region and {_KEY.format('c.name')} = {_KEY.format('r.county')}) group by 1, 2",
    "audit_coverage": f"with {_AUD} select source, count(*) as records, count_if(visible) as held_visible, count_if(approximate) as held_approximate, count_if(held and not visible) as held_hidden_only, count_if(not held) as not_held, "
    + ", ".join(f"count_if(coalesce(reason, '') = '{r}') as {r}" for r in audit.REASONS)
    + " from b group by rollup(source)",
    "not_held": f"with {_AUD} select source, coalesce(region, '') as region, coalesce(name, '') as name, rec_key, record_id, reason from b where not held",
    "validate_towers": " union all ".join(f"select id, '{lv}' as level, '{m}' as message from tower where {c}" for m, (lv, c) in _RULES.items()),
    "duplicate_names": f"""select region, trim(regexp_replace(regexp_replace(regexp_replace({_NORM.format('name')}, '\\b(fire|lookout|lkt|tower|station|site|the)\\b', ' ', 'g'), '\\b(mt|mtn|mount)\\b', 'mountain', 'g'), '\\s+', ' ', 'g')) as name_key, count(distinct rec_key) as n from source_record group by 1, 2 having count(distinct rec_key) > 1""",
    "snapshot_changes": """with f as (select *, built_at < timestamp '2024-01-01' as old from map_feature), l as (select old, i, s, v, b from f qualify row_number() over (partition by old, i order by built_at desc, feature_id desc) = 1),
 j as (select i, o.i is null as added, n.i is null as removed, concat_ws(',', case when o.s is distinct from n.s then 's' end, case when o.v is distinct from n.v then 'v' end, case when o.b is distinct from n.b then 'b' end) as d
  from (select * from l where old) o full join (select * from l where not old) n using (i))
 select i, case when added then 'added' when removed then 'removed' else 'changed' end as change, case when added or removed then '' else d end as fields from j where added or removed or d <> ''""",
    "research_queue": f"""with l as (select *, count(*) over (partition by rec_key) as sources from source_record where rec_key is not null qualify row_number() over (partition by rec_key order by record_id desc) = 1)
 select {_TIER} as tier, sources, coalesce(len(links), 0) as n_links, rec_key from l where {_TIER} is not null and len(list_filter(coalesce(events, []), lambda x: x.event = 'restored')) = 0""",
    "tier_rollup": f"select country, region, tier, count(*) as n from (select country, region, {_TIER} as tier from source_record) group by rollup(country, region, tier)",
    "repeat_keys": "select record_id, case when n > 0 then rec_key || ':' || n else rec_key end as numbered from (select record_id, rec_key, row_number() over (partition by rec_key order by record_id) - 1 as n from source_record)",
    "reprint_dedupe": "select first(doc_id order by coalesce(loaded_at, timestamp '9999-01-01'), doc_id) as doc_id, count(*) as copies from documents where text is not null group by text",
    "heading_fill": "select record_id, source, region, last_value(registers[1].number ignore nulls) over (partition by source, region order by record_id rows between unbounded preceding and current row) as heading from source_record",
    "radius_join": f"with {_P}, r as (select record_id, lat, lon from source_record where {_US}) select record_id, id, round({_DIST.format(a='r.lat', b='r.lon', c='p.lat', d='p.lon')}, 3) as metres from r join p on abs(r.lat - p.lat) < 0.01 where {_DIST.format(a='r.lat', b='r.lon', c='p.lat', d='p.lon')} <= 500",
    "nearest_towers": f"with {_P}, d as (select a.id, b.id as other, {_DIST.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} as m from p a join p b on abs(a.lat - b.lat) < 0.5) select id, other, round(m, 3) as metres, row_number() over (partition by id order by m, other) as place from d where m > 200 and m <= 30000 qualify place <= 4",
    "band_partners": f"with {_P}, q as (select * from p where status = 'standing' and not ap), d as (select a.id, {_DIST.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} as m from q a join q b on a.id <> b.id and abs(a.lat - b.lat) < 0.5) select id, count(*) as partners from d where m between 12000 and 32000 group by id having count(*) >= 2",
    "box_join": f"with {_P} select distinct id, code from p join region_polygon on lat between y0 and y1 and lon between x0 and x1",
    "coordinate_flags": f"""with {_BOX}, f as (select record_id, case when lat is null or lon is null or isnan(lat) or isnan(lon) or exists (select 1 from bx where bx.region = r.region and lat between a0 and a1 and lon between o0 and o1) then null
 when lon > 0 then 'lon_positive_sign' when lat < 0 then 'lat_negative_sign' when region in (select region from bx) then 'outside_state_bbox' end as flag from source_record r) select * from f where flag is not null""",
    "gazetteer_look_up": f"""with g as (select id as place_id, region, {_KEY.format('county')} as ck, {_KEY.format('name')} as nk from tower where location.lat is not null),
 r as (select record_id, region, {_KEY.format('county')} as ck, coalesce({_KEY.format('name')}, '') as nk from source_record where lat is null or lon is null),
 h as (select record_id, r.nk, r.ck, count(place_id) as n, min(place_id) as p, bool_or(exists (select 1 from g g2 where g2.region = r.region and g2.ck = r.ck)) as known from r left join g on r.region = g.region and r.nk = g.nk and (r.ck is null or r.ck = g.ck) group by 1, 2, 3),
 o as (select record_id, case when nk = '' then 'no_name' when ck is not null and not known then 'county_unknown' when n = 0 then 'none' when n > 1 then 'ambiguous' when ck is null then 'no_county' else 'found' end as outcome, p from h)
 select record_id, outcome, case when outcome in ('found', 'no_county') then p end as place_id from o""",
    "redirect_closure": """with recursive e as (select p_partkey as src, case when p_partkey % 10 = 7 then p_partkey + 1 when p_partkey % 10 = 8 then p_partkey - 1 else p_partkey // 2 end as dst from part where p_partkey > 3),
 w as (select src as p_partkey, dst as final, 1 as n from e union all select p_partkey, dst, n + 1 from w join e on final = src where n < 40) select p_partkey, final from w where final not in (select src from e)""",
    "merged_fields": "with m as (select rec_key, " + ", ".join(f"first({f} order by record_id) filter ({f} is not null) as {f}, case when count(distinct {f}) > 1 then '{f}' end as c_{f}" for f in ("kind", "status", "built", "agency", "county")) + " from source_record where rec_key is not null group by rec_key) select rec_key, kind, status, built, agency, county, concat_ws(',', c_kind, c_status, c_built, c_agency, c_county) as conflicts from m",
    "lineage_verification": f"with m as (select concat_ws('|', region, {_FOLD.format('name')}) as g, source, lat is null as ap from source_record where name is not null) select g, count(distinct source) as lineages, case when bool_or(ap) then 'unverified' when count(distinct source) >= 2 then 'facts' else 'unverified' end as verification from m group by g",
    "allocated_ids": f"""with n as (select record_id, lower(country) || '-' || lower(region) || '-' || {_SLUG.format('name')} as base from source_record where name is not null and region is not null and country is not null),
 k as (select record_id, base, row_number() over (partition by base order by record_id) as k from n), t as (select id as t, true as own from tower union all select distinct base, false from n),
 h as (select regexp_replace(t, '-\\d+$', '') as base, regexp_extract(t, '-(\\d+)$', 1)::int as num from t where regexp_matches(t, '-([2-9]|[1-9]\\d{{1,8}})$') union select t, 1 from t where own),
 c as (select base, max(k.k) + (select count(*) from h where h.base = k.base) as most from k group by base), r as (select base, unnest(range(1, most + 1)) as num from c),
 f as (select base, num, row_number() over (partition by base order by num) as k from r where not exists (select 1 from h where h.base = r.base and h.num = r.num))
 select record_id, case when num = 1 then base else base || '-' || num end as id from k join f using (base, k)""",
    "story_footnotes": r"""with d as (select doc_id, text from documents where text is not null), f as (select doc_id, list_distinct(list_transform(regexp_extract_all(text, '(?m)^\[\^(\d{1,6})\]:', 1), lambda x: x::int)) as defs,
 list_distinct(list_transform(regexp_extract_all(replace(text, '[^', ' [^') || ' ', '\[\^(\d{1,6})\][^:]', 1), lambda x: x::int)) as refs from d),
 o as (select doc_id, list_sort(list_filter(refs, lambda x: not list_contains(defs, x))) as u, list_sort(list_filter(defs, lambda x: not list_contains(refs, x))) as n from f)
 select doc_id, array_to_string(u, ',') as undefined, array_to_string(n, ',') as unused from o where len(u) > 0 or len(n) > 0""",
    "sentence_count": r"select doc_id, case when text = '' then 0 else 1 + len(regexp_extract_all(text, '[.!?][\t\n\x0B\f\r ]+[A-Z0-9]')) end as sentences from documents where text is not null",
    "set_operations": "(select rec_key from source_record where status = 'standing' union select rec_key from source_record where rental is not null) except select rec_key from source_record where kind = 'unknown'",
    "second_without_first": f"select distinct region, {_FOLD.format('name')} as k from source_record where source in ('openpins', 'oldreg') and name is not null and region is not null",
    "text_lines_context": "with d as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i, string_split(text, chr(10)) as l from documents where text is not null) select doc_id, (i - 1)::int as line from d where coalesce(contains(l[i], 'lightning') or contains(l[i + 1], 'lightning') or (i > 1 and contains(l[i - 1], 'lightning')), false) or contains(l[i], 'lightning') or (i > 1 and contains(l[i - 1], 'lightning'))",
    "stratified_cap": "select record_id, region, row_number() over (partition by region order by sha1(record_id::varchar)) as place from source_record qualify place <= 3",
    "top_kinds": "select kind, count(*) as n from source_record group by kind order by n desc, kind limit 8",
    "slug_ids": f"select id, {_SLUG.format('name')} as slug, {_FOLD.format('name')} as folded, {_NORM.format('name')} as normal from tower",
    "url_keys": "select record_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www\\.)?', ''), '[?#].*$', ''), '/+$', '') as url_key from source_record where url is not null",
    "mined_facts": """select doc_id, regexp_extract_all(text, '(?i)\\b(?:built|rebuilt|begun|erected)\\b[^.0-9]{0,40}\\b(1[89]\\d\\d|20[0-2]\\d)\\b', 1)[-1]::int as built,
 nullif(replace(regexp_extract(text, '(?i)\\b(\\d{1,3}(?:,\\d{3})+|\\d+) ?(?:feet|ft)\\b', 1), ',', ''), '')::int as feet,
 len(list_distinct(regexp_extract_all(text, '(?m)^\\[\\^\\d+\\]:.*?(https?://\\S+)', 1)))::int as urls from documents where text is not null""",
}
