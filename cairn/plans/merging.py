"""Queries of survivorship, placement, prose and display, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import display, prose, regions
from cairn.functions import text as T
from cairn.operators import places, resolve, sheets
from cairn.operators import survivorship as S
from cairn.plans.entities import _DIST, _FOLD, _KEY, _US, _boxes, _key
from cairn.session import table


def _r(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_record")


def _t(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tower")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf).select("id", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))


def local_units(spark: SparkSession, sf: str) -> DataFrame:
    """F-13, F-14, F-15: a record's unit as it is compared and as a page writes it, its region's name, the prefix of its id."""
    c, r, u = F.col("country"), F.col("region"), F.col("county")
    return _r(spark, sf).select("record_id", regions.unit_key(u).alias("unit_key"), regions.unit_label(c, r, u).alias("unit_label"), regions.region_with_country(r).alias("region_name"), regions.id_prefix(c, r).alias("prefix"))


def region_codes(spark: SparkSession, sf: str) -> DataFrame:
    """F-11, F-12: codes read from the names that regions.region_name writes, in odd case, and from the codes themselves."""
    r = _r(spark, sf).select("record_id", "region", "country").where("region is not null")
    name = F.concat(F.lit(" "), F.upper(regions.region_name(F.col("region"))), F.lit(". "))
    return r.select("record_id", regions.parse_region(name).alias("of_name"), regions.parse_region(F.lower("region"), F.col("country")).alias("of_code"))


def tower_folders(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf).select("id", regions.id_folder(F.col("id")).alias("folder"))


def rental_facts(spark: SparkSession, sf: str) -> DataFrame:
    """F-29: what texts say of season, sleepers, pets, altitude, years and access."""
    t = F.col("text")
    return table(spark, sf, "documents").where("text is not null").select(
        "doc_id", prose.season(t).alias("season"), prose.occupancy(t).alias("sleeps"), prose.pets(t).alias("pets"), prose.elevation_ft(t).alias("feet"),
        prose.built_year(t).alias("built"), prose.opened_year(t).alias("opened"), prose.access_note(t).alias("access"),
    )


def house_rules(spark: SparkSession, sf: str) -> DataFrame:
    """F-29"""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.array_join(prose.rules(F.col("text")), "|").alias("rules"))


def removal_events(spark: SparkSession, sf: str) -> DataFrame:
    """F-30 on typed statuses."""
    e = prose.removed_event(F.col("status_raw"), F.col("source"))
    return _r(spark, sf).select("record_id", e.alias("e")).where("e is not null").select("record_id", "e.*")


def bracket_notes(spark: SparkSession, sf: str) -> DataFrame:
    """F-35 on the types that records are given."""
    n = prose.bracket_notes(F.col("type_raw"))
    return _r(spark, sf).where("type_raw is not null").select("record_id", n.alias("n")).where("size(n.notes) > 0").select("record_id", "n.status_note", F.array_join("n.notes", "|").alias("notes"))


def booking_links(spark: SparkSession, sf: str) -> DataFrame:
    """F-35: host and facility of rentals' links."""
    u = F.col("rental.url")
    return _r(spark, sf).where("rental.url is not null").select("record_id", prose.host(u).alias("host"), prose.facility_number(u).alias("facility"))


def footnote_sources(spark: SparkSession, sf: str) -> DataFrame:
    """F-37"""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.inline(prose.footnote_sources(F.col("text"))))


def page_values(spark: SparkSession, sf: str) -> DataFrame:
    """F-41, F-42, F-65, F-66: a tower's measures as pages write them."""
    lat, lon = F.col("location.lat"), F.col("location.lon")
    t = _t(spark, sf).where("location.lat is not null and location.lon is not null")
    bearing = F.pmod(lat * 1000, F.lit(360.0))
    return t.select(
        "id", display.length_text(F.col("country"), F.col("elevation_m")).alias("elevation"), display.coords_text(lat, lon).alias("position"), display.date_text(F.col("updated")).alias("updated"),
        display.quadrant(bearing).alias("quadrant"), display.azimuth_text(bearing).alias("azimuth"), F.round(display.eye_m(F.col("kind"), F.col("height_m"), lon), 4).alias("eye_m"), display.distance_text(F.abs(lon) * 100).alias("distance"),
    )


def chart_axes(spark: SparkSession, sf: str) -> DataFrame:
    """M-10, F-64: the axis of a chart of each region's towers, and the haze over its farthest east one."""
    g = _t(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("location.lon")).alias("x"))
    return g.select("region", F.round(display.axis_max(F.col("n").cast("double")), 6).alias("axis"), F.round(display.haze(F.col("x") * 500), 6).alias("haze"))


def ranked_merge(spark: SparkSession, sf: str) -> DataFrame:
    """E-01, E-05: status by sources in order of name, year of building in the reverse order."""
    s = table(spark, sf, "source_info").select("source")
    place = F.row_number().over(W.orderBy("source"))  # a row for each source
    ranks = s.select(F.lit("status").alias("field"), "source", place.alias("rank")).union(s.select(F.lit("built"), "source", F.lit(100) - place))
    got = S.ranked_fields(_r(spark, sf).where("rec_key is not null").withColumn("rec_key", F.concat_ws("|", "region", T.fold(F.col("name")))), ranks, "rec_key", ["status", "built"], "record_id")
    return got.select("rec_key", "status", "built", F.array_join(F.transform("conflicts", lambda c: F.concat(c.field, F.lit(":"), F.size(c["values"]).cast("string"))), ",").alias("conflicts"))


def event_union(spark: SparkSession, sf: str) -> DataFrame:
    """E-06: events of a key's deliveries, association reports (source ridgeclub) last."""
    return S.event_union(_r(spark, sf).where("rec_key is not null"), "rec_key", F.when(F.col("source") == "ridgeclub", 1).otherwise(0))


def link_union(spark: SparkSession, sf: str) -> DataFrame:
    """E-09"""
    return S.link_union(_r(spark, sf).where("rec_key is not null"), "rec_key")


def photo_credits(spark: SparkSession, sf: str) -> DataFrame:
    """E-10"""
    return S.photo_credits(_r(spark, sf), table(spark, sf, "source_info"), "record_id")


def merged_rentals(spark: SparkSession, sf: str) -> DataFrame:
    """E-07, E-08: source rentdesk is the booking system."""
    return S.merged_rental(_r(spark, sf).where("rec_key is not null"), "rec_key", F.col("source") == "rentdesk", "record_id")


def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    """T-06, E-16: by the year that a record's latest event gives."""
    year = F.array_max(F.transform("events", lambda e: e.year))
    return S.latest_status(_r(spark, sf).where("rec_key is not null").withColumn("year", year), "rec_key", "status", "year")


def research_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """E-13: towers with kind and material as the map's latest build has them, where those are in order."""
    f = table(spark, sf, "map_feature").groupBy(F.col("i").alias("id")).agg(F.max_by(F.struct(F.col("k").alias("kind"), F.col("m").alias("material")), F.struct("built_at", "feature_id")).alias("x")).select("id", "x.*")
    rules = {"kind": F.col("r_kind") != "camp", "material": F.col("r_material").isin("steel", "wood", "log")}
    return S.research_overlay(_t(spark, sf).select("id", "kind", "material"), f, "id", rules)


def private_owners(spark: SparkSession, sf: str) -> DataFrame:
    """E-11"""
    p = S.private_access(F.col("agency"), F.col("ownership"), F.lit("unknown"))
    return _t(spark, sf).select("id", p.alias("p")).select("id", "p.*")


def unplaced_groups(spark: SparkSession, sf: str) -> DataFrame:
    """E-14, M-05"""
    r = _r(spark, sf).where("lat is null or lon is null").select("record_id", "region", _key("county").alias("county_key"), F.coalesce(_key("name"), F.lit("")).alias("name_key"))
    return S.unplaced_groups(r, "record_id")


def hidden_groups(spark: SparkSession, sf: str) -> DataFrame:
    """P-14: keys that nothing but camps and unknown kinds speak for."""
    reason = F.when(F.col("kind") == "camp", "camp").when(F.coalesce("kind", F.lit("unknown")) == "unknown", "unconfirmed")
    return S.hidden_reason(_r(spark, sf).where("rec_key is not null"), "rec_key", reason)


def refused_readings(spark: SparkSession, sf: str) -> DataFrame:
    """P-21, E-18: what each source delivered from 2024 on against all before."""
    r = _r(spark, sf)
    return S.too_few(r.where("retrieved_at >= timestamp_ntz'2024-01-01'"), r.where("retrieved_at < timestamp_ntz'2024-01-01'"))


def nudged_regions(spark: SparkSession, sf: str) -> DataFrame:
    """J-08"""
    return places.nearest_region(_points(spark, sf), table(spark, sf, "region_polygon"), "id")


def unique_countries(spark: SparkSession, sf: str) -> DataFrame:
    """J-09"""
    return places.country_at(_points(spark, sf), _boxes(spark, sf).withColumnRenamed("region", "code"), "id")


def near_misses(spark: SparkSession, sf: str) -> DataFrame:
    """J-32: towers within 300 m of each other, or within 3 km under names alike."""
    t = _t(spark, sf).select("id", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"), _key("name").alias("name_key"))
    alike = 1 - F.levenshtein("name_a", "name_b") / F.greatest(F.length("name_a"), F.length("name_b"), F.lit(1))
    return places.near_misses(t, "id", 300.0, 3000.0, alike).select("id_a", "id_b", F.round("metres", 3).alias("metres"), F.round("score", 6).alias("score"))


def dead_reckoning(spark: SparkSession, sf: str) -> DataFrame:
    """G-31: ten miles and a bearing from each tower's county."""
    notes = _t(spark, sf).where("county is not null").select("id", F.concat_ws("|", "region", _key("county")).alias("town"), (F.length("name") * 7.0).alias("bearing"), F.lit(10.0).alias("miles"))
    towns = table(spark, sf, "county").groupBy(F.concat_ws("|", "region", _key("name")).alias("town")).agg(F.min_by("lat", "county_id").alias("lat"), F.min_by("lon", "county_id").alias("lon"))
    return places.dead_reckoned(notes, towns, "id")


def placed_rentals(spark: SparkSession, sf: str) -> DataFrame:
    """J-31: rentals of records against the towers; every seventh tower by length of name is rented."""
    loose = lambda c: F.regexp_replace(_key(c), "(mountain|peak|ridge|butte|hill|knob|point|lookout|tower|fire)", "")
    r = _r(spark, sf).where("rental is not null").select(F.col("record_id").alias("key"), "region", F.col("rental.ridb_facility_id").alias("facility"), F.coalesce(_key("name"), F.lit("")).alias("name_key"), F.coalesce(loose("name"), F.lit("")).alias("loose_key"))
    t = _t(spark, sf).select(F.col("id").alias("tower"), "region", F.when(F.length("name") % 7 == 0, F.concat(F.lit("f"), "id")).alias("facility"), _key("name").alias("name_key"), loose("name").alias("loose_key"), "status")
    return places.place_rentals(r, t)


def region_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """A-20"""
    c = places.centroid(F.col("rings"))
    return table(spark, sf, "region_polygon").select("code", "x0", c.alias("c")).select("code", "x0", F.round("c.lat", 8).alias("lat"), F.round("c.lon", 8).alias("lon"))


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets around the counties, of several scales and years."""
    n = F.row_number().over(W.orderBy("county_id"))  # a few hundred counties
    c = table(spark, sf, "county").select("name", "lat", "lon", n.alias("n"))
    size = F.lit(0.4) + (F.col("n") % 3) * 0.3
    x0, x1, y0, y1 = F.col("lon") - size, F.col("lon") + size, F.col("lat") - size, F.col("lat") + size
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    year = (1850 + (F.col("n") * 37) % 160).cast("int")
    return c.select(
        F.col("n").cast("bigint").alias("scan_id"), "name", F.element_at(F.array(*map(F.lit, (24000, 62500, 125000, 250000))), F.col("n") % 4 + 1).alias("scale"), year.alias("year"), F.when(F.col("n") % 5 > 0, year + F.col("n") % 20).alias("imprint"),
        F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))).alias("rings"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
    )


def sheet_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """O-04, P-17: sheets drawn at zoom 11 for the age of the lookouts, best first."""
    return sheets.ranked(_sheets(spark, sf), "lookouts", 11).select("scan_id", "place")


def sheets_of_towers(spark: SparkSession, sf: str) -> DataFrame:
    """J-15"""
    return sheets.sheet_at(_points(spark, sf).where("lat is not null and lon is not null"), sheets.ranked(_sheets(spark, sf), "newest", 13), "id")


VIEW = (-122.0, 38.0, -112.0, 46.0)


def sheet_shares(spark: SparkSession, sf: str) -> DataFrame:
    """A-19, O-10, P-18"""
    return sheets.sheets_in_view(VIEW, sheets.ranked(_sheets(spark, sf), "oldest", 9, VIEW)).select("scan_id", F.round("share", 6).alias("share"))


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """W-13, O-09: towers' names along their region's width, the highest first."""
    t = _t(spark, sf).where("location.lon is not null").select("region", F.col("id").alias("item"), (F.col("location.lon") * 100).alias("x"), (F.length("name") * 6.0).alias("width"), F.coalesce("elevation_m", F.lit(0.0)).alias("score"))
    return sheets.label_rows(t, "region", 4)


def identities(spark: SparkSession, sf: str) -> DataFrame:
    """J-14: one row for each name and position to four decimals; of its links the longest, as the fullest."""
    r = _r(spark, sf).where("name is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    best = F.min_by(F.col("url"), F.when(F.col("url").isNotNull(), F.struct((-F.length("url")).alias("l"), "url")))
    return r.groupBy(T.slug(F.col("name")).alias("slug"), (F.floor(F.col("lat") * 10_000 + 0.5) / 10_000).alias("lat4"), (F.floor(F.col("lon") * 10_000 + 0.5) / 10_000).alias("lon4")).agg(best.alias("url"), F.count(F.lit(1)).alias("views"))


def wanted_places(spark: SparkSession, sf: str) -> DataFrame:
    """J-20: towers, as a gazetteer, whose name some record without a position asks for in its region."""
    want = _r(spark, sf).where("lat is null").select("region", _key("name").alias("k")).where("k <> ''").distinct()
    return _t(spark, sf).select("id", "region", _key("name").alias("k")).join(want, ["region", "k"], "left_semi").select("id")


def names_of_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A-10, A-25: all county names records give in a region, as one list."""
    r = _r(spark, sf).where("region is not null and county is not null")
    return r.groupBy("region").agg(F.count_distinct("county").alias("n"), F.concat_ws("|", F.array_sort(F.collect_set("county"))).alias("names"))


def design_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-23, M-07: features of each design id, with their materials' most frequent."""
    f = table(spark, sf, "map_feature").select("feature_id", "m", F.explode(F.split("d", r"\|")).alias("design")).where("design <> ''")
    n = f.groupBy("design", F.coalesce("m", F.lit("other")).alias("material")).agg(F.count_distinct("feature_id").alias("n"))
    return n.groupBy("design").agg(F.sum("n").alias("features"), F.min_by("material", F.struct((-F.col("n")).alias("n"), "material")).alias("material"))


def warning_templates(spark: SparkSession, sf: str) -> DataFrame:
    """A-12: what is wrong with positions, the numbers taken out, by how often."""
    w = F.concat(F.lit("position "), F.col("lat").cast("decimal(20,3)").cast("string"), F.lit(", "), F.col("lon").cast("decimal(20,3)").cast("string"), F.lit(" is outside "), F.coalesce("region", F.lit("its region")))
    r = _r(spark, sf).where("abs(lat) > 90 or abs(lon) > 180 or lon > 0")
    return r.groupBy(F.substring(F.regexp_replace(w, r"-?\d+(\.\d+)?", "#"), 1, 60).alias("warning")).agg(F.count(F.lit(1)).alias("n"))


def regions_by_country(spark: SparkSession, sf: str) -> DataFrame:
    """M-08: regions that have towers, by country."""
    return _t(spark, sf).groupBy("country").agg(F.concat_ws(",", F.array_sort(F.collect_set("region"))).alias("regions"))


def batches_of_three(spark: SparkSession, sf: str) -> DataFrame:
    """M-15, O-05: towers of each region in batches of three, by id."""
    n = F.row_number().over(W.partitionBy("region").orderBy("id")) - 1
    return _t(spark, sf).select("id", "region", F.floor(n / 3).cast("int").alias("batch"))


def source_pages(spark: SparkSession, sf: str) -> DataFrame:
    """O-12: a record's first two links and all that were relocated."""
    x = _r(spark, sf).select("record_id", F.posexplode("links").alias("pos", "l")).where("l.url is not null")
    n = F.row_number().over(W.partitionBy("record_id").orderBy("pos"))
    return x.withColumn("n", n).where("n <= 2 or l.kind = 'relocated_from'").select("record_id", "pos", "l.url")


def imported_marks(spark: SparkSession, sf: str) -> DataFrame:
    """U-06, U-07: a list of marks with retired ids resolved; who stayed has visited."""
    retired = _t(spark, sf).where("hidden").groupBy("region").agg(F.min("id").alias("old")).join(_t(spark, sf).where("not hidden").groupBy("region").agg(F.min("id").alias("new")), "region").select("old", "new")
    marks = _t(spark, sf).select("id", F.when(F.length("name") % 2 == 0, "stayed").otherwise("want").alias("mark"))
    now = marks.join(retired, F.col("id") == F.col("old"), "left").select(F.coalesce("new", "id").alias("id"), F.explode(F.when(F.col("mark") == "stayed", F.array(F.lit("stayed"), F.lit("visited"))).otherwise(F.array("mark"))).alias("mark"))
    return now.distinct()


def one_name_each(spark: SparkSession, sf: str) -> DataFrame:
    """W-06: of each document source's titles the English one first, then the smallest id."""
    n = F.row_number().over(W.partitionBy("title").orderBy((F.coalesce("lang", F.lit("")) != "en").cast("int"), "doc_id"))
    return table(spark, sf, "documents").where("title is not null").select("title", "doc_id", "lang", n.alias("n")).where("n = 1").select("title", "doc_id", "lang")


def association_rules(spark: SparkSession, sf: str) -> DataFrame:
    """V-07: what is wrong with a record as an association's."""
    from cairn.operators import audit

    http = lambda c: F.coalesce(c.rlike("^https?://"), F.lit(False))
    e = F.coalesce("events", F.array())
    twice = F.size(F.array_distinct(F.transform(e, lambda x: F.struct(x.event, x.year)))) < F.size(e)
    rules = {
        "key must start with the source": ("error", ~F.coalesce(F.col("rec_key").startswith(F.concat(F.col("source"), F.lit(":"))), F.lit(False))),
        "no name": ("error", F.coalesce("name", F.lit("")) == ""), "url must be http(s)": ("error", ~http(F.col("url"))),
        "lat and lon must both be given or both null": ("error", F.col("lat").isNull() != F.col("lon").isNull()),
        "year must lie in 1800-2026": ("error", F.exists(e, lambda x: (x.year < 1800) | (x.year > 2026))),
        "note is blank or too long": ("error", F.exists(e, lambda x: (F.trim(x.note) == "") | (F.length(x.note) > 500))),
        "an other event needs a note": ("error", F.exists(e, lambda x: (x.event == "other") & x.note.isNull())),
        "source_urls has a non-http(s) entry": ("error", F.exists(e, lambda x: F.exists(F.coalesce(x.source_urls, F.array()), lambda u: ~http(u)))),
        "two events with the same name and year": ("error", twice),
    }
    return audit.violations(_r(spark, sf), "record_id", rules)


QUERIES = {
    f.__name__: f
    for f in (
        local_units, region_codes, tower_folders, rental_facts, house_rules, removal_events, bracket_notes, booking_links, footnote_sources, page_values, chart_axes, ranked_merge, event_union, link_union, photo_credits,
        merged_rentals, latest_status, research_overlay, private_owners, unplaced_groups, hidden_groups, refused_readings, nudged_regions, unique_countries, near_misses, dead_reckoning, placed_rentals, region_centroids,
        sheet_ranking, sheets_of_towers, sheet_shares, label_rows, identities, wanted_places, names_of_regions, design_counts, warning_templates, regions_by_country, batches_of_three, source_pages, imported_marks,
        one_name_each, association_rules,
    )
}
def _re(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _get(pattern: str, text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, {_re(pattern)}, 1), '')"


_UNIT = f"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({_FOLD.format('county')}, '’', ''''), {_re(chr(92) + 'b(' + regions.UNIT_WORDS + ')' + chr(92) + 'b' + chr(92) + '.?')}, ' ', 'g'), '\\bste\\b\\.?', 'sainte', 'g'), '\\bst\\b\\.?', 'saint', 'g'), '[^a-z0-9]+', '', 'g'), '')"
_NAMES = "map {" + ", ".join(f"'{c}': {_re(n)}" for c, n in (regions.US | regions.CANADA).items()) + "}"
_CA = "(" + ", ".join(f"'{c}'" for c in regions.CANADA) + ")"
_SENT = "list_filter(string_split(regexp_replace(text, '([.!?])[\\t\\n\\x0B\\f\\r ]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '')"
_PETS = " ".join(f"when regexp_matches(text, {_re(p)}) then '{label}'" for label, p in prose.PETS.items())
_WORDS = "[" + ", ".join(f"'{w}'" for w in prose.NUMBERS) + "]"
_FEET = lambda p: f"nullif(replace({_get(p)}, ',', ''), '')::double"
_NUM = "printf('%.0f', {0})"
_GROUPED = "format('{{:,}}', floor({0} + 0.5)::bigint)"
_SH = """n as (select *, row_number() over (order by county_id) as n from county), z as (select n as scan_id, name, [24000, 62500, 125000, 250000][n % 4 + 1] as scale, (1850 + (n * 37) % 160)::int as year, case when n % 5 > 0 then (1850 + (n * 37) % 160) + n % 20 end as imprint,
 lon - (0.4 + (n % 3) * 0.3) as x0, lat - (0.4 + (n % 3) * 0.3) as y0, lon + (0.4 + (n % 3) * 0.3) as x1, lat + (0.4 + (n % 3) * 0.3) as y1 from n)"""


def _rank(era: int, newest: bool, drawn: str) -> str:
    return f"""{_SH}, u as (select * from z where {drawn} qualify row_number() over (partition by name, scale, year, round(x0, 2), round(y0, 2), round(x1, 2), round(y1, 2) order by coalesce(imprint, 9999), scan_id) = 1),
 rk as (select *, row_number() over (order by abs(year - {era}), {'-year' if newest else 'year'}, scale, coalesce(imprint, 9999), scan_id) as place from u)"""


_P = "p as (select id, location.lat as lat, location.lon as lon from tower where location.lat is not null and location.lon is not null)"
_LOOSE = "regexp_replace({0}, '(mountain|peak|ridge|butte|hill|knob|point|lookout|tower|fire)', '', 'g')"
_HTTP = "coalesce(regexp_matches({0}, '^https?://'), false)"
_E = "coalesce(events, [])"
_RULES = {
    "key must start with the source": "not coalesce(starts_with(rec_key, source || ':'), false)", "no name": "coalesce(name, '') = ''", "url must be http(s)": f"not {_HTTP.format('url')}",
    "lat and lon must both be given or both null": "(lat is null) <> (lon is null)", "year must lie in 1800-2026": f"len(list_filter({_E}, lambda x: x.year < 1800 or x.year > 2026)) > 0",
    "note is blank or too long": f"len(list_filter({_E}, lambda x: trim(x.note) = '' or length(x.note) > 500)) > 0", "an other event needs a note": f"len(list_filter({_E}, lambda x: x.event = 'other' and x.note is null)) > 0",
    "source_urls has a non-http(s) entry": f"len(list_filter({_E}, lambda x: len(list_filter(coalesce(x.source_urls, []), lambda u: not {_HTTP.format('u')})) > 0)) > 0",
    "two events with the same name and year": "(select count(distinct (x.event, x.year)) from (select unnest(events) as x)) < len(events)",
}
_NUDGES = "(values (-0.05, -0.05), (-0.05, 0.0), (-0.05, 0.05), (0.0, -0.05), (0.0, 0.05), (0.05, -0.05), (0.05, 0.0), (0.05, 0.05)) as d(dy, dx)"
_POLY = "e as (select code, pid, ring[i].lon as ax, ring[i].lat as ay, ring[i % len(ring) + 1].lon as bx, ring[i % len(ring) + 1].lat as ey from (select *, unnest(range(1, len(ring) + 1)) as i from (select code, pid, unnest(rings) as ring from (select *, row_number() over () as pid from region_polygon))))"
_HOLDS = "count_if(((ay > {y}) <> (ey > {y})) and {x} < (bx - ax) * ({y} - ay) / (ey - ay) + ax) % 2 = 1"

ORACLE: dict[str, str] = {
    "local_units": f"""with r as (select *, trim(county) as c, upper(coalesce(region, '')) as g, upper(coalesce(country, case when upper(region) in {_CA} then 'CA' end, 'US')) as n, {_NAMES}[upper(region)] as nm from source_record)
 select record_id, {_UNIT} as unit_key, case when c <> '' then case when n <> 'US' or regexp_matches(c, '(?i)\\b(County|Parish|Borough|Census Area|Municipality|City)$') or contains(c, '/') then c else c || ' ' || case when g = 'LA' then 'Parish' when g = 'AK' then 'Borough' else 'County' end end end as unit_label,
 coalesce(nm, region, '') || case when g in {_CA} then ', Canada' else '' end as region_name, lower(coalesce(country, case when g in {_CA} then 'CA' end, 'US')) || '-' || lower(coalesce(region, 'xx')) as prefix from r""",
    "region_codes": f"select record_id, case when {_NAMES}[upper(region)] is not null then upper(region) end as of_name, case when {_NAMES}[upper(region)] is not null and (country is null or country = case when upper(region) in {_CA} then 'CA' else 'US' end) then upper(region) end as of_code from source_record where region is not null",
    "tower_folders": "select id, case when split_part(id, '-', 1) = 'us' then split_part(id, '-', 2) else split_part(id, '-', 1) || '-' || split_part(id, '-', 2) end as folder from tower",
    "rental_facts": f"""select doc_id, case when regexp_matches(text, {_re(prose.YEAR_ROUND)}) then 'Year-round' else regexp_replace(trim(regexp_replace({_get(prose.SEASON)}, '\\s+', ' ', 'g')), ',+$', '') end as season,
 coalesce(nullif(try_cast(case when regexp_matches({_get(prose.SLEEPS)}, '^\\d{{1,9}}$') then {_get(prose.SLEEPS)} end as int), 0), nullif(list_position({_WORDS}, lower({_get(prose.SLEEPS)})), 0), {_get(prose.PERSONS)}::int) as sleeps,
 case {_PETS} end as pets, case when {_get(prose.ELEVATION)} is not null then {_FEET(prose.ELEVATION)} else {_FEET(prose.ELEVATION_AT)} end as feet, regexp_extract_all(text, {_re(prose.BUILT)}, 1)[-1]::int as built, {_get(prose.OPENED)}::int as opened,
 trim(list_filter({_SENT}, lambda x: regexp_matches(x, {_re(prose.ACCESS)}))[1]) as access from documents where text is not null""",
    "removal_events": f"""with r as (select *, list_max(list_transform(regexp_extract_all(status_raw, {_re(prose.YEAR)}, 1), lambda x: x::int)) as y1, list_max(list_transform(regexp_extract_all(status_raw, {_re(prose.DECADE)}, 1), lambda x: x::int)) as y2 from source_record),
 y as (select *, coalesce(y1, y2) as year from r) select record_id, year, case when regexp_matches(status_raw, {_re(prose.FIRE)}) then 'burned' when regexp_matches(status_raw, {_re(prose.DESTROYED)}) then 'destroyed' else 'removed' end as event,
 '''Removed'' field on ' || upper(source) || ' detail page: "' || trim(status_raw) || '"' || case when regexp_matches(status_raw, {_re(prose.CIRCA)}) or regexp_matches(status_raw, {_re(prose.DECADE)}) then ' (about ' || year || ').' else '.' end as note, source as from_source from y where year is not null""",
    "bracket_notes": f"""with n as (select record_id, list_filter(list_transform(regexp_extract_all(type_raw, '\\(([^()]*)\\)', 1), lambda x: trim(regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '([A-Za-z])(\\d{{4}})\\b', '\\1 \\2', 'g'))), lambda x: regexp_matches(x, '[A-Za-z]')) as notes from source_record where type_raw is not null)
 select record_id, list_filter(notes, lambda x: regexp_matches(x, {_re(prose.CLOSURE)}) and not regexp_matches(x, {_re(prose.MANAGED)}))[-1] as status_note, array_to_string(notes, '|') as notes from n where len(notes) > 0""",
    "booking_links": """with u as (select record_id, rental.url as u, regexp_replace(lower(regexp_extract(rental.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') as host from source_record where rental.url is not null)
 select record_id, host, case when host = 'recreation.gov' then nullif(regexp_extract(u, '/(?:camping/campgrounds|camping/campsites|permits|tour)/(\\d+)', 1), '') end as facility from u""",
    "footnote_sources": f"""with l as (select doc_id, unnest(regexp_extract_all(text, '(?m)^\\[\\^\\d{{1,9}}\\]:[ \\t]*\\S.*$')) as l from documents where text is not null), d as (select doc_id, regexp_extract(l, '^\\[\\^(\\d{{1,9}})\\]', 1)::int as n, rtrim(regexp_extract(l, '^\\[\\^\\d{{1,9}}\\]:[ \\t]*(\\S.*)$', 1), ' ') as t from l),
 f as (select doc_id, n, t, list_transform(string_split(regexp_replace(trim(split_part(split_part(t, ', http', 1), ' http', 1)), ',+$', ''), ','), lambda x: trim(x)) as parts from d)
 select doc_id, n, parts[1] as title, case when len(parts) > 1 then array_to_string(parts[2:], ', ') end as publisher, regexp_replace(nullif(regexp_extract(t, {_re(prose.URL)}), ''), '[.,;]+$', '') as url, {_get(prose.ACCESSED, 't')} as accessed from f""",
    "page_values": f"""with t as (select id, country, kind, height_m, elevation_m, updated, location.lat as lat, location.lon as lon, (floor((((location.lat * 1000) % 360 + 360) % 360) + 0.5)::int) % 360 as a, abs(location.lon) * 100 as d from tower where location.lat is not null and location.lon is not null)
 select id, case when elevation_m is null or isnan(elevation_m) then null when coalesce(country, 'US') = 'US' then {_GROUPED.format('elevation_m / 0.3048')} || ' ft (' || {_GROUPED.format('elevation_m')} || ' m)' else {_GROUPED.format('elevation_m')} || ' m (' || {_GROUPED.format('elevation_m / 0.3048')} || ' ft)' end as elevation,
 replace(printf('%.5f', lat) || ', ' || printf('%.5f', lon), '-', '−') as position, case when regexp_matches(updated, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then updated[9:10]::int || ' ' || ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][updated[6:7]::int] || ' ' || updated[1:4] else nullif(updated, '') end as updated,
 case a when 0 then 'due north' when 90 then 'due east' when 180 then 'due south' when 270 then 'due west' else case when a < 90 then 'N ' || a || '° E' when a < 180 then 'S ' || (180 - a) || '° E' when a < 270 then 'S ' || (a - 180) || '° W' else 'N ' || (360 - a) || '° W' end end as quadrant, lpad(a::varchar, 3, '0') || '°' as azimuth,
 round(coalesce(case when height_m > 0 then height_m end, case kind when 'ground' then 0.9 when 'two_story' then 4.4 when 'three_story' then 7.4 when 'mobile' then 0.9 when 'rooftop' then 4.4 when 'tree' then 15.0 when 'camp' then 0.0 when 'point' then 0.0 end, case when lon > -100 then 20.0 else 9.1 end) + 1.6, 4) as eye_m,
 case when d < 1000 then {_GROUPED.format("case when floor(d / 10 + 0.5) = 0 then d else floor(d / 10 + 0.5) * 10 end")} || ' m' else printf(case when d < 10000 then '%.1f' else '%.0f' end, d / 1000) || ' km (' || printf(case when d < 16093.44 then '%.1f' else '%.0f' end, d / 1609.344) || ' mi)' end as distance from t""",
    "chart_axes": """with g as (select region, count(*)::double as n, max(abs(location.lon)) as x from tower group by 1) select region, round(list_min(list_filter(list_transform([1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0], lambda s: s * pow(10, floor(log10(n)))), lambda v: v >= n)), 6) as axis, round(least(0.9, 1 - exp(-x * 500 / 42000)), 6) as haze from g""",
    "ranked_merge": f"""with k as (select source, row_number() over (order by source) as rank from source_info), r as (select r.*, concat_ws('|', region, {_FOLD.format('name')}) as g, coalesce(k.rank, 1000000) as a, coalesce(100 - k.rank, 1000000) as b from source_record r left join k using (source) where rec_key is not null),
 m as (select g as rec_key, first(status order by a, record_id) filter (status is not null) as status, first(built order by b, record_id) filter (built is not null) as built, count(distinct status) as ns, count(distinct built) as nb, count(distinct (source, status)) filter (status is not null) as vs, count(distinct (source, built)) filter (built is not null) as vb from r group by g)
 select rec_key, status, built, concat_ws(',', case when ns > 1 then 'status:' || vs end, case when nb > 1 then 'built:' || vb end) as conflicts from m""",
    "event_union": """with e as (select rec_key, source, unnest(events) as e from source_record where rec_key is not null) select rec_key, e.year as year, e.event as event, first(e.note order by (source = 'ridgeclub')::int, e.note is null, e.note, source) as note, first(source order by (source = 'ridgeclub')::int, e.note is null, e.note, source) as source from e where e.event is not null group by 1, 2, 3""",
    "link_union": "with l as (select rec_key, source, unnest(links) as l from source_record where rec_key is not null) select rec_key, l.url as url, coalesce(first(l.label order by l.label is null, source, l.label, l.kind nulls first), first(source order by l.label is null, source, l.label, l.kind nulls first)) as label, first(l.kind order by l.label is null, source, l.label, l.kind nulls first) as kind from l where l.url is not null group by 1, 2",
    "photo_credits": "with p as (select record_id, source, unnest(photos) as p from source_record) select record_id, p.url as url, coalesce(nullif(trim(p.credit), ''), title) as credit from p left join source_info using (source) where p.url is not null",
    "merged_rentals": """with e as (select rec_key, record_id, source, unnest(events) as e from source_record where rec_key is not null), x as (select rec_key, max(struct_pack(year := e.year, event := e.event, source := source)) as last from e where e.event in ('burned', 'destroyed', 'removed', 'abandoned') and e.year is not null group by 1),
 g as (select rec_key, arg_min(rental, record_id) filter (rental is not null and source = 'rentdesk') as b, arg_min(rental, record_id) filter (rental is not null and source <> 'rentdesk') as l, arg_max(status, record_id) filter (status is not null) as s from source_record where rec_key is not null group by 1),
 r as (select g.*, coalesce(b, l) as r, coalesce(s = 'gone', false) as gone, last from g left join x using (rec_key) where b is not null or l is not null)
 select rec_key, case when gone then false else r.available end as available, r.provider as provider, r.url as url, r.max_occupancy as max_occupancy, coalesce(l.status_note, b.status_note) as status_note, coalesce(l.manager, b.manager) as manager,
 coalesce(case when gone then coalesce(last.source, 'a source') || ' reports this lookout ' || coalesce(last.event, 'gone') || coalesce(' in ' || last.year, '') || ', but it is still listed.' end, r.warning) as warning from r""",
    "latest_status": "with y as (select *, list_max(list_transform(events, lambda x: x.year)) as y from source_record where rec_key is not null and status is not null) select rec_key, first(status order by coalesce(y, -1) desc, status = 'unknown', status) as status, max(y) as as_of from y group by 1",
    "research_overlay": """with f as (select i as id, first(k order by built_at desc, feature_id desc) as rk, first(m order by built_at desc, feature_id desc) as rm from map_feature group by 1)
 select t.id, case when rk <> 'camp' then rk else kind end as kind, case when rm in ('steel', 'wood', 'log') then rm else material end as material, concat_ws(',', case when rk = 'camp' then 'kind' end, case when rm not in ('steel', 'wood', 'log') then 'material' end) as problems from tower t left join f using (id)""",
    "private_owners": "select id, case when regexp_matches(lower(coalesce(agency, '')), '\\bprivate') then 'private' else ownership end as ownership, case when regexp_matches(lower(coalesce(agency, '')), '\\bprivate') then 'permission' else 'unknown' end as access from tower",
    "unplaced_groups": f"""with u as (select record_id, region, {_KEY.format('county')} as ck, coalesce({_KEY.format('name')}, '') as name_key from source_record where lat is null or lon is null), o as (select region, name_key, case when count(distinct ck) = 1 then max(ck) end as sole from u group by 1, 2)
 select u.region, u.name_key, coalesce(ck, sole) as county_key, count(*) as records, min(record_id) as first from u left join o on u.region is not distinct from o.region and u.name_key = o.name_key where u.name_key <> '' group by 1, 2, 3""",
    "hidden_groups": "with r as (select rec_key, case when kind = 'camp' then 'camp' when coalesce(kind, 'unknown') = 'unknown' then 'unconfirmed' end as reason from source_record where rec_key is not null) select rec_key, min(reason) as reason from r group by 1 having bool_and(reason is not null)",
    "refused_readings": "select source, count_if(retrieved_at >= timestamp '2024-01-01') as found, count_if(retrieved_at < timestamp '2024-01-01') as held, count_if(retrieved_at >= timestamp '2024-01-01') = 0 or count_if(retrieved_at >= timestamp '2024-01-01') < 0.7 * count_if(retrieved_at < timestamp '2024-01-01') as refused from source_record where retrieved_at is not null group by 1",
    "nudged_regions": f"""with {_P}, {_POLY}, q as (select id, lat, lon, 0 as way from p union all select id, lat + dy, lon + dx, 1 from p, {_NUDGES}), h as (select q.id, q.way, q.lat, q.lon, code, pid from q, e group by 1, 2, 3, 4, 5, 6 having {_HOLDS.format(x='q.lon', y='q.lat')}),
 d as (select id, min(code) as code from h where way = 0 group by 1), n as (select id, lat, lon, min(code) as code from h where way = 1 and id not in (select id from d) group by 1, 2, 3)
 select id, code, false as nudged from d union all select id, min(code), true from n group by id having min(code) = max(code)""",
    "unique_countries": f"with {_P}, b as (select country, y0, y1, x0, x1 from region_polygon join (select distinct region, country from county) on code = region) select id, min(country) as country from p join b on lat between y0 and y1 and lon between x0 and x1 group by id having count(distinct country) = 1",
    "near_misses": f"""with {_P}, k as (select p.*, {_KEY.format('name')} as k from p join tower using (id)), d as (select a.id as id_a, b.id as id_b, {_DIST.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} as m, 1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k), 1) as s from k a join k b on a.id < b.id and abs(a.lat - b.lat) < 0.04)
 select id_a, id_b, round(m, 3) as metres, round(s, 6) as score from d where m <= 300 or (m <= 3000 and s >= 0.5)""",
    "dead_reckoning": f"""with w as (select region || '|' || {_KEY.format('name')} as town, arg_min(lat, county_id) as lat, arg_min(lon, county_id) as lon from county group by 1), n as (select id, lat, lon, radians(length(name) * 7.0) as b, 16093.44 / 6371008.8 as d from tower t join w on t.region || '|' || {_KEY.format('t.county')} = town where t.county is not null),
 y as (select *, asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(b)) as y from n) select id, round(degrees(y), 5) as lat, round((degrees(radians(lon) + atan2(sin(b) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(y))) + 540) % 360 - 180, 5) as lon from y""",
    "placed_rentals": f"""with r as (select record_id as key, region, rental.ridb_facility_id as f, coalesce({_KEY.format('name')}, '') as n, coalesce({_LOOSE.format(_KEY.format('name'))}, '') as l from source_record where rental is not null),
 t as (select id as tower, region, case when length(name) % 7 = 0 then 'f' || id end as f, {_KEY.format('name')} as n, {_LOOSE.format(_KEY.format('name'))} as l, coalesce(status, 'unknown') = 'gone' as gone from tower),
 a as (select key, min(tower) as tower, 'facility' as stage, 2 as rank from r join t using (f) group by key),
 g as (select key, count(*) as c, min(tower) as one, count_if(t.f is not null) as nr, min(tower) filter (t.f is not null) as rt, count_if(not gone) as ns, min(tower) filter (not gone) as st from r join t using (region, n) where n <> '' group by key),
 b as (select key, case when c = 1 then one when nr = 1 then rt when ns = 1 then st end as tower from g), b2 as (select key, tower, case when tower is null then 'several' else 'name' end as stage, case when tower is null then 9 else 3 end as rank from b),
 c as (select key, min(tower) as tower, 'loose name' as stage, 4 as rank from r join t using (region, l) where l <> '' and t.f is not null group by key having count(*) = 1), u as (select * from a union all select * from b2 union all select * from c)
 select r.key, x.tower, coalesce(x.stage, 'none') as stage from r left join (select distinct on (key) * from u order by key, rank) x using (key)""",
    "region_centroids": """with g as (select code, x0, rings[1] as r from region_polygon), e as (select code, x0, r[1].lon as fx, r[1].lat as fy, r[i].lon - r[1].lon as px, r[i].lat - r[1].lat as py, r[i % len(r) + 1].lon - r[1].lon as qx, r[i % len(r) + 1].lat - r[1].lat as qy from (select *, unnest(range(1, len(r) + 1)) as i from g))
 select code, x0, round(any_value(fy) + sum((py + qy) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)), 8) as lat, round(any_value(fx) + sum((px + qx) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)), 8) as lon from e group by code, x0""",
    "sheet_ranking": f"with {_rank(1940, False, 'scale >= 48000')} select scan_id, place from rk",
    "sheets_of_towers": f"with {_P}, {_rank(2010, True, 'scale <= 125000 and scale <> 100000')} select id, arg_min(scan_id, place) as scan_id from p join rk on lon between x0 and x1 and lat between y0 and y1 group by id",
    "sheet_shares": f"""with {_rank(1850, False, f'scale >= 100000 and x0 < {VIEW[2]} and x1 > {VIEW[0]} and y0 < {VIEW[3]} and y1 > {VIEW[1]}')}, g as (select i, {VIEW[0]} + (i % 9 + 0.5) * ({VIEW[2] - VIEW[0]} / 9) as lon, {VIEW[1]} + (floor(i / 9) + 0.5) * ({VIEW[3] - VIEW[1]} / 7) as lat from (select unnest(range(63)) as i)),
 b as (select i, arg_min(scan_id, place) as scan_id from g join rk on lon between x0 and x1 and lat between y0 and y1 group by i) select scan_id, round(count(*) / 63, 6) as share from b group by 1""",
    "identities": "select slug, lat4, lon4, first(url order by -length(url), url) filter (url is not null) as url, count(*) as views from (select *, trim(regexp_replace(regexp_replace(replace(replace(lower(strip_accents(name)), '&amp;', ' and '), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') as slug, floor(lat * 10000 + 0.5) / 10000 as lat4, floor(lon * 10000 + 0.5) / 10000 as lon4 from source_record where name is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)) group by 1, 2, 3",
    "wanted_places": f"select id from tower t where exists (select 1 from source_record r where r.lat is null and r.region = t.region and {_KEY.format('r.name')} = {_KEY.format('t.name')} and {_KEY.format('r.name')} <> '')",
    "names_of_regions": "select region, count(distinct county) as n, string_agg(distinct county, '|' order by county) as names from source_record where region is not null and county is not null group by 1",
    "design_counts": "with f as (select feature_id, coalesce(m, 'other') as m, unnest(string_split(d, '|')) as design from map_feature), n as (select design, m, count(distinct feature_id) as n from f where design <> '' group by 1, 2) select design, sum(n)::bigint as features, first(m order by n desc, m) as material from n group by 1",
    "warning_templates": "select 'position #, # is outside ' || coalesce(region, 'its region') as warning, count(*) as n from source_record where (abs(lat) > 90 or abs(lon) > 180 or lon > 0) and not (lat is null or lon is null or isnan(lat) or isnan(lon)) group by 1 union all select null, count(*) from source_record where (abs(lat) > 90 or abs(lon) > 180 or lon > 0) and (lat is null or lon is null or isnan(lat) or isnan(lon)) having count(*) > 0",
    "regions_by_country": "select country, string_agg(distinct region, ',' order by region) as regions from tower group by 1",
    "batches_of_three": "select id, region, ((row_number() over (partition by region order by id) - 1) // 3)::int as batch from tower",
    "source_pages": "with x as (select record_id, unnest(range(len(links)))::int as pos, links from source_record), y as (select record_id, pos, links[pos + 1] as l, row_number() over (partition by record_id order by pos) as n from x where links[pos + 1].url is not null) select record_id, pos, l.url as url from y where n <= 2 or l.kind = 'relocated_from'",
    "imported_marks": """with o as (select region, min(id) as old from tower where hidden group by 1), w as (select region, min(id) as new from tower where not hidden group by 1), m as (select coalesce(new, id) as id, length(name) % 2 = 0 as stayed from tower t left join (select old, new from o join w using (region)) on id = old)
 select distinct id, unnest(case when stayed then ['stayed', 'visited'] else ['want'] end) as mark from m""",
    "one_name_each": "select title, doc_id, lang from documents where title is not null qualify row_number() over (partition by title order by (coalesce(lang, '') <> 'en')::int, doc_id) = 1",
    "association_rules": " union all ".join(f"select record_id, 'error' as level, '{m}' as message from source_record where {c}" for m, c in _RULES.items()),
}
