"""Queries over map features: filters, facets, years, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import filters, search, temporal
from cairn.session import table
from cairn.vocab import THIS_YEAR


def _f(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "map_feature")


QUERY = "status=standing,ruins&kind=tower,ground,enclosed_tower&country=US"
_IDS = "feature_id"


def filter_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    """P-01, P-02"""
    return filters.apply(_f(spark, sf), filters.parse(QUERY).filters).select("feature_id", "i", "k", "s", "r")


def filter_empty_set(spark: SparkSession, sf: str) -> DataFrame:
    return filters.apply(_f(spark, sf), filters.parse("status=none").filters).select("feature_id")


def filter_region_registered(spark: SparkSession, sf: str) -> DataFrame:
    return filters.apply(_f(spark, sf), filters.parse("state=TR&country=CA&reg=1&ns=1&ap=0").filters).select("feature_id", "k")


def filter_design(spark: SparkSession, sf: str) -> DataFrame:
    """P-07"""
    return filters.apply(_f(spark, sf), filters.Filters(design="D-6", no_structure=True)).select("feature_id", "d")


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    """A list of marks: old towers visited, some of them stayed at, those to rent wanted."""
    f = _f(spark, sf)
    mark = F.array_compact(F.array(F.when(F.col("b") < 1930, "visited"), F.when(F.col("b") < 1910, "stayed"), F.when(F.col("rt") == 1, "want")))
    return f.select(F.col("i").alias("id"), F.explode(mark).alias("mark"))


def filter_mine(spark: SparkSession, sf: str) -> DataFrame:
    """P-01's checklist term, U-11"""
    return filters.apply(_f(spark, sf), filters.parse("mine=stayed,want,bogus&ns=1").filters, _marks(spark, sf)).select("feature_id", "i")


def mark_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-14: towers with each mark, and with any."""
    return _marks(spark, sf).rollup("mark").agg(F.count_distinct("id").alias("towers"))


def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-02"""
    return filters.facet_counts(_f(spark, sf), filters.parse(QUERY).filters)


LINKS = ("status=gone,standing", "kind=none&state=or", "country=CA&rent=1", "state=WA&country=US&yr=1933&yrm=1", "bogus=1&status=zzz", "vs=us-or-b,us-or-a,us-or-b,x&vr=60&ap=0", "at=7.256/45.5/-120.12345&t=us-or-warner-mountain&base=old&op=50&era=newest", "mine=want,visited&ver=verified&mat=log&design=l4&reg=1&ns=1", "at=99/0/0&yr=1700&op=5&base=x&vr=30")


def query_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """P-03, P-05, P-06"""
    states = [(q, filters.parse(q)) for q in LINKS]
    return spark.createDataFrame([(q, filters.serialize(s), filters.active_count(s.filters)) for q, s in states], "query string, canonical string, active int")


def year_counts(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.year_counts(_f(spark, sf), 1940)


def year_series(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.year_series(_f(spark, sf), 1900, THIS_YEAR)


def year_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.year_range(table(spark, sf, "source_record"), "record_id")


def event_gaps(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "source_record").select("record_id", F.inline("events")).select("record_id", "year").distinct()
    return temporal.gaps(e, "record_id")


def timeline_segments(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.segments(_f(spark, sf), "feature_id")


def history_counts(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.history_counts(_f(spark, sf))


def meta_counts(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf).withColumn("cc", F.coalesce("cc", F.lit("US")))
    return f.groupingSets([["s"], ["k"], ["r"], ["cc"], ["v"], ["m"], []], "s", "k", "r", "cc", "v", "m").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))


def name_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(_f(spark, sf), "north")


def name_search_words(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(_f(spark, sf), "moun tr")


def first_built(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "source_record")
    built = F.array_min(F.transform(F.filter("events", lambda x: x.event == "built"), lambda x: x.year))
    return e.select("record_id", built.alias("first_built")).where("first_built is not null")


def rentable(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "source_record").where("rental is not null")
    return r.groupBy("region").agg(F.count(F.lit(1)).alias("rentals"), F.count_if(F.coalesce("rental.available", F.lit(True))).alias("rentable"))


def source_words(spark: SparkSession, sf: str) -> DataFrame:
    """Source words of each kind by how often they are used (A-24), top five."""
    from pyspark.sql.window import Window as W

    c = table(spark, sf, "source_record").where("kind is not null and type_raw is not null").groupBy("kind", F.lower("type_raw").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "word"))).where("place <= 5")


QUERIES = {f.__name__: f for f in (filter_conjunction, filter_empty_set, filter_region_registered, filter_design, filter_mine, mark_counts, facet_counts, query_round_trip, year_counts, year_series, year_ranges, event_gaps, timeline_segments, history_counts, meta_counts, name_search, name_search_words, first_built, rentable, source_words)}

_STATE = """case when {y} >= 2026 then case when st in ('standing', 'replica') then 'stood' when st <> 'unknown' or y1 is not null then 'no' when y0 is null then 'nodates' else 'built' end
 when y0 > {y} or y1 <= {y} then 'no' when st in ('standing', 'replica') or y1 is not null then case when y0 is not null then 'stood' else 'nostart' end when y0 is not null then 'built' else 'nodates' end"""
_YEARS = "count_if(state = 'stood') as stood, count_if(state = 'built') as built, count_if(state = 'nostart') as nostart, count_if(state = 'nodates') as nodates, count_if(state <> 'no') as upper"
_S, _K = "s in ('standing', 'ruins')", "k in ('tower', 'ground', 'enclosed_tower')"
_C = "coalesce(cc, case when r in ('AB', 'BC', 'MB', 'NB', 'NL', 'NS', 'NT', 'NU', 'ON', 'PE', 'QC', 'SK', 'YT') then 'CA' end, 'US') = 'US'"
_ST = "coalesce(k, '') not in ('camp', 'tree', 'point')"
_MARKS = "m as (select i as id, unnest(list_filter([case when b < 1930 then 'visited' end, case when b < 1910 then 'stayed' end, case when rt = 1 then 'want' end], lambda x: x is not null)) as mark from map_feature)"
_NORMAL = "trim(regexp_replace(lower(strip_accents({x})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _search(q: str) -> str:
    names = f"list_filter(list_transform(list_filter(list_concat([n], coalesce(string_split(o, '|'), [])), lambda x: x is not null), lambda x: {_NORMAL.format(x='x')}), lambda x: x <> '')"
    words = "list_distinct(list_filter(flatten(list_transform(list_concat(names, [lower(coalesce(r, ''))]), lambda x: string_split(x, ' '))), lambda x: x <> ''))"
    tokens = " and ".join(f"len(list_filter(words, lambda w: starts_with(w, '{t}'))) > 0" for t in q.split())
    return f"""with ix as (select i, n, r, {names} as names from map_feature), iw as (select *, {words} as words from ix),
 sc as (select i, n, r, case when len(list_filter(names, lambda x: starts_with(x, '{q}'))) > 0 then 0 when {tokens} then 1 when len(list_filter(names, lambda x: contains(x, '{q}'))) > 0 then 2 end as score from iw),
 one as (select distinct on (i) * from sc where score is not null order by i, score, length(n), n, r)
 select i, n, r, score from one order by score, length(n), n, i limit 30"""


ORACLE = {
    "filter_conjunction": f"select feature_id, i, k, s, r from map_feature where {_S} and {_K} and {_C}",
    "filter_empty_set": "select feature_id from map_feature where false",
    "filter_region_registered": "select feature_id, k from map_feature where r = 'TR' and rg = 1 and coalesce(ap, 0) <> 1",
    "filter_design": "select feature_id, d from map_feature where list_contains(string_split(d, '|'), 'D-6')",
    "facet_counts": " union all ".join(
        f"select '{name}' as facet, {c} as value, count(*) as n from map_feature where {c} is not null and {where} group by {c}"
        for name, c, where in (
            ("status", "s", f"{_K} and {_ST} and {_C}"),
            ("kind", "k", f"{_S} and {_ST} and {_C}"),
            ("verification", "v", f"{_S} and {_K} and {_ST} and {_C}"),
            ("region", "r", f"{_S} and {_K} and {_ST}"),
        )
    ),
    "filter_mine": f"with {_MARKS} select feature_id, i from map_feature where i in (select id from m where mark in ('stayed', 'want'))",
    "mark_counts": f"with {_MARKS} select mark, count(distinct id) as towers from m group by rollup(mark)",
    "query_round_trip": """select * from (values ('status=gone,standing', 'status=standing,gone', 1), ('kind=none&state=or', 'kind=none&state=OR', 2), ('country=CA&rent=1', 'rent=1&country=CA', 2),
 ('state=WA&country=US&yr=1933&yrm=1', 'state=WA&yr=1933&yrm=1', 1), ('bogus=1&status=zzz', '', 0), ('vs=us-or-b,us-or-a,us-or-b,x&vr=60&ap=0', 'ap=0&vs=us-or-b,us-or-a&vr=60', 1),
 ('at=7.256/45.5/-120.12345&t=us-or-warner-mountain&base=old&op=50&era=newest', 'at=7.26/45.5/-120.1235&t=us-or-warner-mountain&base=old&era=newest&op=50', 0),
 ('mine=want,visited&ver=verified&mat=log&design=l4&reg=1&ns=1', 'ver=verified&reg=1&mine=visited,want&design=l4&mat=log&ns=1', 6), ('at=99/0/0&yr=1700&op=5&base=x&vr=30', '', 0)) as t(query, canonical, active)""",
    "year_counts": f"with f as (select *, coalesce(s, 'unknown') as st from map_feature), c as (select {_STATE.format(y=1940)} as state from f) select 1940 as year, {_YEARS} from c",
    "year_series": f"""with y as (select unnest(range(1900, 2027))::int as year), f as (select *, coalesce(s, 'unknown') as st from map_feature), c as (select year, {_STATE.format(y='year')} as state from y, f)
 select year, {_YEARS} from c group by year""",
    "year_ranges": """with e as (select record_id, status, list_filter(coalesce(events, []), lambda x: x is not null and x.year between 1800 and 2026) as e from source_record),
 p as (select record_id, status, list_transform(list_filter(e, lambda x: x.event in ('built', 'rebuilt', 'replaced', 'moved_in')), lambda x: x.year) as st,
  list_transform(list_filter(e, lambda x: x.event in ('abandoned', 'burned', 'destroyed', 'removed', 'relocated', 'collapsed')), lambda x: x.year) as en,
  list_max(list_transform(list_filter(e, lambda x: x.event in ('built', 'rebuilt', 'replaced')), lambda x: x.year)) as lb from e)
 select record_id, list_min(st) as y0, case when coalesce(status, 'unknown') not in ('standing', 'replica') then list_min(list_filter(en, lambda y: lb is null or y >= lb)) end as y1 from p""",
    "event_gaps": """with e as (select distinct record_id, x.year as year from (select record_id, unnest(events) as x from source_record) where x.year is not null),
 g as (select record_id, lag(year) over (partition by record_id order by year) as from_year, year as to_year from e) select * from g where to_year - from_year >= 15""",
    "timeline_segments": """with b as (select feature_id, y0, y1, coalesce(s, '') in ('standing', 'replica') as st from map_feature),
 x as (select feature_id, 'stood' as phase, y0 as from_year, coalesce(y1, case when st then 2026 end) as to_year from b where y0 is not null
  union all select feature_id, 'unknown', y0, 2026 from b where y0 is not null and y1 is null and not st union all select feature_id, 'gone', y1, 2026 from b where y1 is not null and not st)
 select * from x where to_year > from_year""",
    "history_counts": """select coalesce(cc, 'US') as country, count(*) as total, count_if(y0 is not null) as with_start, count_if(y1 is not null) as with_end, count_if(y0 is not null and y1 is not null) as with_both,
 count_if(coalesce(s, '') in ('standing', 'replica')) as standing, count_if(coalesce(s, '') in ('standing', 'replica') and y0 is not null) as standing_dated, count_if(coalesce(s, '') = 'gone') as gone, count_if(coalesce(s, '') = 'gone' and y1 is not null) as gone_dated
 from map_feature group by rollup(coalesce(cc, 'US'))""",
    "meta_counts": """with f as (select s, k, r, coalesce(cc, 'US') as cc, v, m from map_feature)
 select s, k, r, cc, v, m, grouping(s, k, r, cc, v, m) as gid, count(*) as n from f group by grouping sets ((s), (k), (r), (cc), (v), (m), ())""",
    "name_search": _search("north"),
    "name_search_words": _search("moun tr"),
    "first_built": "select record_id, list_min(list_transform(list_filter(events, lambda x: x.event = 'built'), lambda x: x.year)) as first_built from source_record where list_min(list_transform(list_filter(events, lambda x: x.event = 'built'), lambda x: x.year)) is not null",
    "rentable": "select region, count(*) as rentals, count_if(coalesce(rental.available, true)) as rentable from source_record where rental is not null group by region",
    "source_words": """with c as (select kind, lower(type_raw) as word, count(*) as n from source_record where kind is not null and type_raw is not null group by 1, 2)
 select kind, word, n, row_number() over (partition by kind order by n desc, word) as place from c qualify place <= 5""",
}
