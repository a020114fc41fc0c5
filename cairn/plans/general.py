"""Queries of the general problems: points near points, nested records, quantities in mixed units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import nested, proximity, units
from cairn.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return proximity.near_pairs(table(spark, sf, "source_record"), 250.0)


def p1_region(spark: SparkSession, sf: str) -> DataFrame:
    return proximity.region_of(table(spark, sf, "source_record"), table(spark, sf, "region_polygon"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.linked_children(table(spark, sf, "source_record"))


def _child(name: str) -> Query:
    return lambda spark, sf: getattr(nested, name)(table(spark, sf, "source_record"))


def p2_reports(spark: SparkSession, sf: str) -> DataFrame:
    return nested.reports(table(spark, sf, "source_record"))


def p2_cites(spark: SparkSession, sf: str) -> DataFrame:
    return nested.cites(table(spark, sf, "source_record"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.lengths_in_metres(table(spark, sf, "source_record"), table(spark, sf, "source_info"))


def p5_switches(spark: SparkSession, sf: str) -> DataFrame:
    """Per source and quantity: readings by decoded unit."""
    r = units.length_readings(table(spark, sf, "source_record"), table(spark, sf, "source_info"))
    got = units.decode(r.withColumn("device", F.concat_ws("\1", "device", "quantity")))
    return got.groupBy(F.substring_index("device", ":", 1).alias("source"), "quantity", "unit").agg(F.count(F.lit(1)).alias("readings"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_region": p1_region,
    "p2_found": p2_found,
    "p2_registers": _child("registers"),
    "p2_events": _child("events"),
    "p2_event_urls": _child("event_urls"),
    "p2_rental_rules": _child("rental_rules"),
    "p2_reports": p2_reports,
    "p2_cites": p2_cites,
    "p5_found": p5_found,
    "p5_switches": p5_switches,
}

_USABLE = "lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)"
_PAYLOAD = """payload as (select record_id, case when not json_valid(extra) then null when json_type(extra) = 'VARCHAR'
  then case when json_valid(extra ->> '$') then extra ->> '$' end else extra end as x from source_record where extra is not null),
 listed as (select record_id, json_type(x, '$.reports') = 'ARRAY' as many, json_extract(x, '$.reports') as r from payload
  where json_type(x) = 'OBJECT' and json_type(x, '$.reports') in ('ARRAY', 'OBJECT')),
 report as (select record_id, pos, json_extract(r, '$[' || pos || ']') as v from listed, lateral unnest(range(0, json_array_length(r)::bigint)) as u(pos) where many
  union all select record_id, 0, r from listed where not many),
 cited as (select record_id, pos, json_type(v, '$.cites') = 'ARRAY' as many, json_extract(v, '$.cites') as c from report where json_type(v, '$.cites') is not null and json_type(v, '$.cites') <> 'NULL'),
 cite as (select record_id, pos, sub_pos, json_extract(c, '$[' || sub_pos || ']') as v from cited, lateral unnest(range(0, json_array_length(c)::bigint)) as u(sub_pos) where many
  union all select record_id, pos, 0, c from cited where not many)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""with p as (select record_id, lat, lon from source_record where {_USABLE})
 select a.record_id as record_id_a, b.record_id as record_id_b from p a join p b on a.record_id < b.record_id and abs(a.lat - b.lat) < 0.01
 where 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 250""",
    "p1_region": f"""with p as (select record_id, lat, lon from source_record where {_USABLE}),
 ring as (select code, row_number() over () as poly, x0, y0, x1, y1, rings from region_polygon),
 flat as (select code, poly, x0, y0, x1, y1, unnest(rings) as ring from ring),
 edge as (select code, poly, x0, y0, x1, y1, ring[i] as p, ring[case when i = len(ring) then 1 else i + 1 end] as q from flat, lateral unnest(range(1, len(ring) + 1)) as u(i)),
 inside as (select record_id, code, poly from p join edge on lon between x0 and x1 and lat between y0 and y1
  where (p.lat < edge.p.lat) <> (p.lat < edge.q.lat) and p.lon < (edge.q.lon - edge.p.lon) * (p.lat - edge.p.lat) / (edge.q.lat - edge.p.lat) + edge.p.lon
  group by record_id, code, poly having count(*) % 2 = 1)
 select record_id, min(code) as code from inside group by record_id""",
    "p2_found": f"""with {_PAYLOAD}
 select record_id, 'register' as child, (i - 1)::int as pos, -1 as sub_pos from (select record_id, registers, unnest(range(1, len(registers) + 1)) as i from source_record) where registers[i] is not null
 union all select record_id, 'event', (i - 1)::int, -1 from (select record_id, events, unnest(range(1, len(events) + 1)) as i from source_record) where events[i] is not null
 union all select record_id, 'event_url', (i - 1)::int, (j - 1)::int from (select record_id, i, u, unnest(range(1, len(u) + 1)) as j from
  (select record_id, i, events[i].source_urls as u from (select record_id, events, unnest(range(1, len(events) + 1)) as i from source_record))) where u[j] is not null
 union all select record_id, 'rental', 0, -1 from source_record where rental is not null
 union all select record_id, 'rental_rule', 0, (j - 1)::int from (select record_id, rental.rules as r, unnest(range(1, len(rental.rules) + 1)) as j from source_record) where r[j] is not null
 union all select record_id, 'report', pos::int, -1 from report where json_type(v) <> 'NULL'
 union all select record_id, 'report_cite', pos::int, sub_pos::int from cite where json_type(v) <> 'NULL'""",
    "p2_registers": """select record_id, (i - 1)::int as pos, x.register as register, x.number as number, x.state_number as state_number, x.url as url
 from (select record_id, i, registers[i] as x from (select record_id, registers, unnest(range(1, len(registers) + 1)) as i from source_record)) where x is not null""",
    "p2_events": """select record_id, (i - 1)::int as pos, x.year as year, x.event as event, x.note as note, x.from_source as from_source, x.source_url as source_url
 from (select record_id, i, events[i] as x from (select record_id, events, unnest(range(1, len(events) + 1)) as i from source_record)) where x is not null""",
    "p2_event_urls": """select record_id, (i - 1)::int as pos, (j - 1)::int as sub_pos, u[j] as url from (select record_id, i, u, unnest(range(1, len(u) + 1)) as j from
  (select record_id, i, events[i].source_urls as u from (select record_id, events, unnest(range(1, len(events) + 1)) as i from source_record))) where u[j] is not null""",
    "p2_rental_rules": "select record_id, (j - 1)::int as sub_pos, r[j] as rule from (select record_id, rental.rules as r, unnest(range(1, len(rental.rules) + 1)) as j from source_record) where r[j] is not null",
    "p2_reports": f"with {_PAYLOAD} select record_id, pos::int as pos, v ->> '$.title' as title, v ->> '$.year' as year from report where json_type(v) <> 'NULL'",
    "p2_cites": f"""with {_PAYLOAD} select record_id, pos::int as pos, sub_pos::int as sub_pos, case when json_type(v) = 'OBJECT' then v ->> '$.page' else v ->> '$' end as page,
 case when json_type(v) = 'OBJECT' then v ->> '$.quote' end as quote from cite where json_type(v) <> 'NULL'""",
}
