"""Queries of readers and sinks: pages and files are made of the tables, read back, and compared with the tables by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources import readers, sinks
from cairn.session import shared_folder, table


def _t(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tower")


def _counties(spark: SparkSession, sf: str) -> DataFrame:
    """A small fixed table, for files that hold one document."""
    return table(spark, sf, "county")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"


def _landed(document: DataFrame) -> str:
    """Writes a frame of one text as files; gives their folder."""
    path = _folder(document.sparkSession)
    document.coalesce(1).write.text(path)
    return path


def _joined(rows: DataFrame, each: Column, before: str, after: str, by: str | None = None) -> DataFrame:
    """Texts of the rows in the order of county_id, in one document, or one for each value of a column."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("county_id", each.alias("t")))), lambda x: x.t)
    text = F.concat(F.lit(before), F.array_join(parts, "," if before.endswith("[") else ""), F.lit(after)).alias("value")
    return rows.groupBy(*([by] if by else [])).agg(text)


def html_lists(spark: SparkSession, sf: str) -> DataFrame:
    """S-09, S-14: a page for each region, its list under headers of several words, the columns in another order than asked for."""
    row = F.concat(F.lit("<tr><td>"), F.col("county_id"), F.lit("</td><td><b>"), F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("</b> </td></tr>\n"))
    pages = _joined(_counties(spark, sf), row, "<table><tr><th>NHLR registry number</th><th>Lookout Name</th></tr>", "</table>", "region")
    got = readers.html_rows(pages, "region", "value")
    return got.select("region", "pos", F.try_element_at("cells", F.lit("number")).alias("number"), F.try_element_at("cells", F.lit("name")).alias("name"))


def detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """S-10, S-11, F-60: a page for each tower, with feet for metres."""
    cell = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f"<tr><td>{label}:</td><td>"), value, F.lit("</td></tr>")))
    feet = F.concat(F.format_number("elevation_m", 1), F.lit(" ft"))
    at = F.concat(F.format_string("%.5f", "location.lat"), F.lit(", "), F.format_string("%.5f", "location.lon"))
    rows = F.concat_ws("", cell("Coordinates", F.when(F.col("location.lat").isNotNull() & F.col("location.lon").isNotNull(), at)), cell("Status", F.col("status")), cell("Elevation", feet), cell("Removed", F.when(F.col("status") == "gone", F.lit("burned about 1962-1964"))))
    html = F.concat(F.lit("<html><h1>"), F.col("name"), F.lit("</h1><table>"), rows, F.lit("</table></html>"))
    got = readers.detail_pages(_t(spark, sf).select("id", html.alias("html")), "id", "html", "natreg")
    return got.select("id", F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name"), "status", F.round("elevation_m", 1).alias("elevation_m"), "lat", "lon", "removed.year", "removed.event")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """S-13: links of pages made of records' links."""
    a = F.transform("links", lambda x: F.when(x.url.isNotNull(), F.concat(F.lit('<li><a class="x" href="'), x.url, F.lit('">'), F.coalesce(x.label, F.lit("")), F.lit("</a></li>"))))
    pages = table(spark, sf, "source_record").where("size(links) > 0").select("record_id", F.concat_ws("", a).alias("html"))
    return readers.links(pages, "record_id", "html").select("record_id", "url")


def page_photos(spark: SparkSession, sf: str) -> DataFrame:
    """S-12: figures of pages made of records' photos."""
    f = F.transform("photos", lambda x: F.when(x.url.isNotNull(), F.concat(F.lit('<figure><img src="'), x.url, F.lit('"><figcaption>taken in '), F.coalesce(x.year, F.lit(1900)).cast("string"), F.lit(". Photo by: "), F.coalesce(x.credit, F.lit("nobody")), F.lit("</figcaption></figure>"))))
    pages = table(spark, sf, "source_record").where("size(photos) > 0").select("record_id", F.concat_ws("", f).alias("html"))
    return readers.photos(pages, "record_id", "html").select("record_id", "url", "credit", "year")


def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    """S-30: a page for each region with a heading for each county."""
    part = F.concat(F.lit("<h2>"), F.col("name"), F.lit("</h2><p>at "), F.col("county_id"), F.lit("</p>"))
    return readers.headed_sections(_joined(_counties(spark, sf), part, "", "", "region"), "region", "value").select("region", "heading", "text")


def script_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """S-17: a page for each region with its counties as a script's literal."""
    pages = _joined(_counties(spark, sf), F.to_json(F.struct("county_id", "lat", "lon")), "<script>var markers = [", "];</script>", "region")
    return readers.page_table(pages, "region", "value", "markers", "county_id: string, lat: double, lon: double")


def geojson_points(spark: SparkSession, sf: str) -> DataFrame:
    """S-03, S-24"""
    f = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("county_id", "name").alias("properties")))
    return readers.geojson(spark, _landed(_joined(_counties(spark, sf), f, '{"type": "FeatureCollection", "features": [', "]}")), "county_id: STRING, name: STRING")


def overpass_elements(spark: SparkSession, sf: str) -> DataFrame:
    """S-07, P-09: nodes with their position, ways with their centre."""
    c = _counties(spark, sf).withColumn("n", F.abs(F.xxhash64("county_id")) % 2)
    way = F.col("n") == 1
    e = F.to_json(F.struct(F.when(way, "way").otherwise("node").alias("type"), F.crc32("county_id").alias("id"), F.when(~way, F.col("lat")).alias("lat"), F.when(~way, F.col("lon")).alias("lon"), F.when(way, F.struct("lat", "lon")).alias("center"), F.create_map(F.lit("name"), F.concat("name", F.lit(" Fire Tower")), F.lit("county_id"), F.col("county_id")).alias("tags")))
    got = readers.overpass(spark, _landed(_joined(c, e, '{"elements": [', "]}")))
    return got.where(readers.fire_evidence(F.col("tags"))).select(F.try_element_at("tags", F.lit("county_id")).alias("county_id"), "lat", "lon")


def sparql_rows(spark: SparkSession, sf: str) -> DataFrame:
    """S-08"""
    value = lambda c: F.struct(c.alias("value"))
    b = F.to_json(F.struct(value(F.col("county_id")).alias("item"), value(F.concat(F.lit("Point("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))).alias("coord")))
    return readers.bindings(spark, _landed(_joined(_counties(spark, sf), b, '{"results": {"bindings": [', "]}}")), ["item", "coord"]).select("item", "lat", "lon")


def waypoints(spark: SparkSession, sf: str) -> DataFrame:
    """S-23"""
    w = F.concat(F.lit('<wpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"><name>'), F.col("county_id"), F.lit("</name></wpt>"))
    return readers.gpx(spark, _landed(_joined(_counties(spark, sf), w, "<gpx>", "</gpx>"))).select("name", "lat", "lon")


def extract_records(spark: SparkSession, sf: str) -> DataFrame:
    """S-01: an extract of the counties as records, read back with its place in the list."""
    r = F.to_json(F.struct(F.col("county_id").alias("key"), "name", "country", "region", "lat", "lon"))
    return readers.extracts(spark, _landed(_joined(_counties(spark, sf), r, '{"source": "counties", "records": [', "]}"))).select("source", "pos", "key", "name", "lat", "lon")


def csv_pages(spark: SparkSession, sf: str) -> DataFrame:
    """S-05: towers in pages of CSV, concatenated."""
    path = _folder(spark)
    _t(spark, sf).select("id", "region", "status").repartition(3, "id").write.option("header", True).csv(path)
    return readers.csv_pages(spark, path)


def cell_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """K-04, O-07: one-degree chunks of the towers, read back."""
    path = _folder(spark)
    p = _t(spark, sf).where("location.lat is not null and location.lon is not null").select("id", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))
    index = sinks.write_cells(p, path)
    back = spark.read.schema("id string, lat double, lon double, cell string").parquet(path)
    return back.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).join(index, "cell").where("n = count").select("cell", "n", "first")


def written_extract(spark: SparkSession, sf: str) -> DataFrame:
    """K-01, K-02: towers as an extract in the order of their key, read back; no problem is given, so it isn't refused."""
    path = _folder(spark)
    sinks.write_extract(_t(spark, sf).select(F.col("id").alias("key"), "status"), path, _t(spark, sf).where("id is null"))
    return spark.read.schema("key string, status string").json(path)


def rewritten_rows(spark: SparkSession, sf: str) -> DataFrame:
    """K-06: of the towers what a run must write again: those gone, whose status reads otherwise now."""
    old = _t(spark, sf).select("id", "status", "kind")
    new = old.withColumn("status", F.when(F.col("status") == "gone", "ruins").otherwise(F.col("status")))
    return sinks.changed_rows(new, old, "id").select("id", "status")


def manifest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """K-10: photos of 2024's deliveries in place of the manifest's older entries."""
    p = table(spark, sf, "source_record").select("retrieved_at", F.inline("photos")).where("url is not null").select("url", "credit", (F.col("retrieved_at") >= F.lit("2024-01-01").cast("timestamp_ntz")).alias("new"))
    one = lambda d: d.groupBy("url").agg(F.min("credit").alias("credit"))
    return sinks.upsert_manifest(one(p.where("not new")), one(p.where("new")))


QUERIES = {
    f.__name__: f
    for f in (
        html_lists, detail_pages, page_links, page_photos, page_sections, script_arrays, geojson_points, overpass_elements, sparql_rows, waypoints, extract_records, csv_pages, cell_chunks, written_extract, rewritten_rows,
        manifest_upsert,
    )
}

ORACLE: dict[str, str] = {
    "html_lists": "select region, row_number() over (partition by region order by county_id)::int - 1 as pos, county_id as number, name from county",
    "detail_pages": """select id, nullif(trim(regexp_replace(name, '\\s+', ' ', 'g')), '') as name, status, round_even(round(elevation_m, 1) * 0.3048, 1) as elevation_m, case when location.lat is not null and location.lon is not null then round(location.lat, 5) end as lat, case when location.lat is not null and location.lon is not null then round(location.lon, 5) end as lon,
 case when status = 'gone' then 1964 end as year, case when status = 'gone' then 'burned' end as event from tower""",
    "page_links": "with l as (select record_id, unnest(links) as l from source_record) select distinct record_id, l.url as url from l where l.url is not null",
    "page_photos": "with p as (select record_id, unnest(photos) as p, unnest(range(len(photos))) as i from source_record) select record_id, p.url as url, coalesce(first(trim(p.credit) order by i), 'nobody') as credit, coalesce(first(p.year order by i), 1900) as year from p where p.url is not null group by 1, 2",
    "page_sections": "select region, name as heading, 'at ' || county_id as text from county",
    "script_arrays": "select region, county_id, lat, lon from county",
    "geojson_points": "select county_id, name, lon, lat from county",
    "overpass_elements": "select county_id, lat, lon from county",
    "sparql_rows": "select county_id as item, lat, lon from county",
    "waypoints": "select county_id as name, lat, lon from county",
    "extract_records": "select 'counties' as source, row_number() over (order by county_id)::int - 1 as pos, county_id as key, name, lat, lon from county",
    "csv_pages": "select id, region, status from tower",
    "cell_chunks": "select floor(location.lat)::int || '_' || floor(location.lon)::int as cell, count(*) as n, min(id) as first from tower where location.lat is not null and location.lon is not null group by 1",
    "written_extract": "select id as key, status from tower",
    "rewritten_rows": "select id, 'ruins' as status from tower where status = 'gone'",
    "manifest_upsert": "with p as (select retrieved_at, unnest(photos) as p from source_record), q as (select p.url as url, p.credit as credit, coalesce(retrieved_at >= timestamp '2024-01-01', false) as new, retrieved_at is not null as dated from p where p.url is not null) select url, min(credit) as credit from q where dated and (new or url not in (select url from q where new)) group by url",
}
