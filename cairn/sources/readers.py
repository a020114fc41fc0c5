"""Readers of landed files: each gives a DataFrame, formats as Spark reads them or parsed in Arrow batches."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.prose import YEAR, removed_event

RECORD = """source STRING, title STRING, url STRING, retrieved STRING, license STRING, records ARRAY<STRUCT<key: STRING, url: STRING, name: STRING, country: STRING, region: STRING, county: STRING, lat: DOUBLE, lon: DOUBLE,
 elevation_m: DOUBLE, type_raw: STRING, kind: STRING, status_raw: STRING, status: STRING, built: INT, agency: STRING, extra: STRING>>, _corrupt STRING"""


def extracts(spark: SparkSession, path: str) -> DataFrame:
    """Records of extract files, one JSON document each; the file's name where no source is named; broken files give nothing."""
    d = spark.read.schema(RECORD).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("_file", F.col("_metadata.file_name"))
    stem = F.regexp_replace("_file", r"\.json$", "")
    return d.where("records is not null").select(F.coalesce("source", stem).alias("source"), F.posexplode("records").alias("pos", "r")).where("r is not null").select("source", "pos", "r.*")


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Point features of a collection: properties (a DDL schema), lon, lat."""
    schema = f"features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, properties: STRUCT<{properties}>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.where("f.geometry.type = 'Point'").select("f.properties.*", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def polygons(spark: SparkSession, path: str, code: str) -> DataFrame:
    """(code, rings, x0, y0, x1, y1) of the polygons of a collection; a multipolygon gives a row for each part."""
    schema = f"features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>, properties: STRUCT<{code}: STRING>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    g = f.select(F.col(f"f.properties.{code}").alias("code"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    one = F.array(F.from_json("c", "array<array<array<double>>>"))
    parts = g.select("code", F.explode(F.when(F.col("type") == "MultiPolygon", F.from_json("c", "array<array<array<array<double>>>>")).otherwise(one)).alias("p")).where("p is not null")
    rings = F.transform("p", lambda r: F.transform(r, lambda x: F.struct(F.get(x, F.lit(0)).alias("lon"), F.get(x, F.lit(1)).alias("lat"))))
    xs, ys = (F.transform(F.flatten("rings"), lambda x, n=n: x[n]) for n in ("lon", "lat"))
    return parts.select("code", rings.alias("rings")).select("code", "rings", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def members(spark: SparkSession, path: str, suffix: str, chunk: int = 1 << 20) -> DataFrame:
    """(file, member, part, content) of the members of ZIP files whose name ends so, in parts that end with a line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(suffix):
                            with z.open(name) as f:
                                for part, lines in enumerate(iter(lambda: f.readlines(chunk), [])):
                                    yield pd.DataFrame({"file": [p], "member": [name], "part": [part], "content": [b"".join(lines).decode("utf-8-sig" if part == 0 else "utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, part int, content string")


def zipped_pipes(spark: SparkSession, path: str, columns: list[str], suffix: str = ".txt") -> DataFrame:
    """Rows of pipe-delimited text in ZIP files, picked by the header's names, whatever their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in (n for n in z.namelist() if n.endswith(suffix)):
                        with z.open(name) as f:
                            lines = io.TextIOWrapper(f, "utf-8-sig", "replace")
                            head = [h.strip().lower() for h in lines.readline().rstrip("\r\n").split("|")]
                            at = [head.index(c) if c in head else None for c in columns]
                            rows = []
                            for line in lines:
                                cells = line.rstrip("\r\n").split("|")
                                rows.append([cells[i].strip() or None if i is not None and i < len(cells) else None for i in at])
                                if len(rows) == 50_000:
                                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                                    rows = []
                            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def summits(rows: DataFrame) -> DataFrame:
    """(id, name, lat, lon, region) of a gazetteer's named summits: not historical, at a position."""
    lat, lon = (F.expr(f"try_cast({c} as double)") for c in ("prim_lat_dec", "prim_long_dec"))
    s = rows.where((F.lower("feature_class") == "summit") & ~F.coalesce(F.lower("feature_name").contains("(historical)"), F.lit(False)))
    return s.select(F.col("feature_id").alias("id"), F.col("feature_name").alias("name"), lat.alias("lat"), lon.alias("lon"), F.col("state_alpha").alias("region")).where("name is not null and lat is not null and lon is not null and not (lat = 0 and lon = 0) and abs(lat) <= 90 and abs(lon) <= 180")


def csv_pages(spark: SparkSession, path: str) -> DataFrame:
    """All pages of a paged CSV download as one table."""
    return spark.read.option("header", True).csv(path)


def overpass(spark: SparkSession, path: str) -> DataFrame:
    """Elements of an Overpass answer: type, id, position (of a way its centre), tags."""
    schema = "elements ARRAY<STRUCT<type: STRING, id: BIGINT, lat: DOUBLE, lon: DOUBLE, center: STRUCT<lat: DOUBLE, lon: DOUBLE>, tags: MAP<STRING, STRING>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    return e.select("e.type", "e.id", F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"))


def fire_evidence(tags: Column) -> Column:
    """Do tags or the name tell of a fire lookout?"""
    pairs = (("tower:type", "observation"), ("man_made", "fire_lookout"), ("emergency", "fire_lookout"), ("historic", "fire_lookout"))
    out = F.coalesce(F.try_element_at(tags, F.lit("name")), F.lit("")).rlike(r"(?i)\b(fire\s*(lookout|tower)|lookout\s*tower)\b")
    for k, v in pairs:
        out = out | (F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")) == v)
    return out


def bindings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of a SPARQL answer; `Point(lon lat)` of `coord` as lat and lon, lists joined by | as arrays under name_list."""
    schema = "results STRUCT<bindings: ARRAY<MAP<STRING, STRUCT<value: STRING>>>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results.bindings").alias("b"))
    out = r.select(*[F.try_element_at("b", F.lit(n))["value"].alias(n) for n in names])
    if "coord" in names:
        point = lambda i: F.expr(f"try_cast(nullif(regexp_extract(coord, '(?i)Point\\\\(([-0-9.eE]+) ([-0-9.eE]+)\\\\)', {i}), '') as double)")
        out = out.withColumn("lat", point(2)).withColumn("lon", point(1))
    return out


_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"
#: Headers of register lists and what they mean.
HEADERS = {
    "number": ("no.", "no", "#", "number", "us#", "register", "registry number", "nhlr registry number", "register number"), "name": ("name", "lookout", "lookout name", "tower", "tower name", "site name"),
    "region": ("state", "province", "state/province"), "county": ("county", "parish"), "country": ("country",),
}


def html_rows(pages: DataFrame, key: str, html: str, headers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, pos, cells MAP): rows of a page's tables, cells by the meaning of their column's header, in any order of columns."""
    synonyms = {s: k for k, v in (headers or HEADERS).items() for s in v}
    names = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    rows = pages.select(key, F.regexp_extract_all(html, F.lit(_ROW), F.lit(1)).alias("rows")).where("size(rows) > 1")
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(_CELL), F.lit(1)), T.strip_tags)
    head = F.transform(cells(F.get("rows", F.lit(0))), lambda h: F.coalesce(F.try_element_at(names, F.lower(h)), F.lower(h)))
    each = rows.select(key, head.alias("head"), F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("pos", "row")).withColumn("cells", cells(F.col("row")))
    entries = F.zip_with("head", "cells", lambda h, c: F.struct(h.alias("key"), F.nullif(c, F.lit("")).alias("value")))
    named = F.filter(entries, lambda e: e.key.isNotNull() & (e.key != "") & e.value.isNotNull())
    distinct = F.filter(named, lambda e: F.array_position(F.transform(named, lambda x: x.key), e.key) == F.array_position(F.transform(named, lambda x: F.struct(x.key, x.value)), F.struct(e.key, e.value)))
    return each.where("size(cells) > 0").select(key, "pos", F.map_from_entries(F.array_distinct(distinct)).alias("cells"))


def labelled(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, label, value) of two-column tables of labels."""
    pair = F.regexp_extract_all(html, F.lit(_ROW), F.lit(1))
    cells = F.transform(pair, lambda r: F.transform(F.regexp_extract_all(r, F.lit(_CELL), F.lit(1)), T.strip_tags))
    return pages.select(key, F.explode(cells).alias("c")).where("size(c) = 2").select(key, F.regexp_replace(F.get("c", F.lit(0)), r"\s*:$", "").alias("label"), F.get("c", F.lit(1)).alias("value"))


#: Labels of detail pages and what they mean.
LABELS = {"status": ("status", "current status"), "type": ("type", "structure", "construction"), "elevation": ("elevation", "elev."), "position": ("coordinates", "latitude / longitude", "lat/lon", "location"), "removed": ("removed",), "county": ("county",), "number": ("register number", "nhlr registry number", "number")}


def detail_pages(pages: DataFrame, key: str, html: str, source: str) -> DataFrame:
    """(key, name, status, type, county, number, elevation_m, lat, lon, removed) of detail pages: the heading, and a table of labels in any order.

    An elevation in feet becomes metres, to one decimal, halves to even; a position is decimal degrees or degrees and minutes;
    `removed` is the event that its text states (see prose.removed_event). What a page lacks is null.
    """
    synonyms = {s: k for k, v in LABELS.items() for s in v}
    names = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    found = labelled(pages, key, html).select(key, F.try_element_at(names, F.lower("label")).alias("label"), F.nullif("value", F.lit("")).alias("value")).where("label is not null")
    wide = found.groupBy(key).agg(*[F.min(F.when(F.col("label") == k, F.col("value"))).alias(k) for k in LABELS])
    title = pages.select(key, F.nullif(T.strip_tags(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)), F.lit("")).alias("name"))
    amount = F.replace(F.regexp_extract("elevation", r"^\D*([\d,]+(?:\.\d+)?)", 1), F.lit(","), F.lit(""))
    feet = F.expr("elevation rlike '(?i)(feet|ft|foot|\u2032)'")
    metres = F.nullif(amount, F.lit("")).cast("double")
    pair = r"(-?\d{1,3}\.\d+)\D{1,6}?(-?\d{1,3}\.\d+)"
    half = lambda i: F.nullif(F.regexp_extract("position", pair, i), F.lit("")).cast("double")
    typed = wide.withColumns({"elevation_m": F.when(feet, F.bround(metres * 0.3048, 1)).otherwise(metres), "lat": half(1), "lon": half(2)}).withColumn("removed", removed_event(F.col("removed"), F.lit(source)))
    return title.join(typed, key, "left").select(key, "name", "status", "type", "county", "number", "elevation_m", "lat", "lon", "removed")


def photos(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, url, caption, credit, year) of a page's figures, each url once: the caption's text, a credit behind a word for one, the last year."""
    block = F.regexp_extract_all(html, F.lit(r"(?is)<figure\b[^>]*>.*?</figure\s*>"), F.lit(0))
    one = pages.select(key, F.posexplode(block).alias("pos", "f"))
    url = F.nullif(F.regexp_extract("f", r"""(?is)<img\b[^>]*?src\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
    text = F.nullif(T.strip_tags(F.regexp_extract("f", r"(?is)<figcaption\b[^>]*>(.*?)</figcaption\s*>", 1)), F.lit(""))
    by = r"(?i)\b(?:photo|photograph|picture|image|courtesy)\s*(?:by|of|:|credit:?)?\s*:?\s*([^.;()]+)"
    out = one.select(key, "pos", url.alias("url"), text.alias("caption"), F.trim(F.nullif(F.regexp_extract(text, by, 1), F.lit(""))).alias("credit"), F.try_element_at(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), F.lit(-1)).cast("int").alias("year"))
    return out.where("url is not null").groupBy(key, "url").agg(F.min_by(F.struct("caption", "credit", "year"), "pos").alias("x")).select(key, "url", "x.*")


def headed_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, heading, text) of a page's parts below its headings; what stands before the first has none."""
    parts = F.split(html, r"(?i)(?=<h[1-6]\b)")
    one = pages.select(key, F.posexplode(parts).alias("pos", "p"))
    heading = F.nullif(T.strip_tags(F.regexp_extract("p", r"(?is)^<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", 1)), F.lit(""))
    body = T.strip_tags(F.regexp_replace("p", r"(?is)^<h[1-6]\b[^>]*>.*?</h[1-6]\s*>", ""))
    return one.select(key, "pos", heading.alias("heading"), body.alias("text")).where("heading is not null or text <> ''")


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, url, label) of a page's links, each url once."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']+)["'][^>]*>.*?</a>"""), F.lit(0))
    one = pages.select(key, F.posexplode(found).alias("pos", "a"))
    out = one.select(key, "pos", F.regexp_extract("a", r"""(?is)href\s*=\s*["']([^"']+)["']""", 1).alias("url"), T.strip_tags(F.col("a")).alias("label"))
    return out.where(~F.lower("url").startswith("javascript:")).groupBy(key, "url").agg(F.min_by("label", "pos").alias("label"))


def page_table(pages: DataFrame, key: str, html: str, variable: str, schema: str) -> DataFrame:
    """Rows of a JSON array that a page assigns to a script variable."""
    literal = F.regexp_extract(html, rf"(?s)\b{re.escape(variable)}\s*=\s*(\[.*?\])\s*;", 1)
    return pages.select(key, F.explode(F.from_json(F.nullif(literal, F.lit("")), f"array<struct<{schema}>>")).alias("r")).select(key, "r.*")


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon) of waypoints."""
    s = spark.read.option("rowTag", "wpt").schema("_lat DOUBLE, _lon DOUBLE, name STRING, ele DOUBLE").format("xml").load(path)
    return s.select("name", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col("ele").alias("elevation_m"))


def stories(spark: SparkSession, path: str) -> DataFrame:
    """(id, md) of Markdown files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("id"), F.col("value").alias("md"))


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """Historic sheets of an index, boxes derived; rows without an id, a year or a ring are dropped."""
    schema = "scan_id BIGINT, name STRING, scale INT, year INT, imprint INT, state STRING, url STRING, ring ARRAY<ARRAY<DOUBLE>>"
    s = spark.read.schema(schema).option("multiLine", True).json(path).where("scan_id is not null and year is not null and size(ring) >= 3")
    ring = F.transform("ring", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    s = s.withColumn("ring", ring)
    xs, ys = (F.transform("ring", lambda p, n=n: p[n]) for n in ("lon", "lat"))
    return s.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})


def tiff_header(content: bytes) -> dict[int, tuple]:
    """Tags of the first directory of a (little or big endian) TIFF: {tag: values}."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8 or struct.unpack(order + "H", content[2:4])[0] != 42:
        return {}
    kinds = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
    at = struct.unpack(order + "I", content[4:8])[0]
    tags = {}
    (n,) = struct.unpack(order + "H", content[at : at + 2])
    for i in range(n):
        e = at + 2 + 12 * i
        tag, kind, count = struct.unpack(order + "HHI", content[e : e + 8])
        if kind not in kinds:
            continue
        size = struct.calcsize(order + kinds[kind]) * count
        where = e + 8 if size <= 4 else struct.unpack(order + "I", content[e + 8 : e + 12])[0]
        raw = content[where : where + size]
        if len(raw) == size:
            tags[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{count}{kinds[kind]}", raw)
    return tags


def synthetic_records(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """Seeded invented records."""
    r = spark.range(count)
    return r.select(F.concat(F.lit("syn:"), "id").alias("key"), F.concat(F.lit("Lookout "), "id").alias("name"), (F.rand(seed) * 20 + 30).alias("lat"), (F.rand(seed + 1) * 50 - 120).alias("lon"), (F.floor(F.rand(seed + 2) * 100) + 1900).cast("int").alias("built"))


#: Readers of pages by source: name -> (pages -> DataFrame of key, text). Applications add theirs.
PAGE_READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"html": lambda p: p.select("key", T.html_to_text(F.col("page")).alias("text")), "text": lambda p: p.select("key", F.col("page").alias("text"))}
