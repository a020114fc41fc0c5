import io
import json
import math
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.functions import text as T
from cairn.operators import audit, filters, graph, places, resolve, temporal
from cairn.sources import readers, sinks
from cairn.streaming import events as streams
from cairn.terrain import sight


def test_filter_language():
    s = filters.parse("?status=standing,nonsense&kind=none&state=or&country=CA&yr=1933&vs=us-or-a,us-or-b,us-or-a,x&bad=1")
    f = s.filters
    assert f.status == {"standing"} and f.kind == frozenset() and f.region == "OR" and f.country is None and s.year == 1933 and s.sights == ("us-or-a", "us-or-b")
    assert filters.parse(filters.serialize(s)) == s
    assert filters.toggle(None, "gone", False, ("gone", "ruins")) == {"ruins"}
    assert filters.toggle(frozenset({"ruins"}), "gone", True, ("gone", "ruins")) is None
    assert len(filters.parse("vs=" + ",".join(f"us-or-a{i}" for i in range(40))).sights) == filters.MOST_SIGHTS


def test_year_ranges(spark):
    cases = [("standing", [(1933, "built"), (1995, "nhlr_registered")], 1933, None), ("standing", [(1935, "built"), (1931, "built")], 1931, None), ("gone", [(1934, "built"), (1962, "abandoned"), (1971, "destroyed")], 1934, 1962),
             ("gone", [(1922, "built"), (1940, "burned"), (1942, "rebuilt"), (1981, "removed")], 1922, 1981), ("standing", [(1933, "built"), (1970, "abandoned")], 1933, None), ("relocated", [(1931, "built"), (1984, "relocated")], 1931, 1984),
             ("gone", [(193, "built"), (2091, "removed")], None, None), ("gone", [(1998, "fflos_registered")], None, None), (None, None, None, None)]
    rows = [(i, s, e and [{"year": y, "event": v} for y, v in e]) for i, (s, e, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, status string, events array<struct<year:int,event:string>>")
    got = {r["id"]: (r["y0"], r["y1"]) for r in temporal.year_range(df, "id").collect()}
    assert got == {i: (a, b) for i, (_, _, a, b) in enumerate(cases)}


def test_series_equals_counts(spark):
    rng = np.random.default_rng(7)
    rows = [(["standing", "gone", "ruins", "unknown", None][rng.integers(5)], *(None if rng.random() < 0.3 else int(rng.integers(1890, 2030)) for _ in range(2))) for _ in range(600)]
    df = spark.createDataFrame(rows, "s string, y0 int, y1 int")
    series = {r["year"]: r for r in temporal.year_series(df, 1900, 2026).collect()}
    for y in (1900, 1901, 1950, 2000, 2025, 2026):
        assert series[y] == temporal.year_counts(df, y).first()
    assert temporal.year_counts(df.limit(0), 1950).first()["upper"] == 0 and temporal.year_series(df.limit(0), 1900, 1901).count() == 2


def test_components_redirects_collapse(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 9), (5, 4), (None, 3), (3, 1)], "src int, dst int")
    assert {tuple(r) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (9, 9), (4, 4), (5, 4)}
    assert graph.components(e.limit(0)).count() == 0
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {tuple(x) for x in places.resolve_redirects(r).collect()} == {("a", "c"), ("b", "c")}
    step = 40 / 111_195
    p = spark.createDataFrame([(i, i * step + 1, 1.0) for i in range(1, 6)], "id bigint, lat double, lon double")
    assert {tuple(x) for x in places.collapse(p, 50.0, "id").collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}


def test_cascade(spark):
    rec = "key string, source string, country string, region string, county_key string, name_keys array<string>, lat double, lon double, registers array<string>"
    tow = "tower string, country string, region string, county_key string, name_key string, lat double, lon double, approximate boolean, registers array<string>"
    t = spark.createDataFrame([("T1", "US", "WA", "king", "bald mountain", 47.0, -121.0, False, ["7"]), ("T2", "CA", "BC", None, "bald mountain", 49.001, -121.0, False, None), ("T3", "US", "WA", "skagit", "red hill", 48.0, -121.0, True, None)], tow)
    r = spark.createDataFrame([
        ("a", "s", "US", "WA", "king", ["x"], None, None, ["7"]), ("b", "s", "US", "WA", "king", ["old bald mountain"], 47.003, -121.0, None), ("c", "s", "US", "WA", None, ["bald mountain"], 49.0012, -121.0, None),
        ("d", "s", "US", "WA", "skagit", ["red hill"], None, None, None), ("e", "s", "US", "WA", "king", [], None, None, None), ("f", "s", "US", "WA", "king", ["new place"], 45.0, -120.0, None), ("g", "s", "US", "WA", "z", ["q"], None, None, None)], rec)
    over = spark.createDataFrame([("g", "T3")], "key string, tower string")
    got = {x["key"]: (x["tower"], x["stage"]) for x in resolve.cascade(r, t, over).collect()}
    assert got == {"a": ("T1", "register"), "b": ("T1", "position"), "c": ("T1", "name"), "d": ("T3", "name"), "e": (None, "unplaced"), "f": (None, "new"), "g": ("T3", "override")}


def test_quotes_and_html(spark):
    df = spark.createDataFrame([("the cab … burned down in", "One: the old cab stood; it burned down in 1933."), ("the stairs were rebuilt", "Then the stairs\nwere re-\nbuilt."), ("one two three four five six seven", "one two three four five six eight"), ("no", "yes"), ("[…]", "yes")], "q string, t string")
    assert [r[0] for r in df.select(T.quote_match(F.col("q"), T.quote_form(F.col("t")))).collect()] == ["missing", "found", "missing", "missing", "found"]
    h = spark.createDataFrame([("<p>A &amp; B</p><script>x()</script><br>C  D</p>",)], "h string")
    assert h.select(T.html_to_text(F.col("h"))).first()[0] == "A & B\n\nC D"
    pages = spark.createDataFrame([(1, "<table><tr><th>Name</th><th>No.</th></tr><tr><td>Bald <b>Mt</b></td><td>7</td></tr></table>")], "id int, html string")
    assert readers.html_rows(pages, "id", "html").first()["cells"] == {"name": "Bald Mt", "number": "7"}


def test_geodesy(spark):
    one = spark.range(1)
    y, x = geo.destination(F.lit(45.0), F.lit(-116.0), F.lit(60.0), F.lit(20_000.0))
    b1, b2 = geo.bearing_deg(F.lit(45.0), F.lit(-116.0), y, x), geo.bearing_deg(F.lit(45.2), F.lit(-116.2), y, x)
    c = geo.crossing(F.lit(45.0), F.lit(-116.0), b1, F.lit(45.2), F.lit(-116.2), b2)
    r = one.select(geo.distance_m(c["lat"], c["lon"], y, x).alias("off"), geo.parse_dms(F.lit("52° 30' 15\" N")).alias("dms"), geo.parse_dms(F.lit("52 75 N")).alias("bad")).first()
    assert r["off"] < 1 and abs(r["dms"] - 52.504167) < 1e-5 and r["bad"] is None
    behind = geo.crossing(F.lit(45.0), F.lit(-116.0), b1 + 180, F.lit(45.2), F.lit(-116.2), b2)
    assert one.select(behind.alias("c")).first()["c"] is None
    assert one.select(F.size(geo.tiles_for_disc(F.lit(0.0), F.lit(179.99), 5000.0, 9)).alias("n")).first()["n"] >= 2


def test_terrain():
    flat = sight.Surface(lambda a, o: np.zeros(np.shape(a)))
    p = sight.panorama(flat, 45.0, -116.0, above=100.0, columns=8, most=80_000.0, layers=())
    r = 6_371_008.8 / 0.87
    assert np.allclose(p["crest_m"], math.sqrt(2 * r * 100), rtol=0.01)
    assert np.allclose(-p["horizon_deg"], math.degrees(math.sqrt(200 / r)), atol=0.002)
    v = sight.viewshed(flat, 45.0, -116.0, above=100.0, most=20_000.0, cell_m=250.0)
    assert abs(v["cell_m2"].sum() / (math.pi * 20_000.0**2) - 1) < 0.03
    assert sight.quantise(np.array([-5.0, 1.13, np.nan])).tolist() == [0, 5, 65535]
    tile = np.full((4, 4), 400, dtype=np.uint16)
    assert sight.TileField({(0, 0, 0): tile}).height(np.array([10.0]), np.array([10.0]))[0] == pytest.approx(100.0)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.json").write_text(json.dumps({"source": "s", "records": [{"key": "s:1", "name": "A", "lat": 1.0}, None, {"key": "s:0"}]}))
    (tmp_path / "x/b.json").write_text("{broken")
    r = readers.extracts(spark, str(tmp_path / "x"))
    assert sorted((x["source"], x["key"]) for x in r.collect()) == [("s", "s:0"), ("s", "s:1")]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("n.txt", "﻿feature_id|feature_name|feature_class|state_alpha|prim_lat_dec|prim_long_dec\n1|Bald|Summit|WA|47.0|-121.0\n2|Old (historical)|Summit|WA|1|1\n3|Z|Summit|WA|0|0\n4|Y|Valley|WA|2|2\n")
    (tmp_path / "g.zip").write_bytes(buf.getvalue())
    rows = readers.zipped_pipes(spark, str(tmp_path / "g.zip"), ["feature_id", "feature_name", "feature_class", "state_alpha", "prim_lat_dec", "prim_long_dec"])
    assert [tuple(x) for x in readers.summits(rows).collect()] == [("1", "Bald", 47.0, -121.0, "WA")]
    p = spark.createDataFrame([("1", 47.2, -121.5), ("2", 47.9, -121.1)], "id string, lat double, lon double")
    assert [tuple(x) for x in sinks.write_cells(p, str(tmp_path / "cells")).collect()] == [("47_-122", 2)]
    assert spark.read.parquet(str(tmp_path / "cells")).count() == 2
    assert sinks.changed_rows(p, p, "id").count() == 0
    with pytest.raises(ValueError):
        sinks.write_extract(p, str(tmp_path / "no"), p)
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 256, 4, 1, 512) + struct.pack("<I", 0)
    assert readers.tiff_header(head) == {256: (512,)} and readers.tiff_header(b"xx") == {}


def test_merge_deliveries(spark):
    s = "rec_key string, source string, v int, retrieved_at int"
    old = spark.createDataFrame([("a:1", "a", 1, 1, None), ("a:2", "a", 1, 1, None), ("b:1", "b", 1, 1, None)], s + ", missing_since string")
    new = spark.createDataFrame([("a:1", "a", 2, 2), ("a:1", "a", 3, 3)], s)
    got = {r["rec_key"]: (r["v"], r["missing_since"]) for r in streams.merge_deliveries(old, new, spark.createDataFrame([("a",)], "source string"), "rec_key", "2026-01-01").collect()}
    assert got == {"a:1": (3, None), "a:2": (1, "2026-01-01"), "b:1": (1, None)}


def test_footnotes(spark):
    d = spark.createDataFrame([(1, "a[^1] b[^2]\n\n[^1]: x\n[^3]: y"), (2, "a[^1]\n[^1]: z"), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in audit.footnotes(d).collect()] == [(1, [2], [3])]
