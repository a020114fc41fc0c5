"""Survivorship, placement, prose and sheets on small rows, with nulls, ties, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import display, geo, prose, regions
from cairn.operators import audit, filters, places, resolve, sheets
from cairn.operators import survivorship as S


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rules_take_the_first_of_each_sentence_not_there_yet(spark):
    text = "No smoking, and no open fires. No smoking here either, no open fires! Quiet hours from ten. Pack out trash."
    assert _one(spark, prose.rules(F.lit(text)))[0] == ["No open fires / campfires not allowed", "No smoking", "Quiet hours observed", "Pack out all trash"]
    assert _one(spark, prose.rules(F.lit("")), prose.rules(F.lit(None).cast("string")))[:] == ([], None)
    many = "No smoking. " * 5000
    assert _one(spark, prose.rules(F.lit(many)))[0] == ["No smoking"]


def test_prose_of_rentals(spark):
    t = F.lit("The cabin is typically available for rent from May through October, depending on snow. It sleeps up to four people at an elevation of 6,230 feet. It was built in 1929; rebuilt, it was constructed during the summer of 1934. It opened for rental in 1991. Access by a rough road. Pets must be on leash.")
    got = _one(spark, prose.season(t), prose.occupancy(t), prose.elevation_ft(t), prose.built_year(t), prose.opened_year(t), prose.access_note(t), prose.pets(t))
    assert tuple(got) == ("May through October", 4, 6230.0, 1934, 1991, "Access by a rough road.", "Allowed on leash")
    none = F.lit("nothing here")
    assert set(_one(spark, prose.season(none), prose.occupancy(none), prose.elevation_ft(none), prose.pets(none), prose.access_note(none))) == {None}
    for text, want in (("2002 - Wildfire", (2002, "burned", False)), ("circa 2010", (2010, "removed", True)), ("1970s", (1970, "removed", True)), ("between 1966 and 1979, collapsed", (1979, "destroyed", False)), ("Standing", None), ("", None)):
        e = _one(spark, prose.removed_event(F.lit(text), F.lit("nhlr")))[0]
        assert (e and (e.year, e.event, "about" in e.note)) == want
    n = _one(spark, prose.bracket_notes(F.lit("x (Managed by Friends.) (Maintenance Closure2026) (12)")))[0]
    assert (n.status_note, n.manager, n.notes) == ("Maintenance Closure 2026", "Friends", ["Managed by Friends.", "Maintenance Closure 2026"])
    assert _one(spark, prose.facility_number(F.lit("https://www.recreation.gov/camping/campgrounds/234262?x=1")), prose.cites(F.lit("[2, 7]")))[:] == ("234262", [2, 7])


def test_regions(spark):
    for text, want in (("Ontario", "ON"), ("Québec", "QC"), ("colombie-britannique", "BC"), ("B.C.", "BC"), (" or ", "OR"), ("Oregonian", None), ("XX", None), ("", None), (None, None)):
        assert _one(spark, regions.parse_region(F.lit(text).cast("string")))[0] == want
    assert _one(spark, regions.parse_region(F.lit("Ontario"), F.lit("US")))[0] is None
    labels = [("US", "OR", "Jefferson"), ("US", "LA", "Caddo"), ("US", "AK", "Bethel"), ("US", "AK", "Denali"), ("CA", "ON", "Sudbury District"), ("US", "OR", " ")]
    got = [_one(spark, regions.unit_label(*map(F.lit, x)))[0] for x in labels]
    assert got == ["Jefferson County", "Caddo Parish", "Bethel Census Area", "Denali Borough", "Sudbury District", None]
    assert [_one(spark, regions.unit_key(F.lit(u)))[0] for u in ("Regional District of Central Kootenay", "Division No. 18", "St. Louis County", "county")] == ["centralkootenay", "divisionno18", "saintlouis", None]


def test_fields_by_rank_and_unions(spark):
    rows = [(1, "g", "a", None, 1930), (2, "g", "b", "standing", 1931), (3, "g", "c", "gone", None), (3, "g", "c", "gone", None), (4, None, "a", "gone", 1)]
    m = spark.createDataFrame(rows, "id bigint, g string, source string, status string, built int")
    ranks = spark.createDataFrame([("status", "c", 1), ("status", "b", 2), ("built", "b", 1)], "field string, source string, rank int")
    got = {r["g"]: r for r in S.ranked_fields(m, ranks, "g", ["status", "built"], "id").collect()}
    assert (got["g"].status, got["g"].built) == ("gone", 1931)
    assert [(c.field, [(v.source, v.value) for v in c["values"]]) for c in got["g"].conflicts] == [("status", [("b", "standing"), ("c", "gone")]), ("built", [("a", "1930"), ("b", "1931")])]
    assert S.ranked_fields(m.limit(0), ranks, "g", ["status"], "id").count() == 0
    e = spark.createDataFrame([("g", "assoc", [(1930, "built", "x"), (None, None, "y")]), ("g", "reg", [(1930, "built", None)]), ("g", "reg", None)], "g string, source string, events array<struct<year:int,event:string,note:string>>")
    assert [tuple(r) for r in S.event_union(e, "g", F.when(F.col("source") == "assoc", 1).otherwise(0)).collect()] == [("g", 1930, "built", None, "reg")]
    few = S.too_few(spark.createDataFrame([("a",)] * 6, "source string"), spark.createDataFrame([("a",)] * 9 + [("b",)], "source string"))
    assert {tuple(r) for r in few.collect()} == {("a", 6, 9, True), ("b", 0, 1, True)}


RENTAL = "struct<available boolean, provider string, url string, max_occupancy int, status_note string, manager string, warning string>"


def test_rental_of_list_and_booking(spark):
    rows = [(1, "g", "book", (True, "p", "u", 4, None, None, None), "standing", None), (2, "g", "list", (True, "q", "v", None, "Closure 2026", "USFS", None), None, None), (3, "h", "list", (True, "q", "v", None, None, "X", None), "gone", [(2021, "burned"), (None, "removed")]), (4, "i", "list", None, "gone", None)]
    m = spark.createDataFrame(rows, f"id int, g string, source string, rental {RENTAL}, status string, events array<struct<year int, event string>>")
    got = {r["g"]: r for r in S.merged_rental(m, "g", F.col("source") == "book", "id").collect()}
    assert set(got) == {"g", "h"} and (got["g"].provider, got["g"].max_occupancy, got["g"].status_note, got["g"].manager, got["g"].available) == ("p", 4, "Closure 2026", "USFS", True)
    assert got["h"].available is False and got["h"].warning == "list reports this lookout burned in 2021, but it is still listed."


def test_rentals_are_placed(spark):
    t = spark.createDataFrame([("w", "ID", "9", "walde", "walde", None), ("b1", "ID", None, "bald", "bald", "gone"), ("b2", "ID", "7", "bald", "bald", None), ("s1", "WA", None, "twin", "twin", None), ("s2", "WA", None, "twin", "twin", None), ("g1", "OR", None, "hill", "hill", "gone"), ("g2", "OR", None, "hill", "hill", "standing"), ("d", "MT", "5", "dominionmountain", "dominion", None)], "tower string, region string, facility string, name_key string, loose_key string, status string")
    r = spark.createDataFrame([("1", "ID", "9", "other", "x"), ("2", "ID", None, "bald", "bald"), ("3", "WA", None, "twin", "twin"), ("4", "OR", None, "hill", "hill"), ("5", "MT", None, "dominionpeak", "dominion"), ("6", "MT", None, "", ""), ("7", "ID", "9", "", "")], "key string, region string, facility string, name_key string, loose_key string")
    over = spark.createDataFrame([("7", "s1")], "key string, tower string")
    got = {x["key"]: (x["tower"], x["stage"]) for x in places.place_rentals(r, t, over).collect()}
    assert got == {"1": ("w", "facility"), "2": ("b2", "name"), "3": (None, "several"), "4": ("g2", "name"), "5": ("d", "loose name"), "6": (None, "none"), "7": ("s1", "override")}
    assert places.place_rentals(r.limit(0), t).count() == 0


def test_ids_are_given_once(spark):
    taken = spark.createDataFrame([("us-or-x",), ("us-or-x-3",), ("us-or-pine-2",)], "id string")
    names = ["X", "X", "Pine", "Pine", "Route 2", "Route", "Route"]
    new = spark.createDataFrame(list(enumerate(names)), "n int, name string")
    got = {r["n"]: r["id"] for r in resolve.allocate_ids(new, F.lit("us-or"), F.lower(F.regexp_replace("name", " ", "-")), taken, ["n"]).collect()}
    assert got == {0: "us-or-x-2", 1: "us-or-x-4", 2: "us-or-pine", 3: "us-or-pine-3", 4: "us-or-route-2", 5: "us-or-route", 6: "us-or-route-3"}
    assert resolve.allocate_ids(new.limit(0), F.lit("a"), F.col("name"), taken.limit(0), ["n"]).count() == 0


def test_near_regions_and_misses(spark):
    ring = lambda x, y: [[(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0)]]
    poly = spark.createDataFrame([("A", ring(0.0, 0.0), 0.0, 0.0, 1.0, 1.0), ("B", ring(1.02, 0.0), 1.02, 0.0, 2.02, 1.0)], "code string, rings array<array<struct<lon double, lat double>>>, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, -0.03), (3, 0.5, 1.01), (4, 0.5, -0.2), (5, None, 1.0)], "id int, lat double, lon double")
    assert {tuple(r) for r in places.nearest_region(p, poly, "id").collect()} == {(1, "A", False), (2, "A", True)}
    c = _one(spark, places.centroid(F.from_json(F.lit('[[{"lon":0,"lat":0},{"lon":2,"lat":0},{"lon":2,"lat":1},{"lon":0,"lat":1}]]'), "array<array<struct<lon:double,lat:double>>>")))[0]
    assert (round(c.lat, 9), round(c.lon, 9)) == (0.5, 1.0)
    step = 1000 / 111_195
    t = spark.createDataFrame([("a", 45.0, -116.0, "bald"), ("b", 45.0 + step, -116.0, "balt"), ("c", 45.0 + 2 * step, -116.0, "other")], "id string, lat double, lon double, name_key string")
    alike = 1 - F.levenshtein("name_a", "name_b") / F.greatest(F.length("name_a"), F.length("name_b"))
    assert [tuple(r)[:2] for r in places.near_misses(t, "id", 300.0, 3000.0, alike).collect()] == [("a", "b")]


def test_regions_by_tree_equal_brute_force(spark):
    import numpy as np

    from cairn.operators import proximity

    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        x, y, n = rng.uniform(-180, 180), rng.uniform(-88, 88), int(rng.integers(3, 12))
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        ring = [(float(np.clip(x + 6 * np.cos(a), -180, 180)), float(np.clip(y + 4 * np.sin(a), -90, 90))) for a in turn]
        hole = [(x + 0.5 * np.cos(a), y + 0.5 * np.sin(a)) for a in turn]
        rings = [ring, [(float(a), float(b)) for a, b in hole]] if i % 3 == 0 else [ring]
        xs, ys = zip(*ring)
        rows.append((f"c{i:02d}", rings, min(xs), min(ys), max(xs), max(ys)))
    poly = spark.createDataFrame(rows, "code string, rings array<array<struct<lon double, lat double>>>, x0 double, y0 double, x1 double, y1 double")
    near = rng.integers(0, 40, 1500)
    pts = [(i, float(np.clip((rows[k][3] + rows[k][5]) / 2 + rng.normal(0, 3), -90, 90)), float(np.clip((rows[k][2] + rows[k][4]) / 2 + rng.normal(0, 4), -180, 180))) for i, k in enumerate(near)]
    df = spark.createDataFrame([*pts, *([(9000, pts[0][1], pts[0][2])] * 3), (9001, None, 1.0), (9002, 95.0, 1.0)], "record_id bigint, lat double, lon double").withColumn("code", F.lit("clash"))

    def holds(r, lat, lon):
        if not (r[2] <= lon <= r[4] and r[3] <= lat <= r[5]):
            return False
        odd = False
        for ring in r[1]:
            for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]):
                if (py > lat) != (qy > lat) and lon < (qx - px) * (lat - py) / (qy - py) + px:
                    odd = not odd
        return odd

    want = {(i, min(c)) for i, lat, lon in [*pts, (9000, pts[0][1], pts[0][2])] if (c := [r[0] for r in rows if holds(r, lat, lon)])}
    for sample, leaf in ((100_000, 50), (100, 400), (10, 4000)):
        assert {tuple(r) for r in proximity.region_of(df, poly, sample_rows=sample, leaf_places=leaf).collect()} == want
    assert proximity.region_of(df.limit(0), poly).count() == 0 and proximity.region_of(df, poly.limit(0)).count() == 0


def test_sheets(spark):
    ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    rows = [(1, "Old", 125_000, 1909, 1909), (2, "Old", 125_000, 1909, 1948), (3, "Mid", 62_500, 1959, None), (4, "New", 24_000, 1998, None)]
    s = spark.createDataFrame([(*r, ring, 0.0, 0.0, 1.0, 1.0) for r in rows], "scan_id int, name string, scale int, year int, imprint int, rings array<array<struct<lon double, lat double>>>, x0 double, y0 double, x1 double, y1 double")
    order = lambda era, z: [r["scan_id"] for r in sheets.ranked(s, era, z).orderBy("place").collect()]
    assert order("lookouts", 13) == [3, 1, 4] and order("newest", 13) == [4, 3, 1] and order("oldest", 9.5) == [1] and order("oldest", 8) == []
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5)], "id int, lat double, lon double")
    assert [tuple(r) for r in sheets.sheet_at(p, sheets.ranked(s, "newest", 13), "id").collect()] == [(1, 4)]
    assert sheets.sheets_in_view((0.0, 0.0, 2.0, 1.0), sheets.ranked(s, "newest", 13)).first()["share"] == pytest.approx(28 / 63)


def test_labels_are_packed_by_score(spark):
    rows = [("v", "a", 0.0, 50.0, 1.0), ("v", "b", 20.0, 50.0, 3.0), ("v", "c", 40.0, 50.0, 2.0), ("v", "d", 30.0, 50.0, 0.0), ("w", "e", 0.0, 10.0, 0.0)]
    got = {r["item"]: r["row"] for r in sheets.label_rows(spark.createDataFrame(rows, "view string, item string, x double, width double, score double"), "view", 2).collect()}
    assert got == {"b": 0, "c": 1, "a": None, "d": None, "e": 0}


def test_display(spark):
    q = [_one(spark, display.quadrant(F.lit(float(d))))[0] for d in (45, 200, 0, 359.6, 90)]
    assert q == ["N 45° E", "S 20° W", "due north", "due north", "due east"]
    assert _one(spark, display.distance_text(F.lit(824.0)), display.distance_text(F.lit(2400.0)), display.length_text(F.lit("CA"), F.lit(1807.4)), display.date_text(F.lit("2026-10-03")), display.axis_max(F.lit(230.0)))[:] == ("820 m", "2.4 km (1.5 mi)", "1,807 m (5,930 ft)", "3 Oct 2026", 250.0)


def test_survey_rules(spark):
    f = spark.createDataFrame([("a", "tree", "standing", None), ("b", "tower", "gone", "CA"), ("c", None, None, None)], "i string, k string, s string, cc string").withColumns({c: F.lit(None).cast("string") for c in ("r", "v", "d", "m")} | {c: F.lit(None).cast("int") for c in ("rt", "rg", "ap")})
    ids = lambda q, marks=None: sorted(r["i"] for r in filters.apply(f, filters.parse(q).filters, marks).collect())
    assert ids("") == ["b", "c"] and ids("ns=1&kind=ground") == ["a"] and ids("country=US&ns=1") == ["a", "c"] and ids("mine=want") == []
    assert ids("mine=want&ns=1", spark.createDataFrame([("a", "want"), ("b", "visited")], "id string, mark string")) == ["a"]
    assert {(r["facet"], r["value"]) for r in filters.facet_counts(f, filters.parse("kind=none").filters, ("kind",)).collect()} == {("kind", "tower")}
    assert [_one(spark, geo.fix_score(F.lit(m)))[0] for m in (399.9, 400.0, 1500.0, 5000.0)] == [3, 2, 1, 0]
    assert [_one(spark, geo.cut_angle(F.lit(a), F.lit(b)))[0] for a, b in ((10.0, 350.0), (0.0, 140.0))] == [20.0, 140.0]
    y, x = geo.to_nad27(F.lit(45.0), F.lit(-110.0))
    lat, lon = _one(spark, y, x)
    assert abs(lat - 45.0) * 111_195 < 20 and 40 < (lon + 110.0) * 78_600 < 70  # the shift there is some 60 m, to the east
    box = F.array(F.struct(F.lit(40.0).alias("lat0"), F.lit(50.0).alias("lat1"), F.lit(-120.0).alias("lon0"), F.lit(-110.0).alias("lon1")))
    flag = lambda a, o, b=box: _one(spark, places.coordinate_flag(F.lit(a), F.lit(o), b))[0]
    assert [flag(45.0, -115.0), flag(44.0, 121.0), flag(-45.0, -115.0), flag(30.0, -115.0), flag(30.0, -115.0, F.lit(None).cast("array<struct<lat0:double,lat1:double,lon0:double,lon1:double>>"))] == [None, "lon_positive_sign", "lat_negative_sign", "outside_state_bbox", None]
    tiers = spark.createDataFrame([(True, "gone", None), (False, "standing", ["NHLR"]), (False, "standing", ["NRHP"]), (False, "ruins", ["FFLOS"]), (False, "gone", ["FFLOS"]), (False, "gone", None), (False, None, [None]), (None, "x", None)], "rent boolean, s string, reg array<string>")
    got = tiers.select(audit.tier(F.col("rent"), F.col("s"), F.lit("tower"), F.lit("US"), F.col("reg"), F.array().cast("array<string>"), F.lit(False), gone_all=True)).collect()
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 6, 7, None]


def test_designs(spark):
    from cairn.functions import designs

    def of(t):
        return [(m.design, m.words) for m in _one(spark, designs.mentions(F.lit(t).cast("string")))[0]]

    assert of("An L-4 cab on a CT-2 tower, unlike the L-5; Aermotor  MC-39") == [("l4", "L-4"), ("r6_timber_towers", "CT-2"), ("aermotor_mc39", "MC-39"), ("aermotor", "Aermotor")]
    assert of("It predates the standard L-4 design. Later an L-4 came.") == [("l4", "L-4")] and of("D-6 with cupola") == [("d6", "D-6")] and of("log cabin with cupola")[0][0] == "cupola"
    assert of(None) == [] and of("") == [] and of("L-4.5 and L-40") == []
    ids = F.array(*map(F.lit, ("l4", "aermotor_mc39", "aermotor")))
    family, parts = {"aermotor_mc39": "aermotor"}, {"cab": ("l4", "d6"), "tower": ("aermotor_mc39", "aermotor"), "whole": ("cdf",)}
    assert _one(spark, designs.most_specific(ids, family))[0] == ["l4", "aermotor_mc39"] and _one(spark, designs.with_families(F.array(F.lit("aermotor_mc39")), family))[0] == ["aermotor_mc39", "aermotor"]
    pairs = [F.array(*map(F.lit, x)) for x in (("l4", "aermotor"), ("l4", "d6"), ("cdf",), ("cdf", "l4"), ("l4",))]
    got = [_one(spark, designs.pair(p, parts))[0] for p in pairs]
    assert [g and tuple(g) for g in got] == [("l4", "aermotor", None), None, (None, None, "cdf"), None, ("l4", None, None)]
    assert _one(spark, designs.variant_codes(F.lit("mc39, MC-39 and LS-40"), "aermotor"))[0] == ["MC-39", "LS-40"]


def test_georeference_and_levels(spark):
    def of(keys, lat=45.0, lon=-110.0):
        m = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(float(v))) for k, v in keys.items()]))
        return _one(spark, geo.georeference(m, F.lit(lat), F.lit(lon)))[0]

    g = of({1024: 1, 3072: 26712})
    assert (g.kind, g.datum, g.shift, g.lon0, g.k0, g.east, g.unsupported) == ("transverse_mercator", "nad27", "conus", -111.0, 0.9996, 500_000.0, None)
    g = of({1024: 1, 2057: 6378206.4, 3075: 22, 3088: -150, 3082: 10, 3076: 9002}, 61.0, -150.0)
    assert (g.kind, g.shift, g.lon0, round(g.east, 3), g.unit) == ("polyconic", "alaska", -150.0, 3.048, 0.3048)
    wrong = [of(k).unsupported for k in ({1024: 2}, {1024: 1, 3076: 9999}, {1024: 1, 3072: 5070}, {1024: 1}, {1024: 1, 2048: 4267}, {1024: 1, 2048: 4269, 3075: 1})]
    assert wrong == ["not a projected map", "linear unit", "coordinate system", "datum", "projection method", "no central meridian"] and of({1024: 2}).kind is None
    assert geo.panorama_levels(150_000) == [(12, 4000.0), (10, 40_000.0), (9, 100_000.0), (8, 150_000)] and geo.panorama_levels(3000) == [(12, 3000)]
    assert geo.panorama_levels(150_000, light=True) == [(12, 4000.0), (10, 40_000.0), (8, 150_000)] and geo.viewshed_levels(20_000) == [(12, 4000.0), (10, 20_000)]


def test_research_rules(spark):
    schema = "id string, researched string, summary string, sources array<struct<n int, title string, url string, accessed string>>, events array<struct<year int, event string, cite array<int>>>, confidence string, verification struct<verdict string, checked string, claims_checked int, unsupported_removed int, errors_fixed int>, status string, kind string"
    good = ("a", "2026-01-02", "x", [(1, "t", "https://a", None)], [(1930, "built", [1])], "high", ("pass", "2026-01-03", 3, 0, 0), "standing", None)
    bad = ("b", "soon", " ", [(1, "", "ftp://a", "x"), (1, "t", "https://b", None)], [(1930, "flown", [2]), (None, "built", None)], "sure", ("maybe", None, -1, 0, 0), "up", "boat")
    df = spark.createDataFrame([good, bad, ("c", *[None] * 8)], schema)
    rules = audit.research_rules(("standing",), ("tower",), ("built",))
    got = audit.violations(df, "id", rules).collect()
    assert {r["id"] for r in got} == {"b", "c"} and len([r for r in got if r["id"] == "b"]) == 14
    assert {r["message"] for r in got if r["id"] == "c"} == {"researched is not a date", "summary is missing", "sources is missing or empty"}
    assert _one(spark, audit.first_bad(F.array(F.lit("a"), F.lit(""), F.lit(None), F.lit("b")), lambda x: x != ""))[0] == "[1] is malformed (and 1 more)"
