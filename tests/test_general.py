import json
import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.functions.jsonindex import JsonIndex
from cairn.functions.quantity import amount, height_in, unit
from cairn.operators import nested, proximity, units

RECORD = "record_id bigint, lat double, lon double, name string"


def brute(rows, metres):
    def d(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))

    ok = [r for r in rows if None not in r[:3] and not math.isnan(r[1] + r[2]) and abs(r[1]) <= 90 and abs(r[2]) <= 180 and (r[1] or r[2])]
    ok = sorted({r[:3] for r in ok})
    return {(a[0], b[0]) for i, a in enumerate(ok) for b in ok[i + 1 :] if a[0] < b[0] and d(a, b) <= metres}


def test_near_pairs_at_seams_poles_and_hot_places(spark):
    rng = np.random.default_rng(1)
    spots = [(50.0, 179.9995), (50.0, -179.9995), (89.9999, 10.0), (89.9999, -170.0), (-90.0, 0.0), (84.9999, 5.0), (85.0001, 5.0), (0.001, 0.0), (40.0, -100.0)]
    rows, k = [], 0
    for lat, lon in spots:
        for _ in range(60):
            k += 1
            rows.append((k, float(np.clip(lat + rng.normal(0, 0.002), -90, 90)), float((lon + rng.normal(0, 0.003) + 180) % 360 - 180), "x"))
    rows += [(k + 1 + i, 12.5, 33.25, None) for i in range(700)]  # one hot place of exact copies
    rows += [(9001, None, 1.0, None), (9002, float("nan"), 1.0, None), (9003, 0.0, 0.0, "z"), (9004, 91.0, 0.0, "z"), (9005, 1.0, 181.0, "z")]
    df = spark.createDataFrame(rows, RECORD).withColumnRenamed("name", "place")
    for leaf in (8, 4000):
        got = [tuple(r) for r in proximity.near_pairs(df, 250.0, leaf_places=leaf).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, 250.0)


def test_near_pairs_repeated_and_empty(spark):
    rows = [(1, 1.0, 1.0, "a"), (1, 1.0, 1.0, "a"), (2, 1.0, 1.0, "b")]
    assert [tuple(r) for r in proximity.near_pairs(spark.createDataFrame(rows, RECORD), 250.0).collect()] == [(1, 2)]
    assert proximity.near_pairs(spark.createDataFrame([], RECORD), 250.0).count() == 0


def test_region_with_hole_and_null(spark):
    ring = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    poly = spark.createDataFrame([("A", [ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((3, 3), (6, 3), (6, 6), (3, 6))], 0.0, 0.0, 9.0, 9.0)], "code string, rings array<array<struct<lon:double,lat:double>>>, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([(1, 1.0, 1.5, ""), (2, 4.5, 4.5, ""), (3, None, 1.0, ""), (4, 20.0, 1.0, "")], RECORD)
    assert [tuple(r) for r in proximity.region_of(pts, poly).collect()] == [(1, "A")]


def as_json(t):
    try:
        o = json.loads(t)
        if isinstance(o, str) and o.lstrip()[:1] in ("{", "["):
            o = json.loads(o)
        return True
    except ValueError:
        return False


values = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(values, st.integers(0, 60), st.sampled_from(["", "x", '"', "{", "]", ",", "\\", "1e", " "])), max_size=5))
def test_index_agrees_with_a_parser(items):
    texts = []
    for v, at, noise in items:
        t = json.dumps(v, ensure_ascii=False)
        texts.append(t[:at] + noise + t[at:])
    index = JsonIndex(texts)
    assert index.valid.tolist() == [as_json(t) for t in texts]


def test_index_links(spark):
    x = {"reports": [{"title": "a", "cites": [None, {"page": 3}]}, None, {"title": "b", "cites": 7}], "z": {"reports": [1]}}
    rows = [(1, json.dumps(x)), (2, json.dumps(json.dumps(x))), (3, json.dumps(x)[:-1]), (4, None), (5, ""), (6, '{"reports": {"title": "c"}}'), (7, "[1]")]
    df = spark.createDataFrame(rows, "record_id bigint, extra string")
    got = sorted(tuple(r) for r in nested.json_links(df).collect())
    each = lambda k: [(k, "report", 0, -1), (k, "report", 2, -1), (k, "report_cite", 0, 1), (k, "report_cite", 2, 0)]
    assert got == sorted([*each(1), *each(2), (6, "report", 0, -1)])
    assert nested.json_links(df.limit(0)).count() == 0
    assert [tuple(r) for r in nested.cites(df).where("record_id = 1").orderBy("pos").collect()] == [(1, 0, 1, "3", None), (1, 2, 0, "7", None)]


def test_amounts():
    assert amount("1,955 FEET ASL") == (1955.0, "ft")
    assert amount("14 hundred ft") == (14.0, "hundred_ft")
    assert amount("4,3 m") == (4.3, "m")
    assert amount("alt. 2 601 m") == (2601.0, "m")
    assert amount("11'9\"") == (11.75, "ft")
    assert amount("thirty-five-ft.") == (35.0, "ft")
    assert amount("none") is None and amount(None) is None and amount(" ") is None
    assert unit("ft asl") == "ft" and unit("M") == "m" and unit(None) is None
    assert height_in("Ground cabin w/ 12x12 cab (6.1 m)") == (6.1, "m")
    assert height_in("Open platform, 7 ft catwalk round it") is None and height_in("cab, 14x14 ft cab") is None


def test_viterbi_finds_switches_without_evidence():
    rng = np.random.default_rng(0)
    wrong = 0
    for _ in range(50):
        level = rng.uniform(500, 3000)
        truth = np.repeat([0, 1, 0], [6, 5, 4])
        metres = level * np.exp(rng.normal(0, 0.01, 15))
        value = metres / np.where(truth == 0, 1.0, 0.3048)
        evidence = np.where(np.arange(15) < 2, 0, -1)
        state = units.viterbi(value, evidence, np.full(15, units.NOTED), np.array([15]))
        wrong += (state != truth).any()
    assert wrong == 0


def test_decode_stated_unit_holds_and_hot_device(spark):
    rows = [(i, "d", i, 1000.0 if i % 2 else 3280.84, "m" if i % 2 else "ft", units.STATED) for i in range(9000)] + [(10001, None, 1, 5.0, None, 0.0)]
    got = units.decode(spark.createDataFrame(rows, "id bigint, device string, ordinal bigint, value double, evidence string, weight double"))
    assert got.count() == 9001
    assert got.where("device = 'd' and abs(metres - 1000) > 1").count() == 0


def test_lengths_with_nulls_everywhere(spark, sf):
    r = spark.read.parquet(f"{sf}/source_record.parquet")
    blank = spark.createDataFrame([r.first()], r.schema).selectExpr("record_id", *[f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in r.schema if f.name != "record_id"])
    s = spark.read.parquet(f"{sf}/source_info.parquet")
    assert units.lengths_in_metres(blank, s).count() == 0
    assert units.lengths_in_metres(r.limit(0), s).count() == 0
    assert nested.linked_children(blank).count() == 0
    assert pd.notna(units.lengths_in_metres(r, s).toPandas()["value_m"]).all()


def test_long_device_is_cut_by_time_with_its_state(spark):
    rng = np.random.default_rng(5)
    factor = {"m": 1.0, "ft": 1 / 0.3048}
    unit, rows = "m", []
    for i in range(3000):
        unit = unit if rng.random() > 0.01 else ("ft" if unit == "m" else "m")
        said = [None, None, None, unit][rng.integers(4)]
        # now and then the field's name says another unit, which the level outweighs
        named = rng.random() < 0.02
        rows.append((i, "d", i // 7, float(1000 * factor[unit] * rng.normal(1, 0.01)), "ten_ft" if named else said, units.NAMED if named else units.STATED if said else 0.0))
    df = spark.createDataFrame(rows, "id bigint, device string, ordinal bigint, value double, evidence string, weight double")
    whole, cut = ({r["id"]: r["unit"] for r in units.decode(df, most).collect()} for most in (10_000, 100))
    assert whole == cut and len(cut) == 3000
    assert sum(u == "ten_ft" for u in whole.values()) == 0
