"""Queries of geodesy, tiles, terrain, text scalars and event windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import geo
from cairn.functions import text as T
from cairn.session import shared_folder, table
from cairn.streaming import events as streams
from cairn.terrain import sight


def _towers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tower").where("location.lat is not null and location.lon is not null").select("id", "region", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"), "elevation_m")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Towers and the next one of their region."""
    w = W.partitionBy("region").orderBy("id")
    return _towers(spark, sf).select("id", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).where("lat2 is not null")


def bearings(spark: SparkSession, sf: str) -> DataFrame:
    b = geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    d = geo.distance_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return _pairs(spark, sf).select("id", F.round(d, 2).alias("metres"), F.round(b, 5).alias("bearing"), geo.compass16(b).alias("compass"))


def destinations(spark: SparkSession, sf: str) -> DataFrame:
    y, x = geo.destination(F.col("lat"), F.col("lon"), F.lit(75.0), F.lit(25_000.0))
    return _towers(spark, sf).select("id", F.round(y, 7).alias("lat"), F.round(x, 7).alias("lon"))


def mercator_tiles(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    tx, ty = geo.tile(F.col("lat"), F.col("lon"), 10)
    return _towers(spark, sf).select("id", F.round(x, 9).alias("mx"), F.round(y, 9).alias("my"), tx.alias("tx"), ty.alias("ty"), geo.cell(F.col("lat"), F.col("lon")).alias("cell"))


def disc_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """A-22, G-07: tiles of the union of all towers' discs of 5 km at zoom 9, with the towers that need each."""
    t = _towers(spark, sf).select("id", F.inline(geo.tiles_for_disc(F.col("lat"), F.col("lon"), 5000.0, 9)))
    return t.groupBy("x", "y").agg(F.count(F.lit(1)).alias("towers"))


def cell_index(spark: SparkSession, sf: str) -> DataFrame:
    return _towers(spark, sf).groupBy(geo.cell(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count(F.lit(1)).alias("count"))


def crossing_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """G-22, G-23: two towers sight a point 20 km from the first; where their bearings cross, and how well."""
    y, x = geo.destination(F.col("lat"), F.col("lon"), F.lit(60.0), F.lit(20_000.0))
    p = _pairs(spark, sf).withColumn("ty", y).withColumn("tx", x)
    p = p.withColumn("b1", geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("ty"), F.col("tx"))).withColumn("b2", geo.bearing_deg(F.col("lat2"), F.col("lon2"), F.col("ty"), F.col("tx")))
    far = geo.distance_m(F.col("lat2"), F.col("lon2"), F.col("ty"), F.col("tx"))
    p = p.where(far < 149_000).withColumn("cut", geo.cut_angle(F.col("b1"), F.col("b2"))).where("cut between 2 and 178")
    p = p.withColumn("fix", geo.crossing(F.col("lat"), F.col("lon"), F.col("b1"), F.col("lat2"), F.col("lon2"), F.col("b2")))
    off = geo.distance_m(F.col("fix.lat"), F.col("fix.lon"), F.col("ty"), F.col("tx"))
    return p.select("id", F.round("cut", 4).alias("cut"), F.round("fix.lat", 5).alias("lat"), F.round("fix.lon", 5).alias("lon"), geo.fix_score(off).alias("score"))


def old_datum(spark: SparkSession, sf: str) -> DataFrame:
    y, x = geo.to_nad27(F.col("lat"), F.col("lon"))
    px, py = geo.polyconic(F.col("lat"), F.col("lon"), -110.0)
    return _towers(spark, sf).select("id", F.round(y, 7).alias("lat27"), F.round(x, 7).alias("lon27"), F.round(px, 2).alias("px"), F.round(py, 2).alias("py"))


def _hills(lat, lon):
    """An invented landscape, of plain functions only."""
    return 600 + 300 * np.sin(lat * 40) * np.cos(lon * 40)


def horizon_windows(spark: SparkSession, sf: str) -> DataFrame:
    """W-01, W-03: of twelve rays of every tower the steepest slope, where it is first reached, and how many samples rise above all before them."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k")
    rays = _towers(spark, sf).select("id", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("ray")).select("*", steps)
    d = F.col("k") * 250.0
    y, x = geo.destination(F.col("lat"), F.col("lon"), F.col("ray") * 30.0, d)
    ground = lambda a, o: 600 + 300 * F.sin(a * 40) * F.cos(o * 40)
    s = rays.select("id", "ray", "k", ((ground(y, x) - ground(F.col("lat"), F.col("lon")) - 10) / d - d * (1 - geo.REFRACTION) / (2 * geo.EARTH_M)).alias("s"))
    w = W.partitionBy("id", "ray").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    seen = s.withColumn("before", F.max("s").over(w))
    return seen.groupBy("id", "ray").agg(F.round(F.degrees(F.atan(F.max("s"))), 5).alias("horizon"), (F.min_by("k", F.struct(-F.col("s"), "k")) * 250).alias("crest_m"), F.count_if(F.coalesce(F.col("s") > F.col("before"), F.lit(True))).alias("visible"))


def panoramas(spark: SparkSession, sf: str) -> DataFrame:
    """G-17 over the invented landscape: 360 columns, up to 60 km."""
    o = _towers(spark, sf).withColumn("above_ground_m", F.lit(10.0))
    return sight.panoramas(o, sight.Surface(_hills), columns=360, most=60_000.0)


def sight_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """G-18, A-18 over the invented landscape: cells of 75 m and how many towers see them from up to 40 km, as the reference's layer does by default."""
    o = _towers(spark, sf).withColumn("above_ground_m", F.lit(10.0))
    return sight.overlay(o, sight.Surface(_hills), most=40_000.0, cell_m=75.0).select("ix", "iy", "seen_by")


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.windows(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = streams.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def event_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of event_windows as a stream computes them: every file once, then the table its last batch leaves in the shared folder."""
    import uuid

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = streams.windows(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    keep = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    keep.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/table")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def revenue_by_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional aggregates over the largest driver table."""
    li = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count(F.lit(1)).alias("n"))


def order_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """W-08 on orders: pauses of a year or more between a customer's orders."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lag(F.col("o_orderdate").cast("date")).over(w)).alias("days"))
    return o.where("days >= 365")


def quadrant_text(spark: SparkSession, sf: str) -> DataFrame:
    """F-42, F-43"""
    b = geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    p = _pairs(spark, sf).select("id", b.alias("b"))
    turn = geo.angle_between(F.lit(0.0), F.col("b"))
    q = F.concat(F.when(F.abs(turn) <= 90, "N").otherwise("S"), F.lit(" "), F.round(F.when(F.abs(turn) <= 90, F.abs(turn)).otherwise(180 - F.abs(turn)), 1).cast("string"), F.lit(" "), F.when(turn >= 0, "E").otherwise("W"))
    return p.select("id", q.alias("quadrant"), T.clip(F.col("id"), 20).alias("short"))


QUERIES = {f.__name__: f for f in (bearings, destinations, mercator_tiles, disc_tiles, cell_index, crossing_fixes, old_datum, horizon_windows, panoramas, sight_overlay, event_windows, event_sessions, event_streamed, revenue_by_flag, order_gaps, quadrant_text)}

_TW = "t as (select id, region, location.lat as lat, location.lon as lon from tower where location.lat is not null and location.lon is not null)"
_PR = f"{_TW}, p as (select * from (select id, lat, lon, lead(lat) over (partition by region order by id) as lat2, lead(lon) over (partition by region order by id) as lon2 from t) where lat2 is not null)"


def _bear(a: str, b: str, c: str, d: str) -> str:
    return f"((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360) % 360)"


def _dist(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def _dest(lat: str, lon: str, bearing: str, metres: str) -> tuple[str, str]:
    d, b, a = f"({metres} / 6371008.8)", f"radians({bearing})", f"radians({lat})"
    y = f"asin(sin({a}) * cos({d}) + cos({a}) * sin({d}) * cos({b}))"
    x = f"(radians({lon}) + atan2(sin({b}) * sin({d}) * cos({a}), cos({d}) - sin({a}) * sin({y})))"
    return f"degrees({y})", f"((degrees({x}) + 540) % 360 - 180)"


_DY, _DX = _dest("lat", "lon", "75.0", "25000.0")
_HY, _HX = _dest("lat", "lon", "(ray * 30.0)", "(k * 250.0)")
_MX, _MY = "((lon + 180) / 360)", "(0.5 - atanh(sin(radians(lat))) / (2 * pi()))"

_POLY_E2 = "(1/294.9786982*(2-1/294.9786982))"
_MER = "(6378206.4 * ((1 - e/4 - 3*e*e/64 - 5*e*e*e/256) * {p} - (3*e/8 + 3*e*e/32 + 45*e*e*e/1024) * sin(2*{p}) + (15*e*e/256 + 45*e*e*e/1024) * sin(4*{p}) - (35*e*e*e/3072) * sin(6*{p})))"

ORACLE = {
    # Molodensky with the shift from WGS84 to NAD27, (8, -160, -176) m; Snyder's polyconic on Clarke 1866
    "old_datum": f"""with {_TW}, c as (select id, lat, lon, radians(lat) as p, radians(lon) as o, 6378137.0 as a, 1/298.257223563 as f, 6378206.4 - 6378137.0 as da, 1/294.9786982 - 1/298.257223563 as df, {_POLY_E2} as e from t),
 g as (select *, a * (1 - f*(2-f)) / pow(1 - f*(2-f) * sin(p) * sin(p), 1.5) as m, a / sqrt(1 - f*(2-f) * sin(p) * sin(p)) as n, a * (1 - f) as b, 6378206.4 / sqrt(1 - e * sin(p) * sin(p)) as pn, radians(lon + 110) * sin(p) as turn from c)
 select id, round(lat + degrees((-8 * sin(p) * cos(o) + 160 * sin(p) * sin(o) - 176 * cos(p) + da * n * f*(2-f) * sin(p) * cos(p) / a + df * (m * a / b + n * b / a) * sin(p) * cos(p)) / m), 7) as lat27,
 round(lon + degrees((-8 * sin(o) - 160 * cos(o)) / (n * cos(p))), 7) as lon27, round(pn / tan(p) * sin(turn), 2) as px, round({_MER.format(p="p")} + pn / tan(p) * (1 - cos(turn)), 2) as py from g""",
    # both towers sight the same point, so that is where their bearings cross
    "crossing_fixes": f"""with {_PR}, t2 as (select *, {_dest('lat', 'lon', '60.0', '20000.0')[0]} as ty, {_dest('lat', 'lon', '60.0', '20000.0')[1]} as tx from p),
 b as (select *, {_bear('lat', 'lon', 'ty', 'tx')} as b1, {_bear('lat2', 'lon2', 'ty', 'tx')} as b2, {_dist('lat2', 'lon2', 'ty', 'tx')} as far from t2), c as (select *, abs((b1 - b2 + 540) % 360 - 180) as cut from b)
 select id, round(cut, 4) as cut, round(ty, 5) as lat, round(tx, 5) as lon, 3 as score from c where far < 149000 and cut between 2 and 178""",
    "quadrant_text": f"""with {_PR}, b as (select id, {_bear('lat', 'lon', 'lat2', 'lon2')} as b from p), q as (select id, case when b > 180 then b - 360 else b end as turn from b)
 select id, case when abs(turn) <= 90 then 'N ' || round(abs(turn), 1) else 'S ' || round(180 - abs(turn), 1) end || case when turn >= 0 then ' E' else ' W' end as quadrant, case when length(id) > 20 then rtrim(substr(id, 1, 19)) || '…' else id end as short from q""",
    "bearings": f"with {_PR}, b as (select id, {_dist('lat', 'lon', 'lat2', 'lon2')} as m, {_bear('lat', 'lon', 'lat2', 'lon2')} as b from p) select id, round(m, 2) as metres, round(b, 5) as bearing, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][(floor(b / 22.5 + 0.5)::int % 16) + 1] as compass from b",
    "destinations": f"with {_TW} select id, round({_DY}, 7) as lat, round({_DX}, 7) as lon from t",
    "mercator_tiles": f"with {_TW} select id, round({_MX}, 9) as mx, round({_MY}, 9) as my, floor({_MX} * 1024)::bigint as tx, floor({_MY} * 1024)::bigint as ty, floor(lat)::int || '_' || floor(lon)::int as cell from t",
    "cell_index": f"with {_TW} select floor(lat)::int || '_' || floor(lon)::int as cell, count(*) as count from t group by 1",
    "horizon_windows": f"""with {_TW}, r as (select id, lat, lon, ray, k from t, (select unnest(range(0, 12)) as ray), (select unnest(range(1, 41)) as k)),
 s as (select id, ray, k, (600 + 300 * sin({_HY} * 40) * cos({_HX} * 40) - (600 + 300 * sin(lat * 40) * cos(lon * 40)) - 10) / (k * 250.0) - k * 250.0 * 0.87 / (2 * 6371008.8) as s from r),
 w as (select *, max(s) over (partition by id, ray order by k rows between unbounded preceding and 1 preceding) as before from s)
 select id, ray, round(degrees(atan(max(s))), 5) as horizon, first(k order by s desc, k) * 250 as crest_m, count_if(before is null or s > before) as visible from w group by id, ray""",
    "event_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_streamed": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),
 s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, max(ts) + interval 30 minutes as end, count(*) as n from s group by user_id, k""",
    "revenue_by_flag": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "order_gaps": "select * from (select o_custkey, o_orderkey, date_diff('day', lag(o_orderdate::date) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate::date) as days from orders) where days >= 365",
}
