"""What stood when: states of a year, counts by year, ranges from events, gaps and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.vocab import BUILD_EVENTS, END_EVENTS, FIRST_YEAR, START_EVENTS, THIS_YEAR

#: stood: the records place it there; built: its end isn't recorded; nostart: its beginning isn't; nodates: neither is; no: not there.
MAYBE = ("built", "nostart", "nodates")
SEEN = ("stood", *MAYBE)
STANDS_TODAY = ("standing", "replica")


def year_state(year: Column, status: Column, y0: Column, y1: Column, now: int = THIS_YEAR) -> Column:
    """stood, built, nostart, nodates or no in a year. From this year on, today's status tells; a null status is an unknown one."""
    status = F.coalesce(status, F.lit("unknown"))
    stands = status.isin(*STANDS_TODAY)
    today = F.when(stands, "stood").when((status != "unknown") | y1.isNotNull(), "no").when(y0.isNull(), "nodates").otherwise("built")
    ended = stands | y1.isNotNull()
    then = (
        F.when(F.coalesce((y0 > year) | (y1 <= year), y0 > year, y1 <= year, F.lit(False)), "no")
        .when(ended, F.when(y0.isNotNull(), "stood").otherwise("nostart"))
        .otherwise(F.when(y0.isNotNull(), "built").otherwise("nodates"))
    )
    return F.when(year >= now, today).otherwise(then)


def _counted(states: Column, weight: Column) -> list[Column]:
    """A sum for each state and their total, the most that could have stood."""
    each = [F.coalesce(F.sum(F.when(states == s, weight)), F.lit(0)).cast("bigint").alias(s) for s in SEEN]
    return [*each, F.coalesce(F.sum(F.when(states.isin(*SEEN), weight)), F.lit(0)).cast("bigint").alias("upper")]


def year_counts(features: DataFrame, year: int, now: int = THIS_YEAR) -> DataFrame:
    """(year, stood, built, nostart, nodates, upper) in one year; one row, of zeros for no features."""
    at = features.select(year_state(F.lit(year), F.col("s"), F.col("y0"), F.col("y1"), now).alias("state"))
    return at.agg(*_counted(F.col("state"), F.lit(1))).select(F.lit(year).alias("year"), *SEEN, "upper")


def year_series(features: DataFrame, first: int, last: int, now: int = THIS_YEAR) -> DataFrame:
    """year_counts of every year: one pass of differences instead of a count for each year.

    Every feature changes its state at most three times; +1 and -1 at those years are summed by year, which leaves a table
    whose size doesn't follow the features, and that one is summed up along the years.
    """
    at = lambda y: year_state(y, F.col("s"), F.col("y0"), F.col("y1"), now)
    clip = lambda y: F.least(F.greatest(y, F.lit(first)), F.lit(last + 1))
    known = [F.lit(first), F.when(F.col("y0").isNotNull(), clip(F.col("y0"))), F.when(F.col("y1").isNotNull(), clip(F.col("y1"))), clip(F.lit(now))]
    turns = F.array_distinct(F.array_compact(F.array(*known)))
    steps = F.transform(turns, lambda y: F.struct(y.alias("year"), at(y).alias("state"), F.when(y > first, at(y - 1)).alias("before")))
    ends = features.select("s", "y0", "y1").select(F.inline(steps)).where(f"year <= {last}")
    deltas = ends.select("year", F.inline(F.array(F.struct(F.col("state").alias("state"), F.lit(1).alias("d")), F.struct(F.col("before").alias("state"), F.lit(-1).alias("d")))))
    summed = deltas.groupBy("year").agg(*_counted(F.col("state"), F.col("d")))
    calendar = features.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    run = W.orderBy("year").rowsBetween(W.unboundedPreceding, 0)  # one row for each year
    return calendar.join(summed, "year", "left").select("year", *[F.coalesce(F.sum(c).over(run), F.lit(0)).cast("bigint").alias(c) for c in (*SEEN, "upper")])


def plausible(year: Column, now: int = THIS_YEAR) -> Column:
    return year.between(FIRST_YEAR, now)


def year_range(rows: DataFrame, key: str, status: str = "status", events: str = "events") -> DataFrame:
    """(key, y0, y1): first start; and, if it doesn't stand, the first end not before the last (re)building. Years that can't be are ignored."""
    e = F.filter(F.coalesce(events, F.array()), lambda x: x.isNotNull() & F.coalesce(plausible(x.year), F.lit(False)))
    years = lambda wanted: F.transform(F.filter(F.col("_e"), lambda x: x.event.isin(*wanted)), lambda x: x.year)
    out = rows.select(key, F.col(status).alias("_s"), e.alias("_e")).select(key, "_s", years(START_EVENTS).alias("_start"), years(END_EVENTS).alias("_end"), years(BUILD_EVENTS).alias("_built"))
    after = F.filter("_end", lambda y: y >= F.coalesce(F.array_max("_built"), y))
    return out.select(key, F.array_min("_start").alias("y0"), F.when(~F.coalesce(F.col("_s"), F.lit("unknown")).isin(*STANDS_TODAY), F.array_min(after)).alias("y1"))


def gaps(events: DataFrame, key: str, year: str = "year", least: int = 15) -> DataFrame:
    """(key, from_year, to_year): neighbouring dated events at least so many years apart."""
    w = W.partitionBy(key).orderBy(year)
    seen = events.where(F.col(year).isNotNull()).select(key, F.lag(year).over(w).alias("from_year"), F.col(year).alias("to_year"))
    return seen.where(F.col("to_year") - F.col("from_year") >= least)


def segments(features: DataFrame, key: str = "i", now: int = THIS_YEAR) -> DataFrame:
    """(key, phase, from_year, to_year): when it stood, when that isn't known, when it was gone."""
    y0, y1, stands = F.col("y0"), F.col("y1"), F.coalesce(F.col("s"), F.lit("")).isin(*STANDS_TODAY)
    seg = lambda phase, a, b: F.struct(F.lit(phase).alias("phase"), a.cast("int").alias("from_year"), b.cast("int").alias("to_year"))
    end = F.coalesce(y1, F.when(stands, F.lit(now)))
    each = F.array(
        F.when(y0.isNotNull() & end.isNotNull(), seg("stood", y0, end)),
        F.when(y0.isNotNull() & end.isNull(), seg("unknown", y0, F.lit(now))),
        F.when(y1.isNotNull() & ~stands, seg("gone", y1, F.lit(now))),
    )
    return features.select(key, F.inline(F.filter(each, lambda x: x.isNotNull() & (x.to_year > x.from_year))))


def history_counts(features: DataFrame) -> DataFrame:
    """Coverage of histories by country and in all."""
    c = F.coalesce("cc", F.lit("US"))
    measures = {"total": F.lit(True), "with_start": F.col("y0").isNotNull(), "with_end": F.col("y1").isNotNull(), "with_both": F.col("y0").isNotNull() & F.col("y1").isNotNull(), "standing": F.col("s").isin(*STANDS_TODAY), "standing_dated": F.col("s").isin(*STANDS_TODAY) & F.col("y0").isNotNull(), "gone": F.col("s") == "gone", "gone_dated": (F.col("s") == "gone") & F.col("y1").isNotNull()}
    return features.withColumn("country", c).rollup("country").agg(*[F.count_if(F.coalesce(m, F.lit(False))).alias(k) for k, m in measures.items()])
