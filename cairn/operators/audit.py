"""Audit of what is held, validation by rule tables, the research queue, snapshot differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.operators.proximity import usable


REASONS = ("no_coordinates", "coordinates_outside_country", "duplicate_key", "unmatched")


def coverage(records: DataFrame, holders: DataFrame, boxes: DataFrame, key: str = "rec_key", order: str = "record_id") -> DataFrame:
    """records that have a key, with `visible`, `approximate` (whether a visible entity holds it, and one at an approximate place), `held` and `reason` why it isn't held.

    holders(key, hidden, approximate): what entities hold, a row for each entity. boxes(country, lat0, lat1, lon0, lon1): the
    parts of each country, few rows. A key that isn't held counts as repeated from its second delivery by one source on;
    coordinates that can't be, or lie outside all of the country's boxes, are not the country's.
    """
    shown = ~F.coalesce("hidden", F.lit(False))
    held = holders.where(F.col(key).isNotNull()).groupBy(key).agg(F.bool_or(shown).alias("visible"), F.bool_or(shown & F.coalesce("approximate", F.lit(False))).alias("approximate")).withColumn("held", F.lit(True))
    parts = boxes.groupBy("country").agg(F.collect_list(F.struct("lat0", "lat1", "lon0", "lon1")).alias("_boxes"))
    keyed = records.where(F.length(key) > 0).withColumn("_n", F.row_number().over(W.partitionBy("source", key).orderBy(order)))
    out = keyed.join(held, key, "left").join(F.broadcast(parts), "country", "left")  # a row for each country
    lat, lon = F.col("lat"), F.col("lon")
    inside = usable(lat, lon) & F.exists("_boxes", lambda b: lat.between(b.lat0, b.lat1) & lon.between(b.lon0, b.lon1))
    reason = (
        F.when(F.col("held"), None)
        .when(F.col("_n") > 1, "duplicate_key")
        .when(F.coalesce(inside, F.lit(False)), "unmatched")
        .when(lat.isNotNull() & lon.isNotNull(), "coordinates_outside_country")
        .otherwise("no_coordinates")
    )
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("held", "visible", "approximate")}
    return out.withColumn("reason", reason).withColumns(flags).drop("_n", "_boxes")


def coverage_report(audited: DataFrame) -> DataFrame:
    """(source, nine measures), a total under a null source."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return audited.rollup("source").agg(
        F.count(F.lit(1)).alias("records"), count(F.col("visible")).alias("held_visible"), count(F.col("approximate")).alias("held_approximate"),
        count(F.col("held") & ~F.col("visible")).alias("held_hidden_only"), count(~F.col("held")).alias("not_held"), *[count(F.col("reason") == r).alias(r) for r in REASONS],
    )


def violations(rows: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, level, message) for every rule a row breaks. rules: message -> (level, Column that is true when broken)."""
    each = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(m).alias("message"))) for m, (level, c) in rules.items()])
    return rows.select(key, F.inline(F.array_compact(each)))


def exit_status(found: DataFrame, strict: bool = False) -> int:
    """1 if there is an error, or a warning when strict."""
    bad = found if strict else found.where("level = 'error'")
    return int(not bad.isEmpty())


def tower_rules(statuses: tuple[str, ...], kinds: tuple[str, ...]) -> dict[str, tuple[str, Column]]:
    """Rules of a canonical record."""
    lat, lon = F.col("location.lat"), F.col("location.lon")
    return {
        "id is malformed": ("error", ~F.col("id").rlike("^(us|ca)-[a-z]{2}-[a-z0-9-]+$")),
        "id and region differ": ("error", F.upper(F.split("id", "-")[1]) != F.col("region")),
        "name is missing": ("error", F.coalesce(F.trim("name"), F.lit("")) == ""),
        "status is unknown to the vocabulary": ("error", ~F.col("status").isin(*statuses)),
        "kind is unknown to the vocabulary": ("error", ~F.col("kind").isin(*kinds)),
        "latitude without longitude": ("error", lat.isNull() != lon.isNull()),
        "position is out of range": ("error", (F.abs(lat) > 90) | (F.abs(lon) > 180)),
        "no position": ("warning", lat.isNull()),
        "no county": ("warning", F.col("county").isNull()),
        "name repeats in other names": ("warning", F.array_contains("other_names", F.col("name"))),
        "other name is blank": ("error", F.exists("other_names", lambda x: F.coalesce(F.trim(x), F.lit("")) == "")),
        "verified without a design": ("warning", (F.col("verification") == "verified") & F.col("design").isNull()),
        "height is implausible": ("warning", (F.col("height_m") <= 0) | (F.col("height_m") > 70)),
        "elevation is implausible": ("warning", (F.col("elevation_m") < -100) | (F.col("elevation_m") > 6200)),
        "updated is no date": ("error", ~F.col("updated").rlike(r"^\d{4}-\d{2}-\d{2}$")),
    }


def first_bad(items: Column, fine: Callable[[Column], Column]) -> Column:
    """What is wrong with a list: `[i] is malformed`, with how many more; null if nothing is, or there is no list."""
    bad = F.filter(F.transform(items, lambda x, i: F.struct(i.alias("i"), F.coalesce(fine(x), F.lit(False)).alias("ok"))), lambda x: ~x.ok)
    more = F.when(F.size(bad) > 1, F.concat(F.lit(" (and "), (F.size(bad) - 1).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(bad) > 0, F.concat(F.lit("["), bad[0].i.cast("string"), F.lit("] is malformed"), more))


def record_rules(boxes: Column, countries: tuple[str, ...], ownerships: tuple[str, ...], materials: tuple[str, ...], verifications: tuple[str, ...]) -> dict[str, tuple[str, Column]]:
    """Further rules of a canonical record, beside tower_rules. boxes: ARRAY<STRUCT(lat0, lat1, lon0, lon1)> of its country, null for none."""
    lat, lon = F.col("location.lat"), F.col("location.lon")
    inside = F.exists(boxes, lambda b: lat.between(b.lat0, b.lat1) & lon.between(b.lon0, b.lon1))
    outside = lambda c, vocabulary: c.isNull() | ~c.isin(*vocabulary)
    return {
        "id is too long": ("error", F.length("id") > 120),
        "id country differs from country": ("error", F.split("id", "-")[0] != F.lower("country")),
        "country is not one covered": ("error", outside(F.col("country"), countries)),
        "coordinates are outside the country": ("error", lat.isNotNull() & lon.isNotNull() & ~F.coalesce(inside, F.lit(False))),
        "ownership is not in the vocabulary": ("error", outside(F.col("ownership"), ownerships)),
        "verification is not in the vocabulary": ("error", outside(F.col("verification"), verifications)),
        "material is not in the vocabulary": ("error", F.col("material").isNotNull() & ~F.col("material").isin(*materials)),
        "status_note is neither null nor text": ("error", F.trim("status_note") == ""),
        "elevation_m is not a number": ("error", F.isnan("elevation_m")),
        "height_m is not a number": ("error", F.isnan("height_m")),
        "hidden is not true or false": ("error", F.col("hidden").isNull()),
        "other_names is not a list": ("error", F.col("other_names").isNull()),
        "other_names is malformed": ("error", first_bad(F.col("other_names"), lambda x: F.trim(x) != "").isNotNull()),
        "locked is not a list": ("error", F.col("locked").isNull()),
        "approximate but held for verified": ("warning", F.col("location.approximate") & (F.col("verification") != "unverified")),
    }


def research_rules(statuses: tuple[str, ...], kinds: tuple[str, ...], events: tuple[str, ...]) -> dict[str, tuple[str, Column]]:
    """Rules of a research file: (id, researched, summary, sources, events, evidence, confidence, verification, status, kind), as far as they are columns."""
    http = lambda c: F.coalesce(c.rlike("^https?://"), F.lit(False))
    numbers = F.transform("sources", lambda s: s.n)
    cited = lambda items: F.exists(items, lambda e: (F.coalesce(F.size(e.cite), F.lit(0)) < 1) | (F.size(F.array_except(e.cite, numbers)) > 0))
    v = F.col("verification")
    return {
        "researched is not a date": ("error", ~F.coalesce(F.col("researched").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))),
        "summary is missing": ("error", F.coalesce(F.trim("summary"), F.lit("")) == ""),
        "summary is too long": ("warning", F.length("summary") > 200),
        "sources is missing or empty": ("error", F.coalesce(F.size("sources"), F.lit(0)) < 1),
        "a source has no number": ("error", F.exists("sources", lambda s: s.n.isNull())),
        "a source number is used twice": ("error", F.size(F.array_distinct(numbers)) < F.size(numbers)),
        "a source has no http(s) url": ("error", F.exists("sources", lambda s: ~http(s.url))),
        "a source has no title": ("error", F.exists("sources", lambda s: F.coalesce(F.trim(s.title), F.lit("")) == "")),
        "accessed is not a date": ("warning", F.exists("sources", lambda s: s.accessed.isNotNull() & ~s.accessed.rlike(r"^\d{4}-\d{2}-\d{2}$"))),
        "an event cites no source, or one that isn't there": ("error", cited(F.col("events"))),
        "an event is not in the vocabulary": ("warning", F.exists("events", lambda e: ~F.coalesce(e.event.isin(*events), F.lit(False)))),
        "status is not valid": ("warning", ~F.col("status").isin(*statuses)),
        "kind is not valid": ("warning", ~F.col("kind").isin(*kinds)),
        "confidence is not high, medium or low": ("warning", ~F.col("confidence").isin("high", "medium", "low")),
        "verdict is not pass, fixed or fail": ("error", v.isNotNull() & ~F.coalesce(v["verdict"].isin("pass", "fixed", "fail"), F.lit(False))),
        "checked is not a date": ("error", v.isNotNull() & ~F.coalesce(v["checked"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))),
        "a count is below 0": ("error", (v["claims_checked"] < 0) | (v["unsupported_removed"] < 0) | (v["errors_fixed"] < 0)),
    }


def footnotes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, undefined, unused): numbers referred to without a definition, and defined without a reference."""
    t = F.coalesce(text, F.lit(""))
    numbers = lambda pattern: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))))
    out = docs.select(key, numbers(r"(?md)^\[\^(\d{1,6})\]:").alias("defs"), numbers(r"\[\^(\d{1,6})\](?!:)").alias("refs"))
    got = out.select(key, F.array_except("refs", "defs").alias("undefined"), F.array_except("defs", "refs").alias("unused"))
    return got.where("size(undefined) > 0 or size(unused) > 0")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): added, removed, or changed with the names of the fields that differ, nulls comparing as values."""
    o = old.select(F.col(key), F.struct(*fields).alias("o"))
    n = new.select(F.col(key), F.struct(*fields).alias("n"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), f) for f in fields]))
    j = o.join(n, key, "full_outer").withColumn("change", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed"))
    j = j.withColumn("fields", F.when(F.col("change") == "changed", F.array_join(names, ",")).otherwise(""))
    return j.where("change <> 'changed' or fields <> ''").select(key, "change", "fields")


#: Registers whose entries give a US lookout priority while it stands, and once it is gone.
STANDING_REGISTERS, GONE_REGISTERS = ("NHLR",), ("NHLR", "FFLOS")


def tier(rentable: Column, status: Column, kind: Column, country: Column, registers: Column, link_kinds: Column, approximate: Column, gone: bool = False, gone_all: bool = False) -> Column:
    """Priority of research, 1 first, null for none: to rent, standing and registered, standing; with `gone` also registered
    ones that moved or left ruins, and that are gone; with gone_all any that went and has an exact place, and unknown ones.

    registers, link_kinds: arrays of names. Outside the US any register counts, and any link of the kind `register`.
    """
    empty = F.array().cast("array<string>")
    names, kinds = F.coalesce(registers, empty), F.coalesce(link_kinds, empty)
    foreign = (F.coalesce(country, F.lit("US")) != "US") & ((F.size(names) > 0) | F.array_contains(kinds, "register"))
    on = lambda wanted: F.arrays_overlap(F.array_compact(names), F.array(*map(F.lit, wanted))) | foreign
    built = ~F.coalesce(kind.isin("camp", "tree", "point"), F.lit(False))
    moved, went = status.isin("relocated", "ruins", "replica"), status == "gone"
    out = F.when(rentable, 1).when((status == "standing") & on(STANDING_REGISTERS), 2).when(status == "standing", 3)
    if gone or gone_all:
        out = out.when(built & on(GONE_REGISTERS) & moved, 4).when(built & on(GONE_REGISTERS) & went, 5)
    if gone_all:
        exact = built & ~F.coalesce(approximate, F.lit(False))
        out = out.when(exact & (moved | went), 6).when(exact & (F.coalesce(status, F.lit("unknown")) == "unknown"), 7)
    return out
