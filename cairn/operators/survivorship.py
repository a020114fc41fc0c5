"""One entity from its records, field by field; the guards and overlays around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranked_fields(members: DataFrame, ranks: DataFrame, group: str, fields: list[str], row_id: str) -> DataFrame:
    """One row for each group: every field's first value by its own order of sources, and `conflicts`.

    ranks(field, source, rank), few rows: the order may differ by field. A source without a rank comes last; ties go to the
    smallest id. conflicts: the fields with several values, each as ARRAY<STRUCT(source, value)> in order.
    """
    order = ranks.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("field", "rank"))).alias("_rank"))
    placed = members.join(F.broadcast(order), "source", "left")  # a row for each source
    place = lambda f: F.struct(F.coalesce(F.try_element_at("_rank", F.lit(f)), F.lit(1 << 30)), F.col(row_id))
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), place(f))).alias(f) for f in fields]
    every = [F.collect_set(F.when(F.col(f).isNotNull(), F.struct("source", F.col(f).cast("string").alias("value")))).alias(f"_all_{f}") for f in fields]
    out = placed.groupBy(group).agg(*first, *every)
    several = lambda f: F.when(F.size(F.array_distinct(F.transform(f"_all_{f}", lambda x: x.value))) > 1, F.struct(F.lit(f).alias("field"), F.array_sort(f"_all_{f}").alias("values")))
    return out.withColumn("conflicts", F.array_compact(F.array(*map(several, fields)))).drop(*[f"_all_{f}" for f in fields])


def event_union(members: DataFrame, group: str, rank: Column) -> DataFrame:
    """(group, year, event, note, source): events of all records, one of each name and year: of the best rank, then the smallest note.

    members(group, source, events). Events without a name are left out; a null year is a year of its own.
    """
    e = members.select(F.col(group), "source", rank.alias("_rank"), F.explode("events").alias("e")).where("e.event is not null")
    best = e.groupBy(group, F.col("e.year").alias("year"), F.col("e.event").alias("event")).agg(F.min(F.struct("_rank", F.col("e.note").isNull().alias("bare"), F.col("e.note").alias("note"), "source")).alias("b"))
    return best.select(group, "year", "event", "b.note", "b.source")


def link_union(members: DataFrame, group: str) -> DataFrame:
    """(group, url, label, kind): the links of all records, each url once, with the label of the first source that has one."""
    x = members.select(F.col(group), "source", F.explode("links").alias("l")).where("l.url is not null")
    best = x.groupBy(group, F.col("l.url").alias("url")).agg(F.min(F.struct(F.col("l.label").isNull().alias("bare"), "source", F.col("l.label").alias("label"), F.col("l.kind").alias("kind"))).alias("b"))
    return best.select(group, "url", F.coalesce("b.label", "b.source").alias("label"), "b.kind")


def photo_credits(members: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """(key, url, credit): every photo with its credit, or else its source's title. titles(source, title), few rows."""
    p = members.select(key, "source", F.inline("photos")).where("url is not null")
    return p.join(F.broadcast(titles.select("source", "title")), "source", "left").select(key, "url", F.coalesce(F.nullif(F.trim("credit"), F.lit("")), "title").alias("credit"))


#: Events after which a lookout can't be let.
GONE_EVENTS = ("burned", "destroyed", "removed", "abandoned")


def merged_rental(members: DataFrame, group: str, booked: Column, row_id: str) -> DataFrame:
    """(group, available, provider, url, max_occupancy, status_note, manager, warning): one rental of each group that has any.

    members(group, source, rental, status, events). The rental of the booking system (where `booked`) keeps its details; a
    list adds closure note and manager, and is the rental where it is alone. On an entity whose latest status is gone it isn't
    available, and a warning names the source and year of the last ending event.
    """
    has = F.col("rental").isNotNull()
    first = lambda cond: F.min_by(F.col("rental"), F.when(has & cond, F.col(row_id)))
    ends = F.filter("events", lambda e: e.event.isin(*GONE_EVENTS) & e.year.isNotNull())
    last = F.array_max(F.transform(ends, lambda e: F.struct(e.year.alias("year"), e.event.alias("event"), F.col("source").alias("source"))))
    g = members.groupBy(group).agg(
        first(booked).alias("b"), first(~booked).alias("l"), F.max_by(F.col("status"), F.when(F.col("status").isNotNull(), F.col(row_id))).alias("status"), F.max(last).alias("end")
    ).where("b is not null or l is not null")
    r = F.coalesce("b", "l")
    gone = F.coalesce(F.col("status") == "gone", F.lit(False))
    warning = F.when(gone, F.concat(F.coalesce("end.source", F.lit("a source")), F.lit(" reports this lookout "), F.coalesce("end.event", F.lit("gone")), F.coalesce(F.concat(F.lit(" in "), F.col("end.year").cast("string")), F.lit("")), F.lit(", but it is still listed.")))
    return g.select(group, F.when(gone, False).otherwise(r["available"]).alias("available"), r["provider"].alias("provider"), r["url"].alias("url"), r["max_occupancy"].alias("max_occupancy"), F.coalesce("l.status_note", "b.status_note").alias("status_note"), F.coalesce("l.manager", "b.manager").alias("manager"), F.coalesce(warning, r["warning"]).alias("warning"))


def private_access(agency: Column, ownership: Column, access: Column) -> Column:
    """STRUCT(ownership, access): a private owner makes both private and by permission."""
    private = F.lower(F.coalesce(agency, F.lit(""))).rlike(r"\bprivate")
    return F.struct(F.when(private, "private").otherwise(ownership).alias("ownership"), F.when(private, "permission").otherwise(access).alias("access"))


def latest_status(members: DataFrame, group: str, status: str, as_of: str) -> DataFrame:
    """(group, status, as_of): what is known last; on a tie what says more than unknown, then the smallest word."""
    known = members.where(F.col(status).isNotNull())
    best = known.groupBy(group).agg(F.max(F.struct(F.coalesce(F.col(as_of), F.lit(-1)).alias("at"), (F.col(status) != "unknown").alias("sure"))).alias("m"), F.min(F.struct((-F.coalesce(F.col(as_of), F.lit(-1))).alias("a"), (F.col(status) == "unknown").alias("u"), F.col(status).alias("s"))).alias("b"))
    return best.select(group, F.col("b.s").alias("status"), F.nullif(-F.col("b.a"), F.lit(-1)).alias("as_of"))


def research_overlay(entities: DataFrame, research: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """entities with each field replaced by what research found, where its rule holds; `problems` names the fields where it doesn't.

    research(key, the fields of rules); a null there says nothing. rules: per field, a condition on r_<field>.
    """
    r = research.select(key, *[F.col(f).alias(f"r_{f}") for f in rules])
    j = entities.join(r, key, "left")
    bad = F.array_compact(F.array(*[F.when(F.col(f"r_{f}").isNotNull() & ~F.coalesce(ok, F.lit(False)), f) for f, ok in rules.items()]))
    fields = {f: F.when(F.coalesce(ok, F.lit(False)) & F.col(f"r_{f}").isNotNull(), F.col(f"r_{f}")).otherwise(F.col(f)) for f, ok in rules.items()}
    return j.withColumn("problems", F.array_join(bad, ",")).withColumns(fields).drop(*[f"r_{f}" for f in rules])


def unplaced_groups(unplaced: DataFrame, key: str) -> DataFrame:
    """(region, name_key, county_key, records, first): unplaced records that are one lookout: one name in one region and unit.

    unplaced(key, region, name_key, county_key). Records without a unit go with the only unit of their name, if it is the only one.
    """
    w = W.partitionBy("region", "name_key")
    only = F.when(F.size(F.collect_set("county_key").over(w)) == 1, F.max("county_key").over(w))
    named = unplaced.where("name_key <> ''").withColumn("county_key", F.coalesce("county_key", only))
    return named.groupBy("region", "name_key", "county_key").agg(F.count(F.lit(1)).alias("records"), F.min(key).alias("first"))


def hidden_reason(members: DataFrame, group: str, reason: Column) -> DataFrame:
    """(group, reason): groups all of whose records are out of scope; the smallest of their reasons. reason: null for a record in scope."""
    g = members.groupBy(group).agg(F.bool_and(reason.isNotNull()).alias("out"), F.min(reason).alias("reason"))
    return g.where("out").select(group, "reason")


#: Fixed value: least share of what is held that a new reading must have.
KEPT_SHARE = 0.7


def too_few(found: DataFrame, held: DataFrame, source: str = "source") -> DataFrame:
    """(source, found, held, refused): readings that are too small to replace what is held: none, or fewer than KEPT_SHARE."""
    f, h = (d.groupBy(source).agg(F.count(F.lit(1)).alias(n)) for d, n in ((found, "found"), (held, "held")))
    j = h.join(f, source, "full_outer").select(source, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("held", F.lit(0)).alias("held"))
    return j.withColumn("refused", (F.col("found") == 0) | (F.col("found") < F.col("held") * KEPT_SHARE))
