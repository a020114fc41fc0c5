"""Entity resolution as a cascade of joins, and the entity built from its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import geo
from cairn.functions.text import normal
from cairn.operators.places import within
from cairn.session import cut

#: Metres within which a name of a given score is enough: (score, metres).
NAME_BY_DISTANCE = ((0.0, 100.0), (0.5, 400.0), (0.9, 1500.0))


def name_key(name: Column) -> Column:
    """A name without the words any lookout may have; Mt is Mount, and Mount goes with Mountain."""
    t = F.regexp_replace(normal(name), r"\b(fire|lookout|lkt|tower|station|site|the)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(mt|mtn|mount)\b", "mountain"), r"\s+", " "))


def name_score(a: Column, b: Column) -> Column:
    """1 for equal keys, 0.5 where one's words are all among the other's, else by edit distance, 0 below a half."""
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(wa, wb))
    close = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(shared == F.least(F.size(wa), F.size(wb)), 0.6).when(close >= 0.5, close).otherwise(0.0)


def cascade(records: DataFrame, towers: DataFrame, overrides: DataFrame | None = None, held: DataFrame | None = None, apart: DataFrame | None = None) -> DataFrame:
    """(key, tower, stage): the first stage that finds a record its tower.

    records(key, source, country, region, county_key, name_keys, lat, lon, registers), towers(tower, country, region, county_key,
    name_key, lat, lon, approximate, registers); name_keys and registers are arrays. Stages: override(key, tower); held(key, tower), the memory of earlier runs;
    a register number that leads to one tower; position and name, the better the name the farther; name alone if it is the only one in region and county;
    else the record is new (it has a position) or unplaced. Never across a border, never by an approximate position, never
    a pair of `apart`(key, tower). Every stage takes the records that are left, so a stage shuffles no more than it must.
    """
    left = records
    out: list[DataFrame] = []

    def take(found: DataFrame, stage: str) -> None:
        nonlocal left
        got = found if apart is None else found.join(apart, ["key", "tower"], "left_anti")
        one = cut(got.groupBy("key").agg(F.min("tower").alias("tower")).withColumn("stage", F.lit(stage)))
        out.append(one)
        left = cut(left.join(one.select("key"), "key", "left_anti"))

    if overrides is not None:
        take(left.join(overrides, "key").join(towers.select("tower"), "tower").select("key", "tower"), "override")
    if held is not None:
        take(left.join(held, "key").join(towers.select("tower"), "tower").select("key", "tower"), "key")
    numbers = left.select("key", "country", F.explode("registers").alias("register")).join(towers.select("tower", F.explode("registers").alias("register"), "country"), ["register", "country"]).select("key", "tower").distinct()
    # numbers that lead to several towers settle nothing
    take(numbers.groupBy("key").agg(F.min("tower").alias("tower"), F.count(F.lit(1)).alias("n")).where("n = 1").select("key", "tower"), "register")
    widest = max(m for _, m in NAME_BY_DISTANCE)
    firm = towers.where("not coalesce(approximate, false)")
    near = within(left, firm, widest, "key", "tower").join(left.select("key", F.col("country").alias("rc"), F.col("name_keys").alias("rn")), "key").join(firm.select("tower", "country", "name_key"), "tower").where("rc = country")
    scored = near.withColumn("score", F.coalesce(F.array_max(F.transform("rn", lambda n: name_score(n, F.col("name_key")))), F.lit(0.0)))
    fits = F.lit(False)
    for least, metres in NAME_BY_DISTANCE:
        fits = fits | ((F.col("score") >= least) & (F.col("metres") <= metres))
    best = scored.where(fits).withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "metres", "tower"))).where("_n = 1")
    take(best.select("key", "tower"), "position")
    same = left.select("key", "region", F.explode("name_keys").alias("name_key"), F.col("county_key").alias("rc")).where("name_key <> ''").join(towers.select("tower", "region", "name_key", "county_key"), ["region", "name_key"]).where("rc is null or county_key is null or rc = county_key")
    take(same.groupBy("key").agg(F.min("tower").alias("tower"), F.count_distinct("tower").alias("n")).where("n = 1").select("key", "tower"), "name")
    rest = left.select("key", F.lit(None).cast("string").alias("tower"), F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), "new").otherwise("unplaced").alias("stage"))
    for o in out:
        rest = rest.unionByName(o)
    return rest


def allocate_ids(new: DataFrame, prefix: Column, slug: Column, taken: DataFrame, order: list[str]) -> DataFrame:
    """new with `id`: prefix-slug, or with the smallest of -2, -3 ... that is free. taken(id).

    Rows that ask for one id get their numbers in the given order, skipping taken ones; an id that another row asks for as it
    is counts as taken, so no id is given twice. The numbers taken of one id are a list, as long as there are namesakes.
    """
    asked = new.withColumn("_base", F.concat_ws("-", prefix, slug))
    bases = asked.select("_base").distinct()
    every = taken.select(F.col("id").alias("t"), F.lit(1).alias("own")).union(bases.select("_base", F.lit(0)))
    number = F.regexp_extract("t", r"-(\d{1,9})$", 1)
    # an id is its own first; and the n-th of what stands before its number
    numbered = every.where((number != "") & ~number.startswith("0") & (number != "1")).select(F.regexp_replace("t", r"-\d+$", "").alias("_base"), number.cast("int").alias("n"))
    held = numbered.union(every.where("own = 1").select("t", F.lit(1))).join(bases, "_base", "left_semi").groupBy("_base").agg(F.array_sort(F.collect_set("n")).alias("_held"))
    place = F.row_number().over(W.partitionBy("_base").orderBy(*order))
    free = F.aggregate(F.coalesce("_held", F.array().cast("array<int>")), F.col("_place"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    out = asked.withColumn("_place", place).join(held, "_base", "left").withColumn("_n", free)
    return out.withColumn("id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_held", "_place", "_n")


def merge_fields(members: DataFrame, group: str, fields: list[str], rank: str) -> DataFrame:
    """One row for each group: every field's first value that isn't null, by rank; and `conflicts`, fields with several values."""
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(rank))).alias(f) for f in fields]
    several = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_c_{f}") > 1, f) for f in fields])), ",")
    out = members.groupBy(group).agg(*first, *[F.count_distinct(f).alias(f"_c_{f}") for f in fields])
    return out.withColumn("conflicts", several).drop(*[f"_c_{f}" for f in fields])


def verification(members: DataFrame, group: str, lineage: str, approximate: str) -> DataFrame:
    """(group, lineages, verification): facts with two independent lineages or more, unverified else or where the position is approximate."""
    got = members.groupBy(group).agg(F.count_distinct(lineage).alias("lineages"), F.bool_or(F.coalesce(approximate, F.lit(False))).alias("_a"))
    return got.select(group, "lineages", F.when(F.col("_a"), "unverified").when(F.col("lineages") >= 2, "facts").otherwise("unverified").alias("verification"))


def corroborated_place(members: DataFrame, group: str, rank: str, metres: float = 250.0) -> DataFrame:
    """(group, lat, lon, corroborated): of each group the position another source confirms, then the best ranked one."""
    p = members.where("lat is not null and lon is not null").select(group, "source", F.col(rank).alias("_r"), "lat", "lon").distinct()
    other = p.select(group, F.col("source").alias("_s"), F.col("lat").alias("_b"), F.col("lon").alias("_q"))
    near = p.join(other, group).where((F.col("source") != F.col("_s")) & (geo.distance_m(F.col("lat"), F.col("lon"), F.col("_b"), F.col("_q")) <= metres))
    backed = near.select(group, "source", "lat", "lon").distinct().withColumn("corroborated", F.lit(True))
    ranked = p.join(backed, [group, "source", "lat", "lon"], "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))
    best = ranked.groupBy(group).agg(F.min(F.struct((~F.col("corroborated")).alias("x"), "_r", "source", "lat", "lon")).alias("b"))
    return best.select(group, "b.lat", "b.lon", (~F.col("b.x")).alias("corroborated"))
