"""Spellings of one lookout, linked.

Spellings are parsed into a lookout's own words, kind of place and qualifiers; equal parts are one form. The own words of one
region meet in a symmetric-delete index, all of a name's letters as one and each token by itself: two that share a string left
after deleting letters are candidates. Their tokens are aligned by optimal assignment, in any order, allowing initials and
abbreviations, and place and county decide where the names alone don't. Forms that one record, key or tower bears are linked as well; components of all links are the lookouts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.llm.edits import Words
from cairn.llm.names import BYNAMES, Name, abbreviates, align, bones, deletes, parse, slips
from cairn.operators.graph import components
from cairn.operators.proximity import haversine, repaired
from cairn.operators.units import payload
from cairn.session import plain, written

#: Metres between two forms' places: surely near, and surely far.
NEAR, FAR = 8_000.0, 30_000.0


def county_key(county: Column) -> Column:
    """A county's name without accents of case, marks and the word for a county."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(county), r"\b(county|co|parish|district|cty)\b\.?", ""), r"[^\p{L}]", ""), F.lit(""))


def aliases(v: Column) -> Column:
    """The strings under `aliases` of a payload (a VARIANT): a list of strings, of objects with a name, or one string."""
    get = lambda kind: F.try_variant_get(v, "$.aliases", kind)
    named = F.filter(get("array<variant>"), lambda x: x.isNotNull())
    each = F.transform(named, lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$", "string")))
    one = F.array(F.coalesce(F.try_variant_get(v, "$.aliases.name", "string"), get("string")))
    return F.when(v.isNotNull(), F.coalesce(each, one))


def spellings(records: DataFrame, towers: DataFrame) -> DataFrame:
    """(region, spelling, bearer, lat, lon, county): every spelling, and who bears it: a record key (or record) or a tower."""
    bearer = F.coalesce(F.concat(F.lit("k:"), "rec_key"), F.concat(F.lit("r:"), F.col("record_id").cast("string")))
    lat, lon = repaired(F.col("lat"), F.col("lon"))
    # a payload is parsed once, and only where the key can stand in it, be it as escapes
    may = F.col("extra").contains("aliases") | F.col("extra").contains("\\u")
    base = records.select("region", "name", bearer.alias("bearer"), lat.alias("lat"), lon.alias("lon"), county_key(F.col("county")).alias("county"), F.when(may, payload(F.col("extra"))).alias("_v"))
    mine = base.select("region", F.explode(F.concat(F.array("name"), F.coalesce(aliases(F.col("_v")), F.array()))).alias("spelling"), "bearer", "lat", "lon", "county")
    there_lat, there_lon = repaired(F.col("location.lat"), F.col("location.lon"))
    theirs = towers.select("region", F.explode(F.concat(F.array("name"), F.coalesce("other_names", F.array()))).alias("spelling"), F.concat(F.lit("t:"), "id").alias("bearer"), there_lat.alias("lat"), there_lon.alias("lon"), county_key(F.col("county")).alias("county"))
    return mine.unionByName(theirs).where("region is not null and length(trim(spelling)) > 0")


def _parsed(seen: DataFrame) -> DataFrame:
    """Every spelling with its parts and the number of its form; those that could stand for any lookout are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Name] = {}
        for b in batches:
            for s in set(b["spelling"]).difference(known):
                known[s] = parse(s)
            p = [known[s] for s in b["spelling"]]
            if len(known) > 200_000:
                known.clear()
            yield plain(b.assign(core=[x.core for x in p], own=[" ".join(x.own) for x in p], kind=[x.kind for x in p], qualifiers=[" ".join(x.qualifiers) for x in p]))

    columns = "region string, spelling string, bearer string, lat double, lon double, county string, core string, own string, kind string, qualifiers string"
    return seen.mapInPandas(run, columns).where("core <> ''").withColumn("form", F.xxhash64("region", "core", "kind", "qualifiers"))


def index_keys(core: str, own: list[str]) -> set[str]:
    """Keys of the symmetric-delete index for one name.

    Letters deleted from all its own words as one; for a name of several tokens, letters deleted from each token, beside the
    initial of each other one, in any order; the consonants alone. Distinct words that share a key of letters are few however
    many rows there are: a word of n letters has fewer than (26 (n + 2))^2 / 2 that come of it by adding two.
    """
    keys = deletes(core, slips(core))
    if len(own) > 1:
        keys = keys | {f"{k} {u[:1]}" for i, t in enumerate(own) if len(t) > 1 for k in deletes(t, min(slips(t), 1)) for j, u in enumerate(own) if j != i}
    return keys | {"=" + b} if len(b := bones(core)) > 3 else keys


def _index(cores: DataFrame) -> DataFrame:
    """(key, word) of the symmetric-delete index over (word, region, core, own); word and key are numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [index_keys(c, o.split()) for c, o in zip(b["core"], b["own"], strict=True)]
            size = [*map(len, keys)]
            yield pd.DataFrame({"word": b["word"].to_numpy().repeat(size), "region": b["region"].to_numpy(object).repeat(size), "key": [*chain.from_iterable(keys)]})

    return cores.mapInPandas(run, "word bigint, region string, key string").select(F.xxhash64("region", "key").alias("key"), "word")


def alignments(a: list[str], b: list[str], own_a: list[str], own_b: list[str]) -> np.ndarray:
    """Cost of reading each name a (as one word, and as tokens) as the name b: the less of the two."""
    words = Words([*a, *b])
    i, j = np.arange(len(a)), np.arange(len(a), 2 * len(a))
    d = words.transposing(i, j, 2)
    longest = np.maximum(words.lengths[i], words.lengths[j])
    most = np.where(longest < 6, 1, 2)
    cost = np.where(d <= most, d.astype(float), 9.0)
    for k in np.flatnonzero(np.abs(words.lengths[i] - words.lengths[j]) >= 2):
        if abbreviates(a[k], b[k]):
            cost[k] = min(cost[k], 0.8)
    for k, (x, y) in enumerate(zip(own_a, own_b, strict=True)):
        tokens = x.split(), y.split()
        if any(len(t) > 1 and min(map(len, t)) == 1 for t in tokens):
            cost[k] = 9.0  # an initial is a token, not a letter more of its neighbour
        if cost[k] and all(len(t) > 1 for t in tokens):
            cost[k] = min(cost[k], align(*tokens))
    return cost


def _aligned(pairs: DataFrame) -> DataFrame:
    """pairs(region, a, b, own_a, own_b) with the cost of their alignment, of those that may be one name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cost = alignments(*(b[c].tolist() for c in ("a", "b", "own_a", "own_b")))
            yield plain(b[["region", "a", "b"]].assign(cost=cost)[cost <= 2])

    return pairs.mapInPandas(run, "region string, a string, b string, cost double")


def link(all_spellings: DataFrame) -> DataFrame:
    """(region, spelling, lookout) of every spelling that isn't common to any lookout. See spelling_pairs."""
    borne = written(_parsed(all_spellings))
    forms = written(
        borne.groupBy("form", "region", "core", "kind", "qualifiers").agg(
            F.percentile_approx("lat", 0.5).alias("lat"), F.percentile_approx("lon", 0.5).alias("lon"), F.mode("county").alias("county"), F.max(F.struct(F.size(F.split("own", " ")), "own")).alias("own")
        ).withColumn("own", F.col("own.own"))
    )
    cores = forms.groupBy("region", "core").agg(F.max(F.struct(F.size(F.split("own", " ")), "own")).alias("own")).select(F.xxhash64("region", "core").alias("word"), "region", "core", "own.own")
    index = _index(cores)
    # A pair meets at many keys: it is made distinct as two numbers before its words are fetched. Every join here grows with
    # the data and is hinted: the index has dozens of rows for each word, but its size is taken to be less than that of the forms.
    met = written(index.alias("x").join(index.alias("y").hint("merge"), F.col("x.key") == F.col("y.key")).where("x.word < y.word").select(F.col("x.word").alias("x"), F.col("y.word").alias("y")).distinct())
    named = lambda n, w: cores.select(F.col("word").alias(w), F.col("region").alias(f"region_{n}"), F.col("core").alias(n), F.col("own").alias(f"own_{n}")).hint("merge")
    some = met.join(named("a", "x"), "x").join(named("b", "y"), "y").where("region_a = region_b").select(F.col("region_a").alias("region"), "a", "b", "own_a", "own_b")
    words = _aligned(some).union(cores.select("region", F.col("core").alias("a"), F.col("core").alias("b"), F.lit(0.0)))
    forms = forms.drop("own")

    left = forms.select([F.col(c).alias(f"{c}_a" if c not in ("region", "qualifiers") else c) for c in forms.columns]).withColumnRenamed("core_a", "a")
    right = forms.select([F.col(c).alias(f"{c}_b" if c not in ("region", "qualifiers") else c) for c in forms.columns]).withColumnRenamed("core_b", "b")
    pairs = words.join(left.hint("merge"), ["region", "a"]).join(right.hint("merge"), ["region", "b", "qualifiers"]).where("form_a <> form_b")
    # a longitude typed without its sign is as near as with it
    metres = F.least(*[haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), sign * F.col("lon_b")) for sign in (1, -1)])
    same_kind, open_kind = F.col("kind_a") == F.col("kind_b"), ((F.col("kind_a") == "") != (F.col("kind_b") == "")) & ~F.col("kind_a").isin(BYNAMES) & ~F.col("kind_b").isin(BYNAMES)
    same_county, other_county = F.coalesce(F.levenshtein("county_a", "county_b") <= 1, F.lit(False)), F.coalesce(F.levenshtein("county_a", "county_b") > 1, F.lit(False))
    near, far, unplaced = F.coalesce(F.col("m") <= NEAR, F.lit(False)), F.coalesce(F.col("m") > FAR, F.lit(False)), F.col("m").isNull()
    fits = (
        F.when(F.col("cost") == 0, F.when(same_kind, True).otherwise(near | same_county | (unplaced & ~other_county)))
        .when(F.col("cost") <= 1, F.when(same_kind, near | same_county | (~far & ~other_county)).otherwise(near | (same_county & ~far)))
        .otherwise(F.when(same_kind, near | (unplaced & same_county)).otherwise(near & ~other_county))
    )
    # A form without a kind may fit several kinds of one word: it keeps the best alone.
    rank = F.col("cost") * 10 + F.when(F.col("m").isNull(), F.when(same_county, 3.0).otherwise(6.0)).otherwise(F.col("m") / 1000)
    bare_first = F.col("kind_a") == ""
    scored = pairs.where(same_kind | open_kind).withColumn("m", metres).where(fits)
    linked = written(scored.select(
        F.when(same_kind | bare_first, F.col("form_a")).otherwise(F.col("form_b")).alias("src"), F.when(same_kind | bare_first, F.col("form_b")).otherwise(F.col("form_a")).alias("dst"),
        F.when(~same_kind, F.when(bare_first, F.col("kind_b")).otherwise(F.col("kind_a"))).alias("full_kind"), rank.alias("r"),
    ))
    bare = linked.where("full_kind is not null")
    best = bare.groupBy("src").agg(F.min_by("full_kind", "r").alias("full_kind"))
    kept = bare.join(best.hint("merge"), ["src", "full_kind"]).select("src", "dst")
    alike = linked.where("full_kind is null").select("src", "dst")

    bears = borne.select("bearer", "form").distinct()
    together = bears.select(F.min("form").over(W.partitionBy("bearer")).alias("src"), F.col("form").alias("dst"))
    found = components(alike.union(kept).union(together))  # every form is borne, so all are among these
    return borne.select("region", "spelling", "form").distinct().join(found.hint("merge"), F.col("form") == F.col("node")).select("region", "spelling", F.col("component").alias("lookout"))


def spelling_classes(records: DataFrame, towers: DataFrame) -> DataFrame:
    """(region, spelling, lookout, links): every spelling with its class, and with how many others it is linked by that.

    The form for classes of any size: as many rows as spellings. See spelling_pairs for what is linked.
    """
    of = written(link(spellings(records, towers)))
    return of.join(of.groupBy("lookout").agg((F.count(F.lit(1)) - 1).alias("links")).hint("merge"), "lookout").select("region", "spelling", "lookout", "links")


def spelling_pairs(records: DataFrame, towers: DataFrame) -> DataFrame:
    """(region, spelling_a, spelling_b): different spellings of one lookout, a before b by code point.

    Rows without region, null and blank names, and names that could stand for any lookout form no pair; repeated rows change
    nothing. A spelling is of one class in its region, so no pair comes twice. A single n, e, s or w is read as a direction.
    """
    of = written(link(spellings(records, towers)))
    a = of.select("lookout", "region", F.col("spelling").alias("spelling_a"))
    b = of.select("lookout", F.col("spelling").alias("spelling_b"))
    return a.join(b.hint("merge"), "lookout").where("spelling_a < spelling_b").select("region", "spelling_a", "spelling_b")
