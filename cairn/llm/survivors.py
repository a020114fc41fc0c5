"""The surviving value of each field in each group of duplicate records.

Two ways to judge: by a given order of trust (survivors), and by a latent two-sided model (true_values), which infers each
feed's sensitivity and specificity from how feeds agree, and lets a field keep every value that it judges true.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.session import cut

MOST_FEEDS = 1000


def survivors(rows: DataFrame, group: str, row_id: str, usable: Mapping[str, Column], order: list[Column]) -> DataFrame:
    """(grp, field, row_id): of each group of two or more rows and each field with a usable value, the row that survives.

    usable: per field, whether a row's value may survive; a group's rows count whether usable or not. order: Columns, greatest
    first, nulls last; then the smallest id. Rows of a null group have no group. All fields are one aggregation that combines
    before the shuffle, so a group of any size is no burden. Repeated ids count as rows of their own.
    """
    best = F.struct(*[F.coalesce(c, F.lit(None)).alias(f"o{i}") for i, c in enumerate(order)], (-F.col(row_id)).alias("id"))
    fields = list(usable)
    flags = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("grp"), best.alias("_best"), *[F.coalesce(usable[f], F.lit(False)).alias(f"_u{i}") for i, f in enumerate(fields)])
    got = flags.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col(f"_u{i}"), F.col("_best"))).alias(f"_b{i}") for i in range(len(fields))]).where("_n >= 2")
    each = F.array(*[F.struct(F.lit(f).alias("field"), (-F.col(f"_b{i}.id")).alias("row_id")) for i, f in enumerate(fields)])
    return got.select("grp", F.inline(each)).where("row_id is not null")


def _logit(p: float) -> float:
    import math

    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def true_values(claims: DataFrame, rounds: int = 12, prior: float = 0.5) -> tuple[DataFrame, dict[tuple[str, str], tuple[float, float]]]:
    """(grp, field, value, truth) of every claimed value that the model holds for true, and of the likeliest one where it holds none, and
    each (field, feed)'s sensitivity and specificity.

    claims(grp, field, feed, value); rows with a null are left out, repeated claims count once. A feed that says anything of a
    group's field and doesn't claim a value speaks against it. Expectation: the probability that a value is true, given who claims it and who
    doesn't. Maximisation: how often each feed claims true values and refrains from false ones. Facts of one pattern (field
    and who says what) are alike, so the rounds run over the patterns, whose number doesn't follow the data; only two numbers
    of each feed come to the driver, of at most MOST_FEEDS feeds.
    """
    c = claims.dropna(subset=["grp", "field", "feed", "value"]).select("grp", "field", "feed", "value").distinct()
    facts = c.groupBy("grp", "field", "value").agg(F.sort_array(F.collect_set("feed")).alias("by"))
    cover = c.groupBy("grp", "field").agg(F.sort_array(F.collect_set("feed")).alias("covered"))
    known = facts.join(cover, ["grp", "field"])
    patterns = cut(known.groupBy("field", "by", "covered").agg(F.count(F.lit(1)).alias("n")))
    feeds = [(r["field"], r["feed"]) for r in patterns.select("field", F.explode("covered").alias("feed")).distinct().limit(MOST_FEEDS + 1).collect()]
    if len(feeds) > MOST_FEEDS:
        raise ValueError(f"more than {MOST_FEEDS} feeds and fields")
    quality = {f: (0.8, 0.8) for f in feeds}

    def truth() -> Column:
        import math

        name = lambda field, feed: f"{field}\0{feed}"
        yes, no = {}, {}
        for (field, feed), (sens, spec) in quality.items():
            sens, spec = min(max(sens, 0.02), 0.98), min(max(spec, 0.02), 0.98)
            yes[name(field, feed)] = math.log(sens / (1 - spec))
            no[name(field, feed)] = math.log((1 - sens) / spec)
        table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
        vote = lambda feed: F.when(F.array_contains("by", feed), F.element_at(table(yes), F.concat_ws("\0", "field", feed))).otherwise(F.element_at(table(no), F.concat_ws("\0", "field", feed)))
        odds = F.aggregate("covered", F.lit(_logit(prior)), lambda s, feed: s + vote(feed))
        return 1 / (1 + F.exp(-odds))

    for _ in range(rounds if feeds else 0):
        seen = patterns.select("field", "by", "n", truth().alias("p"), F.explode("covered").alias("feed")).withColumn("says", F.array_contains("by", F.col("feed")))
        # Beta priors keep a feed with few claims near the middle
        stats = seen.groupBy("field", "feed").agg(
            ((F.sum(F.when(F.col("says"), F.col("n") * F.col("p")).otherwise(0.0)) + 4) / (F.sum(F.col("n") * F.col("p")) + 5)).alias("sens"),
            ((F.sum(F.when(~F.col("says"), F.col("n") * (1 - F.col("p"))).otherwise(0.0)) + 4) / (F.sum(F.col("n") * (1 - F.col("p"))) + 5)).alias("spec"),
        )
        quality = {(r["field"], r["feed"]): (r["sens"], r["spec"]) for r in stats.collect()}
    if not feeds:
        return known.select("grp", "field", "value", F.lit(0.0).alias("truth")).where(F.lit(False)), {}
    judged = known.select("grp", "field", "value", F.round(truth(), 6).alias("truth"))
    # a group always keeps a value: on a tie the smallest
    first = F.row_number().over(W.partitionBy("grp", "field").orderBy(F.desc("truth"), "value"))
    return judged.withColumn("_n", first).where("truth >= 0.5 or _n = 1").drop("_n"), quality
