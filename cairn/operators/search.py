"""Ranked search of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import normal


def index(features: DataFrame) -> DataFrame:
    """i, n, r with `names` (normalised) and `words` (distinct words of names and of the region)."""
    every = F.array_compact(F.concat(F.array("n"), F.coalesce(F.split("o", r"\|"), F.array().cast("array<string>"))))
    names = F.filter(F.transform(every, normal), lambda x: x != "")
    out = features.select("i", "n", "r", names.alias("names"))
    words = F.flatten(F.transform(F.concat("names", F.array(F.lower(F.coalesce("r", F.lit(""))))), lambda x: F.split(x, " ")))
    return out.withColumn("words", F.array_distinct(F.filter(words, lambda w: w != "")))


def score(query: Column, names: Column, words: Column) -> Column:
    """0: some name begins with the query; 1: each of its words begins a word; 2: it stands within a name (three letters or more); else null."""
    q = normal(query)
    tokens = F.filter(F.split(q, " "), lambda t: t != "")
    return (
        F.when(q == "", F.lit(None).cast("int"))
        .when(F.exists(names, lambda n: n.startswith(q)), 0)
        .when(F.forall(tokens, lambda t: F.exists(words, lambda w: w.startswith(t))), 1)
        .when((F.length(q) >= 3) & F.exists(names, lambda n: n.contains(q)), 2)
    )


def search(features: DataFrame, query: str, most: int = 30) -> DataFrame:
    """(i, n, r, score) of the best: by score, length of the name, name, then id. A limit is the feature here."""
    hit = index(features).withColumn("score", score(F.lit(query), F.col("names"), F.col("words"))).where("score is not null")
    # of a tower's builds the one that ranks first
    best = hit.groupBy("i").agg(F.min(F.struct("score", F.length("n").alias("l"), "n", "r")).alias("b")).select("i", "b.n", "b.r", "b.score")
    return best.orderBy("score", F.length("n"), "n", "i").limit(most)
