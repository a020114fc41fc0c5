"""Queries of the problems on text and entities, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, canonical, matching, mixing, splitting, survivors, variants
from cairn.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("type_raw", "status_raw", "agency")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return table(spark, sf, "source_record").select("record_id", F.inline(each))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "county").select(F.col("region_name").alias("word"), F.col("region").alias("other")).distinct()
    return canonical.map_values(_typed(spark, sf), table(spark, sf, "ref_value"), codes)


def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values without an entry, by how often they were typed."""
    typed = _typed(spark, sf)
    none = p3_found(spark, sf).where("ref_code = 'none'").select("record_id", "field")
    return typed.join(none, ["record_id", "field"]).groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return variants.spelling_pairs(table(spark, sf, "source_record"), table(spark, sf, "tower"))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling with its class and its number of links."""
    return variants.spelling_classes(table(spark, sf, "source_record"), table(spark, sf, "tower"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_confidence(spark, sf).select("record_id", "tower_id")


def p7_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_records(table(spark, sf, "source_record"), table(spark, sf, "tower"))


def p7_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    """One record key for each tower and one tower for each key, of highest total confidence."""
    records, towers = matching.record_profiles(table(spark, sf, "source_record")), matching.tower_profiles(table(spark, sf, "tower"))
    return matching.one_to_one(matching.candidates(records, towers).where("not alike")).select("record", F.col("entity").alias("tower_id"), F.round("confidence", 6).alias("confidence"))


V_RANK = {"verified": 4, "researched": 3, "facts": 2, "unverified": 1}


def _usable(c: dict | None = None) -> dict[str, Column]:
    return {
        "status": ~F.trim(F.regexp_replace("status", r"\s+", " ")).isin("", "unknown"),
        "built": F.col("built").between(1850, 2026),
        "elevation_m": (F.col("elevation_m") > 0) & (F.col("elevation_m") <= 20000) & ~F.isnan("elevation_m"),
    }


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "source_record").select("rec_key", "record_id", "feed", "retrieved_at", "status", "built", "elevation_m")
    trust = table(spark, sf, "feed_trust").groupBy("feed").agg(F.max("trust").alias("trust"))
    ranked = records.join(trust, "feed", "left")
    mine = survivors.survivors(ranked, "rec_key", "record_id", _usable(), [F.coalesce("trust", F.lit(0)), F.col("retrieved_at")])
    rank = F.coalesce(*[F.when(F.col("v") == v, F.lit(n)) for v, n in V_RANK.items()])
    features = table(spark, sf, "map_feature").select("i", "feature_id", "built_at", "v")
    theirs = survivors.survivors(features, "i", "feature_id", {"v": rank.isNotNull()}, [rank, F.col("built_at")])
    return mine.unionByName(theirs)


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    u = _usable()
    values = {"status": F.col("status"), "built": F.col("built").cast("string"), "elevation_m": F.round("elevation_m").cast("bigint").cast("string")}
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.when(u[f], values[f]).alias("value")) for f in values])
    records = table(spark, sf, "source_record").select(F.col("rec_key").alias("grp"), "feed", F.inline(each))
    # a build of the map is the source of its features' `v`
    builds = table(spark, sf, "map_feature").select(F.col("i").alias("grp"), F.date_format("built_at", "yyyy-MM").alias("feed"), F.lit("v").alias("field"), F.when(F.col("v").isin(*V_RANK), F.col("v")).alias("value"))
    return records.unionByName(builds).where("value is not null")


def p6_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of a delivered record, or a built feature, that the two-sided quality model holds for true."""
    return survivors.true_values(_claims(spark, sf))[0]


def p6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Inferred sensitivity and specificity of each feed, by field."""
    q = survivors.true_values(_claims(spark, sf))[1]
    return spark.createDataFrame([(field, feed, round(a, 6), round(b, 6)) for (field, feed), (a, b) in sorted(q.items())], "field string, feed string, sensitivity double, specificity double")


def _ranks() -> dict[bytes, int]:
    return bpe.read_ranks("byte_bpe_50k.tiktoken", bpe.TOKENIZERS)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.Bpe(_ranks()).encode(table(spark, sf, "documents"))


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts decoded from their ids."""
    b = bpe.Bpe(_ranks())
    return b.encode(table(spark, sf, "documents")).select("doc_id", b.decode(F.col("ids")).alias("text"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_target"), _ranks())


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf), table(spark, sf, "mix_target"))


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(table(spark, sf, "documents"), table(spark, sf, "split_limit"), _ranks())


QUERIES: dict[str, Query] = {
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p6_found": p6_found,
    "p6_truth": p6_truth,
    "p6_quality": p6_quality,
    "p7_found": p7_found,
    "p7_confidence": p7_confidence,
    "p7_one_to_one": p7_one_to_one,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_pieces": p10_pieces,
}

# Groups of two or more rows; of each, the best row among those with a usable value.
_BEST = """select {g} as grp, '{f}' as field, first({id} order by {o}, {id}) as row_id from {t} join (select {g} from {t} where {g} is not null group by {g} having count(*) >= 2) using ({g}) {j} where {u} group by {g}"""
_RECORDS = {"g": "rec_key", "id": "record_id", "t": "source_record", "o": "coalesce(trust, 0) desc, retrieved_at desc nulls last", "j": "left join feed_trust using (feed)"}
_FEATURES = {"g": "i", "id": "feature_id", "t": "map_feature", "o": "list_position(['verified', 'researched', 'facts', 'unverified'], v), built_at desc nulls last", "j": ""}

ORACLE: dict[str, str] = {
    "p6_found": " union all ".join(
        [
            _BEST.format(f="status", u="trim(status) not in ('', 'unknown')", **_RECORDS),
            _BEST.format(f="built", u="built between 1850 and 2026", **_RECORDS),
            _BEST.format(f="elevation_m", u="elevation_m > 0 and elevation_m <= 20000", **_RECORDS),
            _BEST.format(f="v", u="v in ('verified', 'researched', 'facts', 'unverified')", **_FEATURES),
        ]
    ),
    "p8_round_trip": "select doc_id, coalesce(text, '') as text from documents",
}
