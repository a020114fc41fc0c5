"""Sinks: extracts, partitioned chunks, writes of what changed, manifests, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.geo import cell


def write_extract(records: DataFrame, path: str, problems: DataFrame | None = None) -> None:
    """Records in the order of their key; refused if `problems` holds a row."""
    if problems is not None and (first := problems.limit(5).collect()):
        raise ValueError(f"not written: {first}")
    records.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").json(path)


def write_cells(points: DataFrame, path: str) -> DataFrame:
    """One-degree chunks in the order of position and id; gives their index (cell, count). The folder is replaced."""
    chunks = points.withColumn("cell", cell(F.col("lat"), F.col("lon")))
    chunks.repartition("cell").sortWithinPartitions("cell", "lat", "lon", "id").write.mode("overwrite").partitionBy("cell").parquet(path)
    return chunks.groupBy("cell").agg(F.count(F.lit(1)).alias("count"))


def changed_rows(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows that old lacks or has otherwise, told by a digest of all columns: what an idempotent run has to write."""
    digest = lambda d: d.select(key, F.sha2(F.to_json(F.struct(*sorted(d.columns))), 256).alias("_h"))
    return new.join(digest(new), key).join(digest(old), [key, "_h"], "left_anti").drop("_h")


def upsert_manifest(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """The manifest with new and changed entries of `seen` in place of its own; keyed by url."""
    return manifest.join(seen.select("url"), "url", "left_anti").unionByName(seen, allowMissingColumns=True)


def report(frame: DataFrame, most: int = 1000) -> tuple[str, str]:
    """(aligned table, JSON) of a small report. A report of more rows is refused: it isn't one."""
    rows = frame.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows.to_string(index=False), json.dumps(json.loads(rows.to_json(orient="records")), ensure_ascii=False, indent=1)
