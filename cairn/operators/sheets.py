"""Old map sheets: which are drawn at a zoom, how they rank, which covers a point; and rows of labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from cairn.operators.proximity import crossings
from cairn.session import whole_groups
from cairn.vocab import ERA_YEARS


def drawn_at(scale: Column, zoom: float) -> Column:
    """Is a scale drawn at a zoom: broad sheets far out, detailed ones closer in, none below 9."""
    if zoom < 9:
        return F.lit(False)
    if zoom < 12:
        return scale >= (100_000 if zoom < 10 else 48_000)
    return (scale <= 125_000) & (scale != 100_000)


def boxes_meet(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Do two boxes (x0, y0, x1, y1) overlap by more than an edge."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def ranked(sheets: DataFrame, era: str, zoom: float, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """sheets(scan_id, name, scale, year, imprint, x0, y0, x1, y1, ...) that are drawn, with `place`, 1 first.

    Reprints of one edition count once: the earliest imprint, an unknown one last, then the smallest scan. Order: nearest to
    the era's year, then the older (the newer for `newest`), the more detailed, the earlier imprint, the smaller scan.
    """
    s = sheets.where(drawn_at(F.col("scale"), zoom))
    if box:
        s = s.where(boxes_meet(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(map(F.lit, box))))  # type: ignore[arg-type]
    imprint = F.coalesce("imprint", F.lit(9999))
    corners = [F.round(c, 2) for c in ("x0", "y0", "x1", "y1")]
    copy = F.row_number().over(W.partitionBy("name", "scale", "year", *corners).orderBy(imprint, "scan_id"))
    first = s.withColumn("_c", copy).where("_c = 1").drop("_c")
    order = [F.abs(F.col("year") - ERA_YEARS[era]), F.desc("year") if era == "newest" else F.col("year"), "scale", imprint, "scan_id"]
    return first.withColumn("place", F.row_number().over(W.orderBy(*order)))  # one window: a list of the sheets of one view


def sheet_at(points: DataFrame, sheets: DataFrame, key: str) -> DataFrame:
    """(key, scan_id): of each point the best placed sheet whose outline holds it. sheets(scan_id, place, rings, x0, y0, x1, y1)."""
    cells = lambda a, b: F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int"))
    s = sheets.withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("y0", "y1")))
    p = points.select(key, "lat", "lon", F.floor("lon").cast("int").alias("_cx"), F.floor("lat").cast("int").alias("_cy"))
    met = p.join(s, ["_cx", "_cy"]).where("lon between x0 and x1 and lat between y0 and y1").where(crossings(F.col("rings"), F.col("lon"), F.col("lat")) % 2 == 1)
    best = met.groupBy(key).agg(F.min(F.struct("place", "scan_id")).alias("b"))
    return best.select(key, "b.scan_id")


def sheets_in_view(box: tuple[float, float, float, float], sheets: DataFrame, across: int = 9, down: int = 7) -> DataFrame:
    """(scan_id, share): of a grid of points over a view, which share each sheet is drawn at; the largest first."""
    x0, y0, x1, y1 = box
    spark = sheets.sparkSession
    grid = spark.range(across * down).select("id", (F.lit(x0) + (F.col("id") % across + 0.5) * ((x1 - x0) / across)).alias("lon"), (F.lit(y0) + (F.floor(F.col("id") / across) + 0.5) * ((y1 - y0) / down)).alias("lat"))
    return sheet_at(grid, sheets, "id").groupBy("scan_id").agg((F.count(F.lit(1)) / (across * down)).alias("share")).orderBy(F.desc("share"), "scan_id")


def label_rows(labels: DataFrame, group: str, rows: int = 2, gap: float = 6.0) -> DataFrame:
    """labels(group, item, x, width, score) with `row`, null where there is no room: the highest score first, each in the lowest row where it is free.

    What is placed depends on what was placed before, so a group (one view) is packed in order; groups are packed side by side.
    """
    placed = labels.repartition(group).sortWithinPartitions(group, F.desc("score"), "item")
    schema = StructType([*(f for f in labels.schema.fields if f.name != "row"), StructField("row", IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, (group,)):
            taken: list[list[tuple[float, float]]] = []
            out, before = [], object()
            for g, x, w in zip(b[group], b["x"], b["width"], strict=True):
                if g != before:
                    taken, before = [[] for _ in range(rows)], g
                row = next((r for r in range(rows) if all(x + w + gap < lo or x > hi + gap for lo, hi in taken[r])), None)
                if row is not None:
                    taken[row].append((x, x + w))
                out.append(row)
            yield b.assign(row=pd.array(out, dtype="Int32"))

    return placed.mapInPandas(run, schema)
