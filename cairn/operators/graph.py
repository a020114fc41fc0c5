"""Connected components of edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.session import cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of an undirected edge list, with the smallest node of its component.

    Alternating large and small stars: each node hands its larger neighbours, then its smaller ones, over to the smallest
    node it knows, until every edge leads to a component's smallest node. A round is three shuffles, and edges only get fewer.
    Each round's edges are written to the checkpoint folder. Minima are taken over sorted partitions that spill, so a node
    with a third of all edges needs no memory of its own. Loops, repeated edges and edges with a null end do no harm; an
    empty list gives no rows.
    """
    e = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna())
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ordered = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = F.min("v").over(W.partitionBy("u"))
    before = None
    while True:
        both = ordered.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        large = both.withColumn("m", F.least("u", least)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        ordered = cut(small.where("u <> v").distinct())
        state = ordered.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before:
            return nodes.join(ordered.hint("merge"), F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
        before = state
