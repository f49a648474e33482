"""Connected components by alternating large and small stars, one shuffle each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (a, b). Large: each node hangs its larger neighbours on its least neighbour; small: its smaller ones and itself."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    m = both.withColumn("m", F.least(F.min("b").over(Window.partitionBy("a")), F.col("a")))
    if small:
        out = m.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    else:
        out = m.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any ordered type to (node, root), the root being the least node of the component; nodes without edges don't appear. Every round ends in the shared folder, so a lost executor costs a round at most."""
    now, seen = cut(edges.where("a <> b").select("a", "b").distinct(), "edges"), None
    while True:
        now = cut(_star(_star(now, small=False), small=True), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
