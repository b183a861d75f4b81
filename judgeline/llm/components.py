"""Connected components of links between numbers, by alternating large-star and small-star rounds.

Every round moves only links; minima are aggregated map-side, and the joins on hot centres are plain shuffles that
adaptive execution splits. Each round is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgeline.session import written


def _stars(links: DataFrame, lower_only: bool) -> DataFrame:
    """One star round on ``a > b`` links: neighbours are hung on the smallest node of each neighbourhood."""
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not lower_only:
        pairs = pairs.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
    hung = pairs.join(low.hint("merge"), "u")
    if lower_only:
        out = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b`` longs, any direction): root is its smallest node."""
    now = written(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        hung = written(_stars(now, lower_only=False), "links")
        now = written(_stars(hung, lower_only=True), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
