"""Set operations on queries, ids and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_queries(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("qid", "query") for s in sets]).dropDuplicates(["qid", "query"])


def intersect_qids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("qid").intersect(b.select("qid"))


def except_qids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("qid").distinct().join(b.select("qid"), "qid", "left_anti")


def upsert_union(sets: list[DataFrame], key: str, value: str) -> DataFrame:
    """Key-value sets merged; the last set that holds a key wins."""
    tagged = [s.select(key, value, F.lit(i).alias("_set")) for i, s in enumerate(sets)]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.max_by(value, "_set").alias(value))


def membership_mask(runs: DataFrame, names: list[str]) -> DataFrame:
    """(qid, did, mask): bit i is set when run ``names[i]`` lists the document."""
    index = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)])
    bit = F.try_element_at(index, F.col("run_id"))
    return runs.where(F.col("run_id").isin(*names)).groupBy("qid", "did").agg(F.bit_or(bit).alias("mask"))
