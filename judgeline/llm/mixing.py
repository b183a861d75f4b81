"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded draw.

Each document is emitted floor(rate) times, plus once more when its hash falls below the rate's fraction. The hash's
seed is chosen per source among ``SEEDS`` candidates: the one whose words come nearest the target. Reruns agree, as
nothing depends on partitions or order.

Defined cases: a null text has size 0 and is taken 0 times its size; a null source is a source of its own, last in
order; a source without words has target 0; rows are judged by their id alone, so repeated rows get equal answers; a
null id is an id of its own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgeline.operators.sizing import hinter
from judgeline.session import written

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest repetition rate.
MOST = 3
#: Candidate seeds; four 32-bit numbers come from one md5.
SEEDS = 32


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")


def draws(id_col: str, seeds: int = SEEDS) -> Column:
    """Array of ``seeds`` numbers in [0, 2^32) for an id, the same in every engine that has md5."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    sums = [F.md5(F.concat(F.lit(f"{i}|"), key).cast("binary")) for i in range((seeds + 3) // 4)]
    numbers = [F.conv(F.substring(s, 1 + 8 * k, 8), 16, 10).cast("long") for s in sums for k in range(4)]
    return F.array(*numbers[:seeds])


def source_targets(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """``source, source_size, target``: shares by weight, none above ``MOST`` times its size.

    ``sizes`` holds one row per document (``source, size``) and is summed map-side. The excess of capped sources goes to
    the others by weight: with sources ordered by MOST * size / weight, those below the common level are capped, and the
    level follows from running sums. One row per source is ordered, never one per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)).cast("double")
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    per = per.withColumn("level", F.col("cap") / F.col("w"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "total": F.sum("source_size").over(everything), "w_all": F.sum("w").over(everything)})
    per = per.withColumn("share", (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    per = per.withColumn("open", F.col("share") <= F.col("level"))
    lowest = F.min(F.when(F.col("open"), F.struct("level", "share"))).over(everything)
    return per.withColumn("common", F.coalesce(lowest["share"], F.lit(0.0))).select(
        "source", "source_size",
        F.when(F.col("level") <= F.col("common"), F.col("cap")).otherwise(F.col("w") * F.col("common")).alias("target"))


def source_plan(sizes: DataFrame, weights: list[int], seeds: int = SEEDS) -> DataFrame:
    """``source, source_size, target, whole, limit, seed`` per source, as a written table.

    A document of the source is taken ``whole`` times, and once more if its draw for ``seed`` is below ``limit``.
    """
    targets = source_targets(sizes, weights)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(rate)).withColumn(
        "limit", F.round((rate - F.floor(rate)) * F.lit(2.0**32)).cast("long"))
    targets = written(targets, "targets")
    rows = with_source(sizes, targets).withColumn("draw", draws("doc_id", seeds))
    trials = rows.groupBy("source").agg(
        F.first("target").alias("target"),
        *[F.sum((F.col("whole") + (F.col("draw")[i] < F.col("limit")).cast("long")) * F.col("size")).alias(f"t{i}")
          for i in range(seeds)])
    misses = F.array(*[
        F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("miss"), F.lit(i).alias("seed")) for i in range(seeds)])
    best = trials.select(F.col("source").alias("_of"), F.array_min(misses)["seed"].alias("seed"))
    return written(targets.join(best, F.col("source").eqNullSafe(F.col("_of"))).drop("_of"), "source-plan")


def with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Joins the written table of sources. It is broadcast after its size was measured; beyond that bound both sides are
    shuffled and adaptive execution splits hot sources."""
    side = hinter(per_source)(per_source.withColumnRenamed("source", "_source"))
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return written(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
            word_count(text_col).alias("size")), "sizes")


def _copies() -> Column:
    return F.col("whole") + (F.get(draws("doc_id"), F.col("seed")) < F.col("limit")).cast("long")


def mix_plan(
    docs: DataFrame, weights: list[int] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies``.

    Texts are read once; the narrow table of sizes is written, and the rest works on it.
    """
    sizes = _sizes(docs, id_col, source_col, text_col)
    rows = with_source(sizes, source_plan(sizes, list(weights))).withColumn("copies", _copies())
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(
    docs: DataFrame, weights: list[int] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mixture takes them. Texts are not shuffled."""
    plan = source_plan(_sizes(docs, id_col, source_col, text_col), list(weights))
    rows = docs.select(
        F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"))
    times = with_source(rows, plan).select("row", _copies().cast("int").alias("copies"))
    return times.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
