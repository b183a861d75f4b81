"""Decisions that depend on how much data there is."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgeline.session import written

#: Bounds on a side that is broadcast explicitly.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is small in rows and in bytes (of its JSON form); looks at no more than the allowed rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(row))).alias("b")).head()
    return size["n"] <= max_rows and (size["b"] or 0) <= max_bytes


def hinter(bounded_by: DataFrame, max_rows: int = BROADCAST_ROWS) -> Callable[[DataFrame], DataFrame]:
    """A function that broadcasts sides no larger than ``bounded_by``, or leaves them alone.

    ``bounded_by`` is measured once; a side handed to the result must have at most its rows and no wider ones.
    """
    return F.broadcast if fits(bounded_by, max_rows) else (lambda side: side)


def pick(table: DataFrame, ids: DataFrame, key: str = "did") -> DataFrame:
    """Rows of a large table whose key occurs in ``ids``.

    When the ids fit, they are broadcast and the table is filtered where it is read; a join with what is left then
    moves only those rows. Otherwise both sides meet in one shuffle. ``ids`` is read twice, so hand in a table.
    """
    wanted = ids.select(key).distinct()
    return table.join(hinter(ids)(wanted), key, "left_semi")


def hash32(*parts: Column | str) -> Column:
    """Portable 32-bit number of the joined parts, the same in every engine that has md5."""
    key = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_key(*parts: Column | str) -> Column:
    """md5 of the joined parts, used wherever the work needs a repeatable random order."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def cumulate(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column], keys: list[str] | None = None):
    """Inclusive running sums inside each key group, with no group ordered in one task.

    ``bucket`` must grow with ``order`` (rows of a lower bucket come first). Sums run inside a bucket and are shifted
    by the totals of the lower buckets, so the only ordered pass over a whole group sees one row per bucket. NULL is a
    key like any other, and a NULL bucket comes first.
    """
    keys = list(keys or [])
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    shift = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*keys, "_bucket"]], *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    return (
        rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
        .join(shift, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_bucket"]]))
        .withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in sums})
        .drop("_bucket", *[f"_k_{k}" for k in [*keys, "_bucket"]], *[f"_t_{n}" for n in sums])
    )


def number_rows(
    df: DataFrame, bucket: Column, order: list[Column], keys: list[str] | None = None, name: str = "rn"
) -> DataFrame:
    """Exact 1-based numbering inside each key group, bucket by bucket."""
    return cumulate(df, bucket, order, {name: F.lit(1).cast("long")}, keys)


def cumulate_ranges(df: DataFrame, order: list[Column], sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """``cumulate`` for any order: the buckets are the ranges of the table sorted by keys and order.

    Spark samples the bounds of the ranges, so that they hold about equally many rows however the values are spread, and
    a key with very many rows is cut into many ranges. Only rows that agree in keys and order cannot be parted.
    """
    ranges = written(df.repartitionByRange(*(keys or []), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    return cumulate(ranges, F.col("_part"), order, sums, keys).drop("_part")


def number_ranges(df: DataFrame, order: list[Column], keys: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Exact 1-based numbering inside each key group, range by range."""
    return cumulate_ranges(df, order, {name: F.lit(1).cast("long")}, keys)


#: Lines per bucket when numbering rows by line number.
LINE_BUCKET = 65_536


def number_by_line(df: DataFrame, line: str, keys: list[str] | None = None, name: str = "rn") -> DataFrame:
    """``number_rows`` for an integer order column."""
    return number_rows(df, F.floor(F.col(line) / LINE_BUCKET), [F.col(line)], keys, name)


def number_by_hash(df: DataFrame, hash_col: str, tie: list[str], keys: list[str] | None = None, name: str = "rn"):
    """``number_rows`` for an md5 order column; the first four hex digits make even buckets."""
    return number_rows(df, F.substring(hash_col, 1, 4), [F.col(hash_col), *map(F.col, tie)], keys, name)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles per key, without holding a group's values in one task.

    Values are first counted (map-side), cumulated range by range, and only the two order statistics that each
    quantile needs are kept.
    """
    keys = list(keys or [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    cum = cumulate_ranges(counts, [F.col("_v")], {"_to": F.col("_c")}, keys)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        named = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n")
        cum = cum.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))
    else:
        cum = cum.withColumn("_n", totals.scalar())
    n = F.col("_n")

    def at(position: Column) -> Column:
        return F.max(F.when((position >= F.col("_to") - F.col("_c")) & (position < F.col("_to")), F.col("_v")))

    out = []
    for name, p in probs.items():
        pos = (n - 1) * F.lit(float(p))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        out.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(name))
    return cum.groupBy(*keys).agg(*out)
