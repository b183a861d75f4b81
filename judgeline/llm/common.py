"""What the operators of this folder share: texts as bytes, Arrow maps, crc32 folds, digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgeline.session import written

#: Texts handed to one vectorised step.
SLICE_BYTES = 4 << 20
#: Rows of one key that are compared in one place; more are dealt out in blocks of this size.
HOT = 4096
#: Of shingle hashes.
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``doc_id, text`` as UTF-8 bytes (null: empty), whatever else the table holds."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"),
        *more)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(parts))


def slices(
    batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES, sizes: pa.Array | None = None,
) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts sum to about ``limit`` bytes; a single longer text is a piece of its own.

    ``sizes`` gives the bytes of each row where they are not those of ``column``.
    """
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)) if sizes is None else sizes
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def shingle_hashes(text: bytes, width: int, hasher) -> np.ndarray:
    """A hash for each ``width`` consecutive lower-cased (A-Z) white-space words; fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    if n == 1:
        return np.array([hasher(line, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], stops[:n - 1])).tolist()
    return np.array([hasher(line[a:b], SEED) for a, b in zip(starts, (stops[width - 1:] - 1).tolist())], np.uint64)


def meet(
    rows: DataFrame, keys: list[str], counted: DataFrame, hot: int = HOT, *, weight: Column | None = None,
) -> DataFrame:
    """Rows of equal ``keys`` in one place, sorted by them and ``block``; every two rows of a key meet in some block.

    Keys with more than ``hot`` rows in ``counted`` (or more than ``hot`` in sum of their rows' ``weight``) are split:
    their rows fall into blocks by ``id``, and each pair of blocks is a place of its own. Counts are summed map-side.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    many = counted.groupBy(*keys).agg(size.alias("n")).where(F.col("n") > hot)
    many = written(many.select(*keys, F.ceil(F.col("n") / hot).alias("blocks")), "hot-keys")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
    with_all = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda j: F.least(mine, j) * F.col("blocks") + F.greatest(mine, j))
    block = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(with_all)
    dealt = rows.join(many, keys, "left").select(*rows.columns, F.explode(block).alias("block"))
    return dealt.repartition(*keys, "block").sortWithinPartitions(*keys, "block")


def join_split(
    rows: DataFrame, side: DataFrame, keys: list[str], spread: str, how: str = "inner", places: int = 65_536,
) -> DataFrame:
    """``rows`` joined with ``side`` (few rows per key) on ``keys``, with the rows of frequent keys dealt to many tasks.

    Rows are counted by hash of their key in at most ``places`` places, whatever the size of ``rows``, so that these
    counts may be broadcast. Places far above the average are split by ``spread``, and ``side`` is repeated for each part.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(places)).cast("int")
    counts = rows.groupBy(place.alias("_place")).agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts, "places")
    mean = counts.agg((F.coalesce(F.sum("_n"), F.lit(0)) / places).alias("m")).scalar()
    parts = F.ceil(F.col("_n") / (mean * 4 + HOT)).cast("int")
    many = F.broadcast(counts.select("_place", parts.alias("_parts")).where("_parts > 1"))
    dealt = rows.withColumn("_place", place).join(many, "_place", "left").withColumn(
        "_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_place", "_parts")
    repeated = side.withColumn("_place", place).join(many, "_place", "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_place", "_parts")
    return dealt.join(repeated, [*keys, "_part"], how).drop("_part")


def map_texts(df: DataFrame, make: Callable, schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded size.

    ``make()`` runs once per task and returns a function from a RecordBatch to a dict of columns.
    """
    def run(batches):
        work = make()
        for batch in batches:
            for piece in slices(batch, limit=limit):
                yield pa.RecordBatch.from_pydict(work(piece), schema=fields)

    fields = arrow_schema(schema)
    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow types of a flat Spark schema string."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
        "float": pa.float32(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
        "array<boolean>": pa.list_(pa.bool_()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (f.strip().split(" ", 1) for f in schema.split(","))])
