"""Ranks, splits, samples and smoothing. Random choices follow md5 order, so they repeat on any cluster."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgeline.operators.sizing import LINE_BUCKET, hash_key, number_by_hash, number_by_line, number_ranges, number_rows

def gold_rank(qrels: DataFrame, line: str = "line_no") -> DataFrame:
    """Rank by label, best first; equal labels keep file order. Ranked range by range, see ``number_ranges``."""
    ranked = number_ranges(qrels, [F.col("label").desc(), F.col(line)], ["qid"], "gold_rank")
    return ranked.withColumn("gold_rank", F.col("gold_rank").cast("int"))


def disagreement_pairs(qrels: DataFrame, run: DataFrame, k: int, line: str = "line_no") -> DataFrame:
    """The k judged documents per query whose gold and model ranks lie furthest apart.

    A document that the run does not list ranks right after the deepest rank of the run.
    """
    missing = run.agg(F.coalesce(F.max("rank"), F.lit(0)) + 1).scalar()
    model = run.select("qid", "did", F.col("rank").alias("_r"))
    rows = gold_rank(qrels, line).join(model, ["qid", "did"], "left").withColumn(
        "model_rank", F.coalesce("_r", missing)).withColumn(
        "abs_diff", F.abs(F.col("gold_rank") - F.col("model_rank")))
    order = Window.partitionBy("qid").orderBy(F.col("abs_diff").desc(), F.col("gold_rank"))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select(
        "qid", "did", "gold_rank", "model_rank", "abs_diff")


def group_sizes(df: DataFrame, key: str = "qid", line: str = "line_no") -> DataFrame:
    """Run lengths of equal neighbouring keys in line order: (key, first_line, n).

    Inside a run the overall number and the number within the key grow together, so their difference names the run.
    Both numberings work bucket by bucket.
    """
    rows = number_by_line(number_by_line(df.select(key, line), line, name="_all"), line, [key], "_own")
    island = (F.col("_all") - F.col("_own")).alias("_island")
    return rows.groupBy(key, island).agg(F.min(line).alias("first_line"), F.count(F.lit(1)).alias("n")).drop("_island")


EMA_BLOCK = 256
EMA_SPAN = 512


def ema(df: DataFrame, value: str, order: str, alpha: float, keys: list[str], block: Column | None = None) -> DataFrame:
    """Exponential moving average per series; NULL values stay NULL and do not count.

    A step of the average is an affine map, so a series is cut into blocks of neighbouring rows, blocks into spans of
    neighbouring blocks, and every piece is folded on its own into its count and its inner result. Carried averages
    then pass from span to span and from block to block; no task sees more than one piece of rows. ``block`` is an
    integer column that grows with ``order``; by default rows are numbered and cut every ``EMA_BLOCK`` rows.
    """
    cols = [*keys, F.col(order).cast("long").alias("_o"), F.col(value).cast("double").alias("_v")]
    if block is None:
        rows = number_by_line(df.select(*cols), "_o", keys, "_n").withColumn("_b", F.floor(F.col("_n") / EMA_BLOCK))
    else:
        rows = df.select(*cols, block.cast("long").alias("_b"))
    none = F.lit(None).cast("double")

    def step(prev: Column, v: Column) -> Column:
        return F.when(v.isNull(), prev).when(prev.isNull(), v).otherwise(v * alpha + prev * (1 - alpha))

    def through(avg: Column, piece: Column) -> Column:
        """The average after a piece that starts from ``avg`` (NULL: nothing before)."""
        return F.when(piece["n"] == 0, avg).when(avg.isNull(), piece["first"]).otherwise(
            piece["from0"] + avg * F.pow(F.lit(1 - alpha), piece["n"]))

    listed = rows.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_o", "_v"))).alias("_rows"))
    piece = F.struct(
        F.col("_b").alias("b"), F.size(F.filter("_rows", lambda r: r["_v"].isNotNull())).cast("long").alias("n"),
        F.aggregate("_rows", none, lambda a, r: step(a, r["_v"])).alias("first"),
        F.aggregate("_rows", F.lit(0.0), lambda a, r: step(a, r["_v"])).alias("from0"))
    spans = listed.select(*keys, F.floor(F.col("_b") / EMA_SPAN).alias("_s"), piece.alias("p")).groupBy(
        *keys, "_s").agg(F.sort_array(F.collect_list("p")).alias("_pieces"))
    whole = F.struct(
        F.aggregate("_pieces", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n"),
        F.aggregate("_pieces", none, through).alias("first"),
        F.aggregate("_pieces", F.lit(0.0), through).alias("from0"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_whole", whole).withColumn(
        "_carry", F.aggregate(F.collect_list("_whole").over(before), none, through))

    def hand_on(state: Column, p: Column) -> Column:
        entry = F.struct(p["b"].alias("_b"), state["avg"].alias("_carry"))
        return F.struct(through(state["avg"], p).alias("avg"), F.concat(state["out"], F.array(entry)).alias("out"))

    begin = F.struct(F.col("_carry").alias("avg"), F.array().cast("array<struct<_b:bigint,_carry:double>>").alias("out"))
    carries = carried.select(*keys, F.inline(F.aggregate("_pieces", begin, hand_on)["out"]))

    def walk(state: Column, r: Column) -> Column:
        now = step(state["avg"], r["_v"])
        entry = F.struct(r["_o"].alias("o"), F.when(r["_v"].isNotNull(), now).alias("e"))
        return F.struct(now.alias("avg"), F.concat(state["out"], F.array(entry)).alias("out"))

    start = F.struct(F.col("_carry").alias("avg"), F.array().cast("array<struct<o:bigint,e:double>>").alias("out"))
    named = carries.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_b"]], "_carry")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_b"]])
    out = listed.join(named, same).select(*keys, F.inline(F.aggregate("_rows", start, walk)["out"]))
    return out.select(*keys, F.col("o").alias(order), F.col("e").alias("ema"))


def _hashed(df: DataFrame, cols: list[str], seed: str) -> DataFrame:
    return df.withColumn("_h", hash_key(seed, *[F.col(c) for c in cols]))


def freeze_split(
    qrels: DataFrame, train: float = 0.7, dev: float = 0.15, seed: str = "42", id_col: str = "qid"
) -> DataFrame:
    """(qid, split): distinct ids in hash order, cut at floor(share * n); the rest is the test part."""
    ids = qrels.select(id_col).distinct()
    numbered = number_by_hash(_hashed(ids, [id_col], seed), "_h", [id_col])
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = F.floor(n * F.lit(train))
    second = first + F.floor(n * F.lit(dev))
    split = F.when(F.col("rn") <= first, "train").when(F.col("rn") <= second, "dev").otherwise("test")
    return numbered.select(id_col, split.alias("split"))


def two_stage_split(
    df: DataFrame, test: float = 0.2, valid: float = 0.1, seed: str = "42", id_col: str = "qid"
) -> DataFrame:
    """Test share first, then a validation share of what remains; both rounded up."""
    ids = df.select(id_col).distinct()
    numbered = number_by_hash(_hashed(ids, [id_col], seed), "_h", [id_col])
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_test = F.ceil(n * F.lit(test))
    n_valid = F.ceil((n - n_test) * F.lit(valid))
    split = F.when(F.col("rn") <= n_test, "test").when(F.col("rn") <= n_test + n_valid, "valid").otherwise("train")
    return numbered.select(id_col, split.alias("split"))


def sample_per_group(
    df: DataFrame, n: int, key: str = "qid", ids: tuple[str, ...] = ("did",), seed: str = "42", require_full: bool = False
) -> DataFrame:
    """Up to n rows per group in hash order; ``require_full`` fails the job where a group has fewer."""
    order = Window.partitionBy(key).orderBy("_h", *ids)
    out = _hashed(df, [key, *ids], seed).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    if require_full:
        short = out.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).select(key, F.when(
            F.col("_c") < n, F.raise_error(F.concat(F.lit("too few rows for "), F.col(key))).cast("int")).alias("_ok"))
        out = out.join(short, key).where(F.col("_ok").isNull()).drop("_ok")
    return out.drop("_h", "_n")


def shuffle_rows(df: DataFrame, ids: list[str], seed: str = "42") -> DataFrame:
    """Rows with their position in hash order."""
    return number_by_hash(_hashed(df, ids, seed), "_h", ids, name="position").drop("_h")


def merge_and_shuffle(sets: list[DataFrame], ids: list[str], seed: str = "42") -> DataFrame:
    return shuffle_rows(reduce(DataFrame.unionByName, sets), ids, seed)


def mix_domains(
    queries: DataFrame, qrels: DataFrame, in_domain: DataFrame, ratio: float = 1.0, seed: str = "42"
) -> DataFrame:
    """(qid, in_domain): all ids whose base is in the domain and round(ratio * their number) judged others."""
    ids = queries.select("qid").distinct().withColumn("base", F.substring_index("qid", "_", 1))
    bases = in_domain.select(F.col("did").alias("base")).distinct()
    inside = ids.join(bases, "base", "left_semi").select("qid")
    outside = ids.join(bases, "base", "left_anti").select("qid")
    judged = outside.join(qrels.select("qid").distinct(), "qid", "left_semi")
    wanted = inside.agg(F.bround(F.count(F.lit(1)) * F.lit(float(ratio))).cast("long").alias("n")).scalar()
    extra = number_by_hash(_hashed(judged, ["qid"], seed), "_h", ["qid"]).where(F.col("rn") <= wanted)
    return inside.select("qid", F.lit(1).alias("in_domain")).unionByName(extra.select("qid", F.lit(0).alias("in_domain")))


def dedup_queries(queries: DataFrame, line: str = "line_no") -> DataFrame:
    """The first id of every query text; copies are folded map-side."""
    first = queries.groupBy("query").agg(F.min(F.struct(line, "qid")).alias("f"))
    return first.select(F.col("f.qid").alias("qid"), "query", F.col(f"f.{line}").alias(line))


def merge_renumber(sets: list[DataFrame], start: int = 58, line: str = "line_no") -> DataFrame:
    """Union of query sets, one row per text, ids counted from ``start`` in order of first occurrence."""
    tagged = [s.select("query", F.lit(i).alias("_set"), F.col(line).alias("_line")) for i, s in enumerate(sets)]
    first = reduce(DataFrame.unionByName, tagged).groupBy("query").agg(
        F.min(F.struct("_set", "_line")).alias("f")).select("query", "f.*")
    bucket = F.struct(F.col("_set"), F.floor(F.col("_line") / LINE_BUCKET).alias("b"))
    out = number_rows(first, bucket, [F.col("_set"), F.col("_line")])
    return out.select((F.col("rn") + start - 1).cast("string").alias("qid"), "query")


def histogram_overflow(df: DataFrame, value: str, width: int, threshold: int) -> DataFrame:
    """Counts per bin of ``width`` below ``threshold`` and one bin for everything else."""
    bin_ = F.least(F.floor(F.col(value) / width), F.lit(threshold // width)) * width
    return df.groupBy(bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
