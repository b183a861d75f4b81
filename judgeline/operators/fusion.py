"""Score normalization, run fusion, chunk pooling and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgeline.operators.ranks import SCORE_DIGITS, topk_run
from judgeline.operators.sizing import hinter, number_ranges
from judgeline.session import written

RRF_K = 60  # Fixed value: rank offset of reciprocal rank fusion.
RERANK_GAP = 1e-3  # Fixed value: how far the worst reranked document ends above the rest.


def normalize_scores(run: DataFrame, method: str = "z") -> DataFrame:
    """Scores per (run_id, qid): ``z`` (population deviation), ``minmax``, ``rrf`` or ``raw``.

    A zero deviation or range divides by one. Statistics are aggregated map-side and joined back, so no group of
    scores is held in one task.
    """
    keys = ["run_id", "qid"]
    if method == "raw":
        return run
    if method == "rrf":
        if "rank" not in run.columns:
            ranked = run.withColumn("_s", -F.round("score", SCORE_DIGITS))
            run = number_ranges(ranked, [F.col("_s"), F.col("did")], keys, "rank").drop("_s")
        return run.withColumn("score", F.lit(1.0) / (F.lit(RRF_K) + F.col("rank")))
    if method == "z":
        stats = run.groupBy(*keys).agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_w"))
    elif method == "minmax":
        stats = run.groupBy(*keys).agg(
            F.min("score").alias("_m"), (F.max("score") - F.min("score")).alias("_w"))
    else:
        raise ValueError(f"unknown normalization {method!r}")
    width = F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.lit(1.0))
    return run.join(stats, keys).withColumn("score", (F.col("score") - F.col("_m")) / width).drop("_m", "_w")


def fuse_runs(
    runs: DataFrame,
    names: tuple[str, str, str] = ("dense", "sparse", "multi"),
    norm: str = "z",
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    k: int = 100,
    missing: str | None = None,
) -> DataFrame:
    """Seven variants of three runs: each alone, each pair averaged, the weighted triple.

    ``missing='drop'`` keeps a document only where all parts of a variant score it; ``'zero'`` counts an absent score
    as 0 and lists every candidate in every variant. Default: ``zero`` for ``rrf``, ``drop`` otherwise.
    """
    missing = missing or ("zero" if norm == "rrf" else "drop")
    parts = normalize_scores(runs.where(F.col("run_id").isin(*names)), norm)
    scores = parts.groupBy("qid", "did").agg(
        *[F.max(F.when(F.col("run_id") == n, F.col("score"))).alias(f"s{i}") for i, n in enumerate(names)])
    if missing == "zero":
        scores = scores.fillna(0.0, ["s0", "s1", "s2"])
    s0, s1, s2 = F.col("s0"), F.col("s1"), F.col("s2")
    wa, wb, wc = weights
    a, b, c = names
    variants: dict[str, Column] = {
        a: s0, b: s1, c: s2,
        f"{a}_{b}": (s0 + s1) * 0.5, f"{a}_{c}": (s0 + s2) * 0.5, f"{b}_{c}": (s1 + s2) * 0.5,
        "all_three": (s0 * wa + s1 * wb + s2 * wc) / (wa + wb + wc),
    }
    listed = F.array(*[F.struct(F.lit(n).alias("run_id"), v.alias("score")) for n, v in variants.items()])
    long = scores.select("qid", "did", F.inline(listed)).where(F.col("score").isNotNull())
    return topk_run(long, k, keys=["run_id", "qid"])


def merge_reranked(run: DataFrame, reranked: DataFrame) -> DataFrame:
    """Reranked documents get their new score, lifted just above every other document of the query."""
    top = run.groupBy("qid").agg(F.max("score").alias("_max"))
    low = reranked.groupBy("qid").agg(F.min("score").alias("_min"))
    lift = top.join(low, "qid").select("qid", (F.col("_max") - F.col("_min") + RERANK_GAP).alias("_lift"))
    new = reranked.select("qid", "did", F.col("score").alias("_new")).join(lift, "qid").select(
        "qid", "did", (F.col("_new") + F.col("_lift")).alias("_new"))
    return run.join(new, ["qid", "did"], "left").withColumn("score", F.coalesce("_new", "score")).drop("_new")


def pool_chunks(scores: DataFrame, how: str = "max", keys: tuple[str, ...] = ("qid", "did")) -> DataFrame:
    """Chunk scores to document scores: ``max``, ``mean`` or ``topN`` (mean of the N best, fewer if there are fewer).

    Documents without chunks have no row.
    """
    if how == "max":
        return scores.groupBy(*keys).agg(F.max("score").alias("score"))
    if how == "mean":
        return scores.groupBy(*keys).agg(F.avg("score").alias("score"))
    if how.startswith("top"):
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("cid"))
        best = scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= int(how[3:]))
        return best.groupBy(*keys).agg(F.avg("score").alias("score"))
    raise ValueError(f"unknown pooling {how!r}")


Scorer = Callable[[Column, Column], Column]


def rerank_topk(
    run: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    scorer: Scorer,
    k: int = 50,
    chunker: Callable[[Column], Column] | None = None,
    pooling: str = "max",
) -> DataFrame:
    """Score the k best documents of every query with ``scorer(query, text)`` and merge them on top of the run.

    ``scorer`` is a column expression or a pandas UDF. With ``chunker`` every chunk is scored and the chunk scores
    are pooled. The candidates are written first, so that their count can decide how they meet the texts.
    """
    head = written(topk_run(run, k).select("qid", "did"), "rerank-head")
    asked = head.join(queries.select("qid", "query"), "qid")
    pairs = corpus.select("did", "text").join(hinter(asked)(asked), "did")
    if chunker is None:
        scored = pairs.select("qid", "did", scorer(F.col("query"), F.col("text")).alias("score"))
    else:
        chunks = pairs.select("qid", "did", "query", F.posexplode(chunker(F.col("text"))).alias("cid", "text"))
        scored = pool_chunks(
            chunks.select("qid", "did", "cid", scorer(F.col("query"), F.col("text")).alias("score")), pooling)
    return merge_reranked(run, scored)
