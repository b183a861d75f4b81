"""Corpus, queries, runs and judgments derived from the given tables by whole-table Spark jobs.

Runs and judgments are files in practice, so the derived ones are written once per application to the shared folder
and read back by every query that starts from them.

- ``corpus``/``queries``: all documents / all benchmark texts.
- ``run_a``, ``run_b``: BM25 with two settings; ``run_c``: share of the query's tokens. Depth 40 each.
- ``gold``: the pool of the 25 best of ``run_b`` and ``run_c``, graded 0-3 by the share of query tokens in the document.
- ``pred``: the 30 best of ``run_a``, graded by rank; its pairs overlap those of ``gold`` only in part.
- ``raters``: three graders of the ``gold`` pairs, by token share, by Jaccard similarity and by rank in ``run_b``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgeline.functions.text import tokenize_ws
from judgeline.operators import retrieve as R
from judgeline.operators import termsums
from judgeline.operators.sizing import pick
from judgeline.session import scratch_path, written

RUN_DEPTH = 40
POOL_DEPTH = 25
PRED_DEPTH = 30

_stored: dict[tuple[str, str, str], str] = {}
_lists: dict[tuple[str, str], termsums.TermLists | None] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("did"), "text", "source", "lang")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def _named(run: DataFrame, run_id: str) -> DataFrame:
    return run.select(F.lit(run_id).alias("run_id"), "qid", "did", "rank", "score")


def term_lists(spark, sf_dir):
    """What the three runs share: every document's terms that some query asks for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lists:
        _lists[key] = R.term_lists(corpus(spark, sf_dir), queries(spark, sf_dir))
    return _lists[key]


def run_a(spark, sf_dir):
    return stored(spark, sf_dir, "run_a", lambda: _named(R.bm25_run(
        corpus(spark, sf_dir), queries(spark, sf_dir), k=RUN_DEPTH, lists=term_lists(spark, sf_dir)), "a"))


def run_b(spark, sf_dir):
    return stored(spark, sf_dir, "run_b", lambda: _named(R.bm25_run(
        corpus(spark, sf_dir), queries(spark, sf_dir), k1=0.9, b=0.4, k=RUN_DEPTH, lists=term_lists(spark, sf_dir)), "b"))


def run_c(spark, sf_dir):
    return stored(spark, sf_dir, "run_c", lambda: _named(R.token_recall_run(
        corpus(spark, sf_dir), queries(spark, sf_dir), k=RUN_DEPTH, lists=term_lists(spark, sf_dir)), "c"))


def runs(spark, sf_dir):
    return run_a(spark, sf_dir).unionByName(run_b(spark, sf_dir)).unionByName(run_c(spark, sf_dir))


def _gold(spark, sf_dir):
    """The pool with the sizes of both token sets (n, m) and of what they share (h)."""
    top = lambda run: run.where(F.col("rank") <= POOL_DEPTH).select("qid", "did")
    pool = written(top(run_b(spark, sf_dir)).union(top(run_c(spark, sf_dir))).distinct(), "pool")
    q = queries(spark, sf_dir).select("qid", F.array_distinct(tokenize_ws("query")).alias("qs"))
    wanted = pick(corpus(spark, sf_dir).select("did", "text"), pool)  # only texts of the pool are tokenized
    d = wanted.select("did", F.array_distinct(tokenize_ws("text")).alias("ds"))
    sized = d.join(pool.join(q, "qid"), "did").select(
        "qid", "did", F.size(F.array_intersect("qs", "ds")).alias("h"), F.size("qs").alias("n"), F.size("ds").alias("m"))
    h, n = F.col("h"), F.col("n")
    grade = F.when(h * 20 >= n * 11, 3).when(h * 20 >= n * 9, 2).when(h * 20 >= n * 7, 1).otherwise(0)
    return sized.select("qid", "did", grade.alias("label"), "h", "n", "m")


def gold_counts(spark, sf_dir):
    return stored(spark, sf_dir, "gold", lambda: _gold(spark, sf_dir))


def gold(spark, sf_dir):
    return gold_counts(spark, sf_dir).select("qid", "did", "label")


def pred(spark, sf_dir):
    r = F.col("rank")
    grade = F.when(r <= 2, 3).when(r <= 8, 2).when(r <= 18, 1).otherwise(0)
    return run_a(spark, sf_dir).where(r <= PRED_DEPTH).select("qid", "did", grade.alias("label"))


def raters(spark, sf_dir):
    """(qid, did, r1, r2, r3), all binary."""
    rank_b = run_b(spark, sf_dir).select("qid", "did", "rank")
    j = F.col("h") * 40 >= F.col("n") + F.col("m") - F.col("h")
    return gold_counts(spark, sf_dir).join(rank_b, ["qid", "did"], "left").select(
        "qid", "did", (F.col("label") >= 2).cast("int").alias("r1"), j.cast("int").alias("r2"),
        (F.coalesce("rank", F.lit(999)) <= 12).cast("int").alias("r3"))


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), "label")


def query_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("qid"), "vec", "label")


def doc_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("did"), "vec", "label")


def run_dense(spark, sf_dir):
    """Every vector against all others, cosine, 20 nearest."""
    return stored(spark, sf_dir, "run_dense", lambda: _named(R.knn_topk(
        query_vectors(spark, sf_dir), doc_vectors(spark, sf_dir), k=20, sim="cosine", skip_self=True), "dense"))
