"""Retrievers by name, and the pipeline from texts to metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgeline.functions.plugins import chunk_corpus
from judgeline.operators import metrics as M
from judgeline.operators import retrieve as R
from judgeline.operators.fusion import Scorer, fuse_runs, pool_chunks, rerank_topk

Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


def _chunked(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    chunks = chunk_corpus(corpus, "sliding", 256).withColumn("doc", F.substring_index("cid", "__chunk", 1))
    scores = R.bm25_run(chunks, queries, id_col="cid", parent="doc")
    pooled = pool_chunks(scores.select("qid", F.col("did").alias("cid"), F.col("doc").alias("did"), "score"), "max")
    return R.topk_run(pooled, k)


def dense(embed: Callable[[Column], Column], sim: str = "cosine", chunk: int | None = None) -> Retriever:
    """A retriever around an embedder of one's own (a column function, such as ``plugins.embedder`` makes).

    With ``chunk``, windows of so many words are embedded and a document scores as its best window.
    """
    def run(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        q = queries.select("qid", embed(F.col("query")).alias("vec"))
        if chunk is None:
            return R.dense_run(q, corpus.select("did", embed(F.col("text")).alias("vec")), k, sim=sim)
        chunks = chunk_corpus(corpus, "sliding", chunk)
        return R.dense_run(q, chunks.select(
            F.substring_index("cid", "__chunk", 1).alias("did"), embed(F.col("text")).alias("vec")), k, sim=sim)

    return run


def sparse(weigh: Callable[[Column], Column]) -> Retriever:
    """A retriever on token weights: ``weigh`` turns a text into a map of tokens to weights."""
    return lambda c, q, k: R.sparse_run(
        q.select("qid", weigh(F.col("query")).alias("weights")), c.select("did", weigh(F.col("text")).alias("weights")), k)


def fused(names: tuple[str, str, str], norm: str = "rrf", variant: str = "all_three", depth: int = 100) -> Retriever:
    """A retriever that fuses three named ones, each cut at ``depth`` documents."""
    def run(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        runs = [RETRIEVERS[n](corpus, queries, depth).select(F.lit(n).alias("run_id"), "qid", "did", "rank", "score") for n in names]
        out = fuse_runs(reduce(DataFrame.unionByName, runs), names, norm, k=k)
        return out.where(F.col("run_id") == variant).select("qid", "did", "score", "rank")

    return run


#: name -> (corpus, queries, k) -> run.
RETRIEVERS: dict[str, Retriever] = {
    "bm25": lambda c, q, k: R.bm25_run(c, q, k=k),
    "bm25_preset": lambda c, q, k: R.bm25_run(c, q, k1=0.9, b=0.4, k=k),
    "bm25_chunked": _chunked,
    "token_recall": lambda c, q, k: R.token_recall_run(c, q, k=k),
    "exact": lambda c, q, k: R.topk_run(R.exact_match_run(c, q), k),
}


def register(name: str, retriever: Retriever) -> None:
    """Add a retriever of one's own, for example one made by ``dense``, ``sparse`` or ``fused``."""
    RETRIEVERS[name] = retriever


def evaluate_retriever(
    name: str,
    corpus: DataFrame,
    queries: DataFrame,
    qrels: DataFrame,
    k: int = 100,
    metric_set: str = "classic",
    scorer: Scorer | None = None,
    rerank: int = 50,
) -> DataFrame:
    """Retrieve, rerank if a scorer is given, and score: one row of metrics per query."""
    run = RETRIEVERS[name](corpus, queries, k)
    if scorer is not None:
        merged = rerank_topk(run.select("qid", "did", "score"), queries, corpus, scorer, rerank)
        run = R.topk_run(merged, k)
    return M.evaluate(run.withColumn("run_id", F.lit(name)), qrels, metric_set)
