"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from judgeline.plans import fixtures as fx
from judgeline.plans.catalog import QUERIES
from judgeline.session import local_session

HEADLINES = [
    "normalize_text",
    "chunk_sliding",
    "corpus_stats",
    "bm25_run",
    "bm25_run_preset",
    "token_recall_run",
    "sparse_run",
    "knn_topk",
    "maxsim_run",
    "exact_match_run",
    "pool_chunks_max",
    "fuse_runs_z",
    "classic_metrics",
    "completeness_summary",
    "classification_metrics_per_query",
    "query_features",
    "mean_jaccard_all_pairs",
    "pool_three_runs",
    "mine_negatives",
    "render_pair_requests",
    "exclude_terms_join",
    "mine_negatives_chunked",
    "incremental_topk",
    "gold_rank",
    "train_pair_classifier",
    "read_corpus_csv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, "bench")
    timings: dict[str, float] = {}

    def timed(name, job):
        start = time.time()
        job()
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)

    timed("warmup", lambda: fx.corpus(spark, sf_dir).selectExpr("max(length(text))").collect())
    if not sys.argv[1:]:
        timed("derive_runs_and_judgments", lambda: (fx.runs(spark, sf_dir), fx.gold(spark, sf_dir)))
    for name in names:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(sum(v for k, v in timings.items() if k != "warmup"), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
