"""Writers for runs, judgments, training groups and evaluation bundles; every file is written in parallel parts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgeline.operators.metrics import with_run_id
from judgeline.operators.retrieve import topk_run

RUN_LINES = 30  # Fixed value: documents per query in exported runs.


def _tab(*cols: Column) -> Column:
    """One line; tabs and line breaks inside a field become spaces."""
    fields = [F.regexp_replace(c.cast("string"), r"[\t\r\n]", " ") for c in cols]
    return F.concat_ws("\t", *fields).alias("value")


def _head(run: DataFrame, k: int) -> DataFrame:
    run = with_run_id(run)
    return run.where(F.col("rank") <= k) if "rank" in run.columns else topk_run(run, k)


def write_trec_run(run: DataFrame, path: str, k: int = RUN_LINES, mode: str = "error") -> None:
    """Six-column lines, one folder per ``run_id``; a task keeps the order of its rows."""
    rows = _head(run, k)
    line = _tab(F.col("qid"), F.lit("Q0"), F.col("did"), F.col("rank"), F.format_string("%.4f", "score"), F.col("run_id"))
    out = rows.repartition("run_id", "qid").sortWithinPartitions("run_id", "qid", "rank")
    out.select("run_id", line).write.mode(mode).partitionBy("run_id").text(path)


def write_ranked_list(run: DataFrame, path: str, k: int = RUN_LINES, mode: str = "error") -> None:
    """Three-column lines: qid, did, rank."""
    rows = _head(run, k).repartition("qid").sortWithinPartitions("qid", "rank")
    rows.select(_tab(F.col("qid"), F.col("did"), F.col("rank"))).write.mode(mode).text(path)


def run_wide(run: DataFrame, k: int = RUN_LINES, qids: list[str] | None = None) -> DataFrame:
    """Rows 1..k, one column per query of the run (or per one of ``qids``), NULL where a list is shorter.

    Spark refuses more columns than ``spark.sql.pivotMaxValues``; ``run_wide_blocks`` is for runs with more queries.
    """
    spine = run.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("rank"))
    rows = run.where(F.col("rank") <= k).groupBy("rank")
    wide = (rows.pivot("qid", qids) if qids else rows.pivot("qid")).agg(F.first("did"))
    return spine.join(wide, "rank", "left")


def run_wide_blocks(run: DataFrame, k: int = RUN_LINES, width: int = 1000) -> Iterator[DataFrame]:
    """``run_wide`` in blocks of ``width`` queries in the order of their ids, so that no query is left out."""
    rows = run.where(F.col("rank") <= k)
    low = None
    while True:
        rest = rows.select("qid") if low is None else rows.select("qid").where(F.col("qid") > low)
        qids = [r.qid for r in rest.where(F.col("qid").isNotNull()).distinct().orderBy("qid").limit(width).collect()]
        if not qids:
            return
        yield run_wide(rows.where(F.col("qid").between(qids[0], qids[-1])), k, qids)
        low = qids[-1]


def write_qrels(qrels: DataFrame, path: str, layout: int = 4, mode: str = "error") -> None:
    """Tab-separated judgments in 3, 4 or 5 columns, without a header."""
    it = F.col("iter") if "iter" in qrels.columns else F.lit("0")
    cols = {
        3: ["qid", "did", "label"], 4: ["qid", it, "did", "label"], 5: ["qid", it, "did", "label", "evidence"]}[layout]
    fields = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    qrels.select(_tab(*fields)).write.mode(mode).text(path)


def write_queries(queries: DataFrame, path: str, mode: str = "error") -> None:
    queries.select(_tab(F.col("qid"), F.col("query"))).write.mode(mode).text(path)


def write_train_groups_jsonl(groups: DataFrame, path: str, query_prefix: str = "", mode: str = "error") -> None:
    """One JSON object per group; ``query_prefix`` serves rerankers that expect one."""
    rows = groups.withColumn("query", F.concat(F.lit(query_prefix), F.col("query"))) if query_prefix else groups
    rows.write.mode(mode).json(path)


def bundle_id(qid: Column) -> Column:
    return F.replace(qid, F.lit("_Q"), F.lit("0000"))


def eval_bundle(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, grades: list[int]) -> dict[str, DataFrame]:
    """The three tables of an evaluation set: corpus, judged queries, judgments of the wanted grades set to 1."""
    judged = queries.join(qrels.select("qid").distinct(), "qid", "left_semi")
    return {
        "corpus": corpus.select(F.col("did").alias("id"), F.lit("").alias("title"), "text"),
        "queries": judged.select(bundle_id(F.col("qid")).alias("id"), F.col("query").alias("text")),
        "qrels": qrels.where(F.col("label").isin(grades)).select(
            bundle_id(F.col("qid")).alias("qid"), F.col("did").alias("docid"), F.lit(1).alias("relevance")),
    }


def write_eval_bundle(corpus, queries, qrels, grades: list[int], path: str, mode: str = "error") -> None:
    for name, table in eval_bundle(corpus, queries, qrels, grades).items():
        table.write.mode(mode).json(f"{path}/{name}")


def annotation_bundle(corpus: DataFrame, queries: DataFrame, run: DataFrame, k: int = 40) -> dict[str, DataFrame]:
    """Collection, topics and pooled documents per topic, one JSON object per row."""
    topic = F.concat_ws(":", "qid", "query")
    docs = _head(run, k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "did"))).alias("d"))
    listed = F.transform("d", lambda x: F.struct(x["did"].alias("document_id")))
    return {
        "collection": corpus.select(F.to_json(F.struct(F.col("did").alias("document_id"), "text")).alias("value")),
        "topics": queries.select(F.to_json(F.struct(
            topic.alias("topic_id"), F.col("query").alias("title"), F.lit("").alias("description"),
            F.lit("").alias("narrative"))).alias("value")),
        "run": docs.join(queries, "qid").select(F.to_json(F.struct(
            topic.alias("topic_id"), listed.alias("documents"))).alias("value")),
    }


def write_annotation_bundle(corpus, queries, run, path: str, k: int = 40, mode: str = "error") -> None:
    for name, table in annotation_bundle(corpus, queries, run, k).items():
        table.write.mode(mode).text(f"{path}/{name}")


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines data set."""
    df.write.mode("append").json(path)


def metric_table(per_query: DataFrame, run_ids: list[str] | None = None) -> DataFrame:
    """One row per query, one column ``metric[run]`` per metric and run."""
    metrics = [c for c in per_query.columns if c not in ("run_id", "qid")]
    if run_ids is None:
        run_ids = [r["run_id"] for r in per_query.select("run_id").distinct().orderBy("run_id").collect()]
    cols = [F.max(F.when(F.col("run_id") == r, F.col(m))).alias(f"{m}[{r}]") for m in metrics for r in run_ids]
    return per_query.groupBy("qid").agg(*cols)


def write_metric_table(per_query: DataFrame, path: str, run_ids: list[str] | None = None, mode: str = "error") -> None:
    metric_table(per_query, run_ids).orderBy("qid").write.mode(mode).csv(path, sep="\t", header=True)
