"""Joins that turn ids into texts and put runs next to judgments.

Texts are the large side: a corpus is first cut to the documents that are asked for, where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgeline.operators.sizing import hinter, pick
from judgeline.session import written


def _needed(value: Column, what: str, key: str) -> Column:
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"unknown {what} "), F.col(key))).cast("string"))


def enrich_pairs(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``query`` and ``text``; unknown ids fail the job, or become empty when not ``strict``."""
    q = queries.select("qid", F.col("query").alias("_q"))
    d = pick(corpus.select("did", F.col("text").alias("_t")), pairs)
    rows = pairs.join(q, "qid", "left").join(d, "did", "left")
    if strict:
        query, text = _needed(F.col("_q"), "query", "qid"), _needed(F.col("_t"), "document", "did")
    else:
        query, text = F.coalesce("_q", F.lit("")), F.coalesce("_t", F.lit(""))
    return rows.select(*pairs.columns, query.alias("query"), text.alias("text"))


def enrich_triplets(triplets: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, pos_doc_id, neg_doc_id) to texts, with a flag on identical texts."""
    ids = triplets.select(F.explode(F.array("pos_doc_id", "neg_doc_id")).alias("did"))
    texts = pick(corpus.select("did", "text"), ids)
    pos = texts.select(F.col("did").alias("pos_doc_id"), F.col("text").alias("pos_text"))
    neg = texts.select(F.col("did").alias("neg_doc_id"), F.col("text").alias("neg_text"))
    q = queries.select(F.col("qid").alias("query_id"), "query")
    return (
        triplets.join(q, "query_id").join(pos, "pos_doc_id").join(neg, "neg_doc_id")
        .withColumn("same_text", (F.col("pos_text") == F.col("neg_text")).cast("int"))
    )


def attach_negative_texts(groups: DataFrame, corpus: DataFrame, keep: int = 5) -> DataFrame:
    """(qid, negatives ARRAY<id>) to (qid, negatives ARRAY<text>): known ids in order, the first ``keep``.

    Which ids are known and come first is settled on ids alone; only the texts that stay are joined.
    """
    items = groups.select("qid", F.posexplode("negatives").alias("pos", "did"))
    known = items.join(corpus.select("did"), "did", "left_semi")
    number = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    kept = written(known.withColumn("_n", number).where(F.col("_n") <= keep).drop("_n"), "negatives")
    found = pick(corpus.select("did", "text"), kept).join(kept, "did")
    texts = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    first = F.transform("t", lambda x: x["text"])
    return groups.select("qid").join(texts, "qid", "left").select(
        "qid", F.coalesce(first, F.array().cast("array<string>")).alias("negatives"))


def join_run_qrels(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run rows of judged queries with ``label`` (0 when unjudged) and ``judged``."""
    known = run.join(qrels.select("qid").distinct(), "qid", "left_semi")
    labels = qrels.select("qid", "did", F.col("label").alias("_l"))
    return known.join(labels, ["qid", "did"], "left").withColumns({
        "label": F.coalesce("_l", F.lit(0)), "judged": F.col("_l").isNotNull().cast("int")}).drop("_l")
