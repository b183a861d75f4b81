"""Filters and evidence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgeline.functions.text import tokenize_ws
from judgeline.operators.sizing import hinter


def filter_qids(df: DataFrame, qids: DataFrame) -> DataFrame:
    """Rows whose query is listed."""
    return df.join(qids.select("qid"), "qid", "left_semi")


def filter_qrels_pairs(qrels: DataFrame, pairs: DataFrame) -> DataFrame:
    return qrels.join(pairs.select("qid", "did"), ["qid", "did"], "left_semi")


def filter_known_docs(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    return qrels.join(corpus.select("did"), "did", "left_semi")


def qrels_with_relevant(qrels: DataFrame, rel: int = 1) -> DataFrame:
    """All judgments of the queries that have a relevant one."""
    return filter_qids(qrels, qrels.where(F.col("label") >= rel).select("qid").distinct())


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return filter_qids(queries, qrels.select("qid").distinct())


def filter_suffix(df: DataFrame, suffix: str, col: str = "qid") -> DataFrame:
    return df.where(F.endswith(col, F.lit(suffix)))


# The three kinds of generated queries.
QUERY_KINDS = ["corta", "compleja", "pregunta"]


def split_by_suffix(df: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Adds ``kind`` from the id suffix, NULL for unknown forms; write with ``partitionBy('kind')``."""
    kinds = QUERY_KINDS if kinds is None else kinds
    kind = F.coalesce(*[F.when(F.endswith("qid", F.lit("_" + k)), F.lit(k)) for k in kinds])
    return df.withColumn("kind", kind)


def filter_annotator(df: DataFrame, username: str) -> DataFrame:
    return df.where(F.lower("username") == username.lower())


def keyword_count_by_attr(corpus: DataFrame, word: str, attr: str) -> DataFrame:
    """Documents that contain a word, whatever the case, per attribute value."""
    hits = corpus.where(F.contains(F.lower("text"), F.lit(word.lower())))
    return hits.groupBy(attr).agg(F.count(F.lit(1)).alias("n_docs"))


def lookup_doc(corpus: DataFrame, did: str) -> DataFrame:
    """One row: the text of a document, NULL if there is none."""
    return corpus.where(F.col("did") == did).agg(F.lit(did).alias("did"), F.max("text").alias("text"))


def _stripped(words: Column) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))


def _check(qrels: DataFrame, corpus: DataFrame, found: Column, reason: Column) -> DataFrame:
    """Positive judgments that fail the check become 0 and name the reason."""
    rows = corpus.select("did", F.lower("text").alias("_text")).join(hinter(qrels)(qrels), "did")
    kept = (F.col("label") == 0) | found
    return rows.select(
        "qid", "did", F.when(kept, F.col("label")).otherwise(F.lit(0)).alias("label"),
        F.when(kept, F.col("evidence")).otherwise(reason).alias("evidence"))


def evidence_lexical_qc(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Keep a positive only if every evidence word, stripped of punctuation, occurs in the document.

    A word of punctuation only counts as not found; empty evidence has ratio 0.
    """
    words = _stripped(tokenize_ws("evidence"))
    hits = F.size(F.filter(words, lambda w: (w != "") & F.contains(F.col("_text"), w)))
    ratio = F.coalesce(F.try_divide(hits.cast("double"), F.size(words)), F.lit(0.0))
    reason = F.concat(F.lit("Set to 0 due to low lexical match: "), ratio.cast("string"))
    return _check(qrels, corpus, ratio >= 1.0, reason)


def evidence_exact_qc(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Keep a positive only if the cleaned evidence occurs in the document as it stands."""
    phrase = F.array_join(_stripped(tokenize_ws("evidence")), " ")
    return _check(qrels, corpus, F.contains(F.col("_text"), phrase), F.lit("Set to 0 due to no exact match"))


def remap_labels(qrels: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Labels through a mapping; a label without an entry fails the job."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    missing = F.raise_error(F.concat(F.lit("no mapping for label "), F.col("label").cast("string"))).cast("int")
    return qrels.withColumn("label", F.coalesce(F.try_element_at(table, F.col("label")), missing))


def binarize_adaptive(qrels: DataFrame, threshold: int = 2) -> DataFrame:
    """Binary labels: graded sets are cut at ``threshold``, sets that are binary already stay."""
    graded = qrels.agg((F.max("label") > 1).alias("g")).scalar()
    return qrels.withColumn("label", F.when(graded, (F.col("label") >= threshold).cast("int")).otherwise(F.col("label")))
