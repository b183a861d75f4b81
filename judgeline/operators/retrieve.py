"""Run-producing operators: (corpus, queries) -> run rows.

Plans in short. Token rows of documents are cut to the query vocabulary before anything is shuffled, then hashed once
by document; term counts and the per-pair score sums both use that partitioning. Top-k is a ``row_number`` filter, for
which Spark keeps only k rows per query in every task before it shuffles. BM25 and token-recall runs of a given depth do
not write pairs as rows at all, see ``termsums``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgeline.functions.scoring import dot, maxsim, norm
from judgeline.functions.text import tokenize_ws
from judgeline.operators import termsums
from judgeline.operators.ranks import topk_run
from judgeline.operators.sizing import fits, hinter
from judgeline.operators.termscan import count_free, free_documents
from judgeline.operators.vectors import dense_run, knn_topk, maxsim_search  # noqa: F401
from judgeline.session import written

def query_terms(queries: DataFrame, lower: bool = True) -> DataFrame:
    """(qid, term, qtf)."""
    words = queries.select("qid", F.explode(tokenize_ws("query", lower)).alias("term"))
    return words.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def corpus_stats(corpus: DataFrame, tokens: Column) -> DataFrame:
    """(term, cf, df): occurrences in the collection and documents that hold the term."""
    per_doc = corpus.select("did", F.explode_outer(tokens).alias("term")).where(F.col("term").isNotNull()).groupBy(
        "did", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def collection_totals(corpus: DataFrame, tokens: Column) -> DataFrame:
    """One row: documents (empty ones included) and tokens."""
    return corpus.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(tokens)).alias("n_tokens"))


def idf_column(df: Column, n_docs: Column, form: str) -> Column:
    odds = (n_docs - df + 0.5) / (df + 0.5)
    return F.ln(odds + 1.0) if _idf_form(form) == "plus1" else F.ln(odds)


def _idf_form(form: str) -> str:
    if form not in ("plus1", "rsj"):
        raise ValueError(f"unknown idf {form!r}")
    return form


#: A term that no token can be: every document has it once, also a document without tokens.
PRESENT = ""


def document_terms(docs: DataFrame, vocabulary: DataFrame, parent: str | None = None) -> DataFrame:
    """(did, dl, term, tf) for the terms of ``vocabulary``; partitioned by did, or by ``parent`` (kept as a column).

    ``docs`` holds (did, toks). The semi-join runs on the exploded tokens before the shuffle, so only tokens that
    some query asks for travel. With ``PRESENT`` in the vocabulary every document is a row at least once, so that
    collection totals need no pass over the texts of their own.
    """
    more = [parent] if parent else []
    marked = F.concat("toks", F.array(F.lit(PRESENT)))
    hits = docs.select("did", *more, F.size("toks").alias("dl"), F.explode_outer(marked).alias("term")).join(
        vocabulary, "term", "left_semi")
    return hits.repartition(parent or "did").groupBy(*more, "did", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_run(
    corpus: DataFrame,
    queries: DataFrame,
    k1: float = 1.5,
    b: float = 0.75,
    idf: str = "plus1",
    lower: bool = True,
    k: int | None = None,
    id_col: str = "did",
    parent: str | None = None,
    lists: termsums.TermLists | None = None,
) -> DataFrame:
    """BM25 scores of every (query, document) pair that shares a term; repeated query terms count repeatedly.

    Texts are tokenized once, for term frequencies, document frequencies and the collection's totals, which share one
    shuffle. ``parent`` names a column of chunks: scores keep it and stay partitioned by it, so that pooling chunks
    needs no shuffle of its own. The weights table has one row per (query, term), so one count of the query side decides
    whether it may be broadcast; otherwise Spark shuffles by term and AQE splits hot terms. With ``k``, pairs are summed
    inside tasks, which keep k documents per query; without it, or with ``parent``, every pair is a row. ``lists`` are the
    ``term_lists`` of the same corpus and queries, if there are any; texts are then not read again.
    """
    more = [parent] if parent else []
    docs = corpus.select(F.col(id_col).alias("did"), *more, tokenize_ws("text", lower).alias("toks"))
    terms = query_terms(queries, lower)
    if k is not None and parent is None and termsums.bounded(queries, terms, k):
        return _bm25_best(docs, terms, k1, b, idf, k, lists)
    small = hinter(terms)
    present = queries.sparkSession.range(1).select(F.lit(PRESENT).alias("term"))
    held = document_terms(docs, small(terms.select("term").distinct().unionByName(present)), parent)
    each = F.col("term") == PRESENT
    totals = held.agg(F.struct(F.count_if(each).alias("n"), F.avg(F.when(each, F.col("dl"))).alias("avgdl")).alias("t"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = terms.join(df, "term").select(
        "term", "qid", (F.col("qtf") * idf_column(F.col("df"), totals.scalar()["n"], idf)).alias("w"))
    tf = F.col("tf")
    length = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / totals.scalar()["avgdl"])
    saturation = tf * F.lit(k1 + 1.0) / (tf + length)
    scored = (
        held.withColumn("s", saturation).select("did", *more, "term", "s")
        .join(small(weights), "term")
        .groupBy("qid", *more, "did").agg(F.sum(F.col("w") * F.col("s")).alias("score"))
    )
    return scored if k is None else topk_run(scored, k)


def _numbered(terms: DataFrame) -> tuple[pa.Table, pa.Array]:
    """The bounded table of query terms with ``tid``, the term's place in the vocabulary, and that vocabulary."""
    rows = terms.toArrow()
    vocabulary = pc.unique(rows.column("term").combine_chunks())
    return rows.append_column("tid", pc.index_in(rows.column("term"), value_set=vocabulary)), vocabulary


def term_lists(corpus: DataFrame, queries: DataFrame, lower: bool = True) -> termsums.TermLists | None:
    """The corpus' share of the query terms, for several runs of the same queries; None when tasks cannot hold these terms."""
    terms = query_terms(queries, lower)
    if not fits(terms):
        return None
    return termsums.term_lists(corpus.select("did", tokenize_ws("text", lower).alias("toks")), _numbered(terms)[1])


def _at(held: termsums.TermLists, rows: pa.Table) -> np.ndarray:
    """The places of the query terms in the vocabulary of the lists."""
    return pc.index_in(rows.column("term"), value_set=held.vocabulary).to_numpy()


def _bm25_best(
    docs: DataFrame, terms: DataFrame, k1: float, b: float, idf: str, k: int, held: termsums.TermLists | None = None,
) -> DataFrame:
    rows, vocabulary = _numbered(terms)
    held = held or termsums.term_lists(docs, vocabulary)
    counts = termsums.counts(held)
    n, length_sum = counts.get(termsums.PRESENT, (0, 0))
    avgdl = length_sum / n if n else 0.0
    tid = _at(held, rows)
    df = np.array([counts.get(t, (0, 0))[0] for t in range(len(held.vocabulary))], np.int64)[tid]
    odds = (n - df + 0.5) / (df + 0.5)
    w = rows.column("qtf").to_numpy() * np.log(odds + 1.0 if _idf_form(idf) == "plus1" else odds)
    weights = pa.table({"qid": rows.column("qid"), "tid": tid, "w": w}).filter(pa.array(df > 0))
    kind = terms.schema["qid"].dataType.simpleString()

    def saturation(tf, dl):
        return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))

    scored = termsums.best_of_lists(held, weights, k, saturation, kind)
    if held.rows is not None:
        tf = F.col("tf")
        length = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl))
        scored = scored.unionByName(termsums.best_sums(
            termsums.merged(held.rows).select("did", "tid", (tf * F.lit(k1 + 1.0) / (tf + length)).alias("s")), weights, k, kind))
    return topk_run(scored, k)


def write_postings(
    corpus: DataFrame, path: str, lower: bool = True, mode: str = "error", buckets: int = 64, slices: int = 4
) -> None:
    """Term statistics of a corpus as tables, for corpora that are searched more than once.

    ``postings`` (bucket, term, did, dl, tf) lies in term buckets, so that a search reads the buckets of its own terms
    only; within a bucket rows are sliced by document, so that a frequent term fills several files, and sorted by
    term, so that Parquet statistics skip the other terms. ``terms`` holds (term, df, cf), ``totals`` one row.
    Raise ``buckets`` and ``slices`` with the corpus: together they are the number of files.
    """
    docs = corpus.select("did", tokenize_ws("text", lower).alias("toks"))
    tokens = docs.select("did", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term")).where(
        F.col("term").isNotNull())
    tf = tokens.groupBy("did", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    placed = tf.withColumns({
        "bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"),
        "_slice": F.pmod(F.xxhash64("did"), F.lit(slices))})
    spark = corpus.sparkSession
    placed.repartition("bucket", "_slice").sortWithinPartitions("bucket", "term").drop("_slice").write.mode(mode).partitionBy(
        "bucket").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).write.mode(mode).parquet(f"{path}/terms")
    docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("toks")).alias("avgdl"), F.lit(buckets).alias("buckets")).write.mode(
        mode).parquet(f"{path}/totals")


def bm25_from_postings(
    spark, path: str, queries: DataFrame, k1: float = 1.5, b: float = 0.75, idf: str = "plus1", lower: bool = True,
    k: int | None = None,
) -> DataFrame:
    """``bm25_run`` over the tables of ``write_postings``; texts are not read."""
    terms = query_terms(queries, lower)
    small = hinter(terms)
    totals = spark.read.parquet(f"{path}/totals").select(F.struct("n", "avgdl", "buckets").alias("t"))
    df = spark.read.parquet(f"{path}/terms").select("term", "df")
    weights = terms.join(df, "term").select(
        "term", "qid", F.pmod(F.xxhash64("term"), totals.scalar()["buckets"]).cast("int").alias("bucket"),
        (F.col("qtf") * idf_column(F.col("df"), totals.scalar()["n"], idf)).alias("w"))
    postings = spark.read.parquet(f"{path}/postings").join(
        small(weights.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    tf = F.col("tf")
    length = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / totals.scalar()["avgdl"])
    scored = (
        postings.select("did", "term", (tf * F.lit(k1 + 1.0) / (tf + length)).alias("s"))
        .repartition("did").join(small(weights.drop("bucket")), "term")
        .groupBy("qid", "did").agg(F.sum(F.col("w") * F.col("s")).alias("score"))
    )
    return scored if k is None else topk_run(scored, k)


def overlap_counts(corpus: DataFrame, queries: DataFrame, lower: bool = True) -> DataFrame:
    """(qid, did, h, n, m): shared distinct tokens, distinct query tokens, distinct document tokens (h > 0 only)."""
    docs = corpus.select("did", F.array_distinct(tokenize_ws("text", lower)).alias("toks"))
    sets = queries.select("qid", F.array_distinct(tokenize_ws("query", lower)).alias("qs"))
    terms = sets.select("qid", F.size("qs").alias("n"), F.explode("qs").alias("term"))
    small = hinter(terms)
    vocabulary = small(terms.select("term").distinct())
    hits = docs.select("did", F.size("toks").alias("m"), F.explode_outer("toks").alias("term")).join(
        vocabulary, "term", "left_semi")
    return (
        hits.repartition("did").join(small(terms), "term")
        .groupBy("qid", "did").agg(
            F.count(F.lit(1)).alias("h"), F.first("n").alias("n"), F.first("m").alias("m"))
    )


def token_recall_run(
    corpus: DataFrame, queries: DataFrame, k: int | None = None, lists: termsums.TermLists | None = None,
) -> DataFrame:
    """Documents by the share of the query's distinct tokens they hold; ``lists`` as in ``bm25_run``."""
    sets = queries.select("qid", F.array_distinct(tokenize_ws("query")).alias("qs"))
    terms = sets.select("qid", F.size("qs").alias("n"), F.explode("qs").alias("term"))
    if k is not None and termsums.bounded(queries, terms, k):
        rows, vocabulary = _numbered(terms)
        held = lists or termsums.term_lists(corpus.select("did", tokenize_ws("text").alias("toks")), vocabulary)
        weights = pa.table({"qid": rows.column("qid"), "tid": _at(held, rows), "w": np.ones(rows.num_rows)})
        kind = terms.schema["qid"].dataType.simpleString()
        best = termsums.best_of_lists(held, weights, k, lambda tf, dl: np.ones(len(tf)), kind)
        if held.rows is not None:
            each = termsums.by_document(held.rows).groupBy("did", "tid").agg(F.count(F.lit(1)).alias("s"))
            best = best.unionByName(termsums.best_sums(each, weights, k, kind))
        sizes = terms.groupBy(F.col("qid").alias("_qid")).agg(F.first("n").alias("n"))
        hits = best.join(F.broadcast(sizes), F.col("qid").eqNullSafe(F.col("_qid")))
        return topk_run(hits.select("qid", "did", (F.col("score") / F.col("n")).alias("score")), k)
    run = overlap_counts(corpus, queries).select("qid", "did", (F.col("h") / F.col("n")).alias("score"))
    return run if k is None else topk_run(run, k)


# --- vectors ---------------------------------------------------------------------------------------------------

def pair_similarity(pairs: DataFrame, queries: DataFrame, docs: DataFrame, sim: str = "dot") -> DataFrame:
    """Similarity of given (qid, did) pairs, as column expressions."""
    a, b = F.col("qv"), F.col("dv")
    score = dot(a, b) if sim == "dot" else F.try_divide(dot(a, b), norm(a) * norm(b))
    return (
        pairs.join(queries.select("qid", F.col("vec").alias("qv")), "qid")
        .join(docs.select("did", F.col("vec").alias("dv")), "did")
        .withColumn("score", score).drop("qv", "dv")
    )


def sparse_run(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """Dot product of token weights: queries(qid, weights MAP), docs(did, weights MAP)."""
    q = queries.select("qid", F.explode("weights").alias("term", "wq"))
    small = hinter(q)
    d = docs.select("did", F.explode("weights").alias("term", "wd")).join(
        small(q.select("term").distinct()), "term", "left_semi")
    run = d.repartition("did").join(small(q), "term").groupBy("qid", "did").agg(
        F.sum(F.col("wq") * F.col("wd")).alias("score"))
    return run if k is None else topk_run(run, k)


def maxsim_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Late-interaction score of candidate pairs; vectors are ARRAY<ARRAY<FLOAT>> in ``vecs``.

    Queries and documents without a vector have no score; their pairs are left out, as ``maxsim_search`` does.
    """
    some = F.size("vecs") > 0
    return (
        pairs.select("qid", "did")
        .join(queries.where(some).select("qid", F.col("vecs").alias("qv")), "qid")
        .join(docs.where(some).select("did", F.col("vecs").alias("dv")), "did")
        .select("qid", "did", maxsim(F.col("qv"), F.col("dv")).alias("score"))
    )


def maxsim_run(
    queries: DataFrame, docs: DataFrame, k: int, skip_self: bool = False, candidates: DataFrame | None = None,
) -> DataFrame:
    """The k best documents per query by late interaction: among ``candidates`` (qid, did), or among all documents."""
    if candidates is not None:
        return topk_run(maxsim_scores(candidates, queries, docs), k)
    return maxsim_search(queries, docs, k, skip_self)


# --- substring joins -------------------------------------------------------------------------------------------

GRAM = 4


def term_in_token(terms: DataFrame, tokens: DataFrame, shortest: int = 1) -> DataFrame:
    """(term, token) where the term occurs inside the token.

    Terms of at least four characters meet tokens through the term's first four characters and are then verified;
    shorter terms use that many characters. Both sides are distinct words, never texts. ``shortest`` is the length
    that every term is known to reach.
    """
    sized = terms.select("term", F.least(F.length("term"), F.lit(GRAM)).alias("g"))
    probes = sized.select("term", "g", F.substr("term", F.lit(1), F.col("g")).alias("gram"))
    sizes = F.sequence(F.lit(min(shortest, GRAM)), F.lit(GRAM))
    grams = tokens.select("token", F.explode(F.array_distinct(F.flatten(F.transform(
        sizes, lambda g: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("token") - g + 1, F.lit(1))),
            lambda i: F.struct(g.alias("g"), F.substr("token", i, g).alias("gram"))))))).alias("x")
    ).select("token", "x.g", "x.gram")
    return grams.join(probes, ["g", "gram"]).where(F.contains("token", "term")).select("term", "token").distinct()


def docs_with_terms(corpus: DataFrame, terms: DataFrame, shortest: int = 1) -> DataFrame:
    """(term, did) for every document whose lower-cased text holds the (whitespace-free) term as a substring."""
    tokens = corpus.select("did", F.explode_outer(F.array_distinct(tokenize_ws("text"))).alias("token"))
    vocabulary = tokens.select("token").distinct()
    inside = term_in_token(terms.select("term").distinct(), vocabulary, shortest)
    return tokens.join(inside, "token").select("term", "did").distinct()


def exact_match_run(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Score 1.0 where the document holds the query as a substring, case kept; only hits are rows.

    A query of three or more whitespace tokens forces its middle tokens to be whole tokens of the document, so it
    meets documents on the longest of them. One- and two-token queries meet documents on tokens that contain their
    longest piece. Every meeting is verified on the texts; the meetings are written first, so that Spark knows
    their size before it decides whether the texts have to move.
    """
    q = queries.select("qid", "query", tokenize_ws("query", lower=False).alias("w"))
    longest = lambda words: F.element_at(
        F.array_sort(F.transform(words, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x")))), 1)["x"]
    long_q = q.where(F.size("w") >= 3).select(
        "qid", "query", longest(F.slice("w", 2, F.size("w") - 2)).alias("token"))
    short_q = q.where((F.size("w") > 0) & (F.size("w") < 3)).select("qid", "query", longest(F.col("w")).alias("term"))
    tokens = corpus.select("did", F.explode_outer(F.array_distinct(tokenize_ws("text", lower=False))).alias("token"))
    pieces = short_q.select("term").distinct()
    inside = term_in_token(pieces, tokens.select("token").distinct())
    short_keys = short_q.join(inside, "term").select("qid", "query", "token")
    keys = hinter(queries)(long_q) if not _any(short_q) else long_q.unionByName(short_keys)
    met = written(tokens.join(keys, "token").select("qid", "query", "did").distinct(), "substring-candidates")
    return (
        corpus.select("did", "text").join(met, "did").where(F.contains("text", "query"))
        .select("qid", "did", F.lit(1.0).alias("score"))
    )


def _any(df: DataFrame) -> bool:
    return not fits(df, 0)


LONG_TERM = 4  # Fixed value: terms of fewer characters are not used to exclude documents.


def excluded_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): query tokens longer than three characters, lower-cased."""
    words = F.filter(tokenize_ws("query"), lambda t: F.length(t) >= LONG_TERM)
    return queries.select("qid", F.explode(F.array_distinct(words)).alias("term"))


def exclude_terms_counts(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, n_without): documents that hold none of the query's longer terms, not even inside a word."""
    return count_free(corpus, queries, excluded_terms(queries))


def exclude_terms_join(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, did): the documents themselves. Nearly queries x documents rows, so hand in the queries that need them."""
    return free_documents(corpus, queries, excluded_terms(queries))
