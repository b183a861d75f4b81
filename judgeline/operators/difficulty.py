"""Query difficulty and resampling tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgeline.functions.text import token_set_punct, tokenize_letters
from judgeline.operators.retrieve import idf_column
from judgeline.operators.sizing import exact_quantiles, hash32, hinter, number_ranges, pick

PROB_FLOOR = 1e-12  # Fixed value: smallest collection probability of a term.


def query_features(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Length, distinct terms, idf statistics over distinct terms, and clarity against the collection.

    Collection counts are made for query terms only.
    """
    terms = queries.select("qid", F.explode(tokenize_letters("query")).alias("term")).groupBy("qid", "term").agg(
        F.count(F.lit(1)).alias("qtf"))
    small = hinter(terms)
    docs = corpus.select("did", tokenize_letters("text").alias("toks"))
    tokens = docs.select("did", F.explode_outer("toks").alias("term")).join(
        small(terms.select("term").distinct()), "term", "left_semi")
    stats = tokens.groupBy("did", "term").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(
        F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    totals = docs.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("toks")).alias("tokens")).alias("t")).select("t")
    lengths = queries.select("qid", F.size(tokenize_letters("query")).alias("q_len"))
    rows = terms.join(stats, "term", "left").join(lengths, "qid")
    df, cf = F.coalesce("df", F.lit(0)), F.coalesce("cf", F.lit(0))
    idf = idf_column(df, totals.scalar()["n"], "plus1")
    pq = F.col("qtf") / F.col("q_len")
    pc = F.greatest(cf / totals.scalar()["tokens"], F.lit(PROB_FLOOR))
    feats = rows.withColumns({"idf": idf, "cl": pq * F.ln(pq / pc)}).groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_unique"), F.avg("idf").alias("avg_idf"), F.sum("idf").alias("sum_idf"),
        F.max("idf").alias("max_idf"), F.sum("cl").alias("clarity"))
    return lengths.join(feats, "qid", "left").fillna(0).select(
        "qid", "q_len", "n_unique", "avg_idf", "sum_idf", "max_idf", "clarity")


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL for constant columns and single rows."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def feature_correlation(table: DataFrame, features: list[str], metrics: list[str], keys: list[str] | None = None):
    """(feature, metric, n, pearson, slope, intercept) for every pairing of columns."""
    keys = keys or []
    pairs = [F.struct(F.lit(f).alias("feature"), F.lit(m).alias("metric"), F.col(f).cast("double").alias("x"),
                      F.col(m).cast("double").alias("y")) for f in features for m in metrics]
    long = table.select(*keys, F.inline(F.array(*pairs)))
    x, y = F.col("x"), F.col("y")
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return long.groupBy(*keys, "feature", "metric").agg(
        F.count(F.lit(1)).alias("n"), pearson(x, y).alias("pearson"), slope.alias("slope"),
        (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def quartile_effect(table: DataFrame, feature: str, metrics: list[str]) -> DataFrame:
    """Mean metrics in the four quartile bins of a feature; bin edges belong to the lower bin."""
    cuts = exact_quantiles(table, feature, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    c = cuts.select(F.struct("q1", "q2", "q3").alias("c")).scalar()
    marked = table.withColumn("_c", c)
    x = F.col(feature)
    bin_ = (F.when(x <= F.col("_c.q1"), 1).when(x <= F.col("_c.q2"), 2).when(x <= F.col("_c.q3"), 3).otherwise(4))
    return marked.groupBy(bin_.alias("quartile")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])


def _bounds(table: DataFrame, value: str, alpha: float, keys: list[str]) -> DataFrame:
    return exact_quantiles(table, value, {"low": alpha / 2, "high": 1 - alpha / 2}, keys)


def bootstrap_ci(
    scores: DataFrame, value: str, reps: int = 2000, alpha: float = 0.05, seed: str = "42", id_col: str = "qid"
) -> DataFrame:
    """Mean of per-query scores with a percentile interval over ``reps`` resamples with replacement.

    Draw i of resample b is row ``hash(seed, b, i) mod n``; rows are numbered in id order.
    """
    numbered = number_ranges(
        scores.select(id_col, F.col(value).cast("double").alias("v")), [F.col(id_col)], name="i").withColumn("i", F.col("i") - 1)
    n = scores.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = numbered.select("i", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("b"))
    picked = draws.select("b", (hash32(seed, F.col("b"), F.col("i")) % n).alias("i")).join(
        numbered.select("i", "v"), "i")
    means = picked.groupBy("b").agg(F.avg("v").alias("m"))
    mean = scores.agg(F.avg(value).alias("m")).scalar()
    return _bounds(means, "m", alpha, []).select(mean.alias("mean"), "low", "high")


def paired_randomization(deltas: DataFrame, delta: str = "delta", reps: int = 10_000, seed: str = "42") -> DataFrame:
    """Two-sided sign-flip test: p = (hits + 1) / (reps + 1).

    Every task adds up its own rows for all repetitions before anything is shuffled.
    """
    d = deltas.select("qid", F.col(delta).cast("double").alias("d"))
    observed = d.agg(F.avg("d").alias("m")).scalar()
    flips = d.select("qid", "d", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    sign = F.when(hash32(seed, F.col("rep"), F.col("qid")) % 2 == 0, 1.0).otherwise(-1.0)
    means = flips.groupBy("rep").agg(F.avg(F.col("d") * sign).alias("m"))
    hit = F.count_if(F.round(F.abs("m"), 9) >= F.round(F.abs(observed), 9))
    return means.agg(observed.alias("observed"), hit.alias("hits"), ((hit + 1) / F.lit(reps + 1)).alias("p_value"))


def pair_token_sets(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds the punctuation-free token sets ``qs`` and ``ds`` to (qid, did) rows; NULL for unknown documents."""
    q = queries.select("qid", token_set_punct("query").alias("qs"))
    d = pick(corpus.select("did", "text"), pairs).select("did", token_set_punct("text").alias("ds"))
    return pairs.join(q, "qid").join(d, "did", "left")


def set_similarity(pairs: DataFrame) -> DataFrame:
    """Adds token recall and Jaccard similarity of the arrays ``qs`` and ``ds``; a missing document is empty."""
    q, d = F.coalesce("qs", F.array().cast("array<string>")), F.coalesce("ds", F.array().cast("array<string>"))
    both = F.size(F.array_intersect(q, d))
    return pairs.withColumns({
        "token_recall": F.coalesce(F.try_divide(both, F.size(q)), F.lit(0.0)),
        "jaccard": F.coalesce(F.try_divide(both, F.size(q) + F.size(d) - both), F.lit(0.0))})


def overlap_by_dataset(judged: DataFrame, queries: DataFrame, corpora: dict[str, DataFrame]) -> DataFrame:
    """Mean token recall and Jaccard of judged pairs over several corpora, by data set and by data set and label.

    ``judged`` has ``dataset, qid, did, label`` and ``queries`` ``dataset, qid, query``; the result has a row with a NULL
    label per data set, and columns ``token_recall_<name>, jaccard_<name>`` per corpus. Unknown queries and documents
    are empty sets. Texts are cut to the judged documents where they are read, and only token sets are joined.
    """
    rows = judged.select("dataset", "qid", "did", "label").join(
        queries.select("dataset", "qid", token_set_punct("query").alias("qs")), ["dataset", "qid"], "left")
    for name, corpus in corpora.items():
        docs = pick(corpus.select("did", "text"), judged).select("did", token_set_punct("text").alias("ds"))
        rows = set_similarity(rows.join(docs, "did", "left")).drop("ds").withColumnsRenamed(
            {"token_recall": f"token_recall_{name}", "jaccard": f"jaccard_{name}"})
    means = [F.avg(f"{kind}_{name}").alias(f"{kind}_{name}") for name in corpora for kind in ("token_recall", "jaccard")]
    whole = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *means).withColumn("label", F.lit(None).cast("int"))
    return rows.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"), *means).unionByName(whole)


def mean_jaccard_all_pairs(overlap: DataFrame, n_queries: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Mean Jaccard over all query-document pairs from the overlapping ones; the others add 0."""
    total = overlap.agg(F.sum(F.col("h") / (F.col("n") + F.col("m") - F.col("h"))).alias("t"))
    nq = n_queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    nd = n_docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return total.select(F.try_divide(F.col("t"), nq * nd).alias("mean_jaccard"))


def citation_accuracy(cited: Column, source: Column) -> Column:
    """Share of the distinct cited numbers that also occur in the source; NULL when nothing is cited."""
    return F.try_divide(F.size(F.array_intersect(cited, source)), F.size(F.array_distinct(cited)))


def score_histogram(scored: DataFrame, bins: int = 20, rel: int = 2) -> DataFrame:
    """Share of relevant and other documents per score bin; both use the same bins."""
    span = scored.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi")).alias("s")).scalar()
    rows = scored.select((F.col("label") >= rel).cast("int").alias("relevant"), "score", span.alias("s"))
    share = F.try_divide(F.col("score") - F.col("s.lo"), F.col("s.hi") - F.col("s.lo"))
    bin_ = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    cells = rows.groupBy("relevant", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("relevant").agg(F.sum("n").alias("total"))
    return cells.join(totals, "relevant").select("relevant", "bin", "n", (F.col("n") / F.col("total")).alias("share"))


def score_boxes(scored: DataFrame, rel: int = 2) -> DataFrame:
    marked = scored.withColumn("relevant", (F.col("label") >= rel).cast("int"))
    return exact_quantiles(
        marked, "score", {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}, ["relevant"])


def score_gaps(scored: DataFrame, rel: int = 2) -> DataFrame:
    """Per query: difference of the sums and of the means of relevant and other scores."""
    pos, neg = F.when(F.col("label") >= rel, F.col("score")), F.when(F.col("label") < rel, F.col("score"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.groupBy("qid").agg(
        (zero(F.sum(pos)) - zero(F.sum(neg))).alias("sum_gap"), (zero(F.avg(pos)) - zero(F.avg(neg))).alias("mean_gap"))
