"""Agreement between judgment sets, all of it algebra on label counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of (gold, pred)."""
    return pairs.groupBy(*(keys or []), "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def label_margins(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, label, gold_n, pred_n, both_n) from the confusion counts."""
    keys = keys or []
    n, zero = F.col("n"), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("gold").alias("label"), n.alias("g"), zero.alias("p"),
                 F.when(F.col("gold") == F.col("pred"), n).otherwise(zero).alias("b")),
        F.struct(F.col("pred").alias("label"), zero.alias("g"), n.alias("p"), zero.alias("b")))
    return (
        confusion(pairs, keys).select(*keys, F.inline(sides)).groupBy(*keys, "label")
        .agg(F.sum("g").alias("gold_n"), F.sum("p").alias("pred_n"), F.sum("b").alias("both_n"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_report(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every label; an empty denominator gives 0."""
    g, p, b = F.col("gold_n"), F.col("pred_n"), F.col("both_n")
    return label_margins(pairs, keys).select(
        *(keys or []), "label", _ratio(b, p).alias("precision"), _ratio(b, g).alias("recall"),
        _ratio(b * 2, g + p).alias("f1"), g.alias("support"))


def agreement_metrics(pairs: DataFrame, keys: list[str] | None = None, positive: int = 1) -> DataFrame:
    """Accuracy, binary and macro P/R/F1, Cohen's kappa and Krippendorff's nominal alpha in one pass.

    Kappa and alpha are NULL where they are undefined (a single label on both sides).
    """
    keys = keys or []
    g, p, b = F.col("gold_n").cast("double"), F.col("pred_n").cast("double"), F.col("both_n").cast("double")
    pos = lambda c: F.coalesce(F.sum(F.when(F.col("label") == positive, c)), F.lit(0.0))
    sums = label_margins(pairs, keys).groupBy(*keys).agg(
        F.sum("gold_n").alias("n"), F.sum(b).alias("same"), F.sum(g * p).alias("gp"),
        F.sum((g + p) * (g + p)).alias("sq"), pos(g).alias("pg"), pos(p).alias("pp"), pos(b).alias("pb"),
        F.avg(_ratio(b, p)).alias("macro_precision"), F.avg(_ratio(b, g)).alias("macro_recall"),
        F.avg(_ratio(b * 2, g + p)).alias("macro_f1"))
    n, same = F.col("n").cast("double"), F.col("same")
    return sums.select(
        *keys, "n", (same / n).alias("accuracy"),
        _ratio(F.col("pb"), F.col("pp")).alias("precision"), _ratio(F.col("pb"), F.col("pg")).alias("recall"),
        _ratio(F.col("pb") * 2, F.col("pg") + F.col("pp")).alias("f1"),
        "macro_precision", "macro_recall", "macro_f1",
        F.try_divide(n * same - F.col("gp"), n * n - F.col("gp")).alias("kappa"),
        (1.0 - F.try_divide((n * 2 - 1) * (n - same) * 2, n * n * 4 - F.col("sq"))).alias("alpha"))


def agreement_summary(per_query: DataFrame, weak_kappa: float = 0.2) -> DataFrame:
    """Means over queries (undefined values skipped), queries without any agreement on positives, weak kappas."""
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg("f1").alias("mean_f1"), F.avg("kappa").alias("mean_kappa"),
        F.avg("alpha").alias("mean_alpha"), F.count_if(F.col("f1") == 0).alias("n_f1_zero"),
        F.count_if(F.col("kappa") < weak_kappa).alias("n_weak_kappa"))


def join_gold_pred(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(qid, did, gold, pred) of pairs that both sides judged."""
    return gold.select("qid", "did", F.col("label").alias("gold")).join(
        pred.select("qid", "did", F.col("label").alias("pred")), ["qid", "did"])


def pair_coverage(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: pairs on both sides, gold only, pred only."""
    both = gold.select("qid", "did", F.lit(1).alias("g")).join(
        pred.select("qid", "did", F.lit(1).alias("p")), ["qid", "did"], "full_outer")
    return both.agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("n_both"),
        F.count_if(F.col("p").isNull()).alias("n_gold_only"), F.count_if(F.col("g").isNull()).alias("n_pred_only"))


def align_annotators(a: DataFrame, b: DataFrame, strict: bool = True) -> DataFrame:
    """(qid, did, label_a, label_b). ``strict`` fails the job where one side lacks a pair."""
    both = a.select("qid", "did", F.col("label").alias("label_a")).join(
        b.select("qid", "did", F.col("label").alias("label_b")), ["qid", "did"], "full_outer")
    if not strict:
        return both

    def needed(col: str, other: str) -> Column:
        text = F.concat(F.lit(f"pair missing in {other}: "), F.col("qid"), F.lit("/"), F.col("did"))
        return F.coalesce(F.col(col), F.raise_error(text).cast("int")).alias(col)

    return both.select("qid", "did", needed("label_a", "first set"), needed("label_b", "second set"))


def _stacked(preds: list[DataFrame]) -> DataFrame:
    """(qid, did, v STRUCT(set, label)) of all prediction sets."""
    return reduce(DataFrame.unionByName, [
        p.select("qid", "did", F.struct(F.lit(i).alias("set"), F.col("label").alias("label")).alias("v"))
        for i, p in enumerate(preds)])


def ensemble_join(gold: DataFrame, preds: list[DataFrame]) -> DataFrame:
    """(qid, did, gold, votes ARRAY) of gold pairs that every prediction set covers; one shuffle for all sets."""
    votes = _stacked(preds).groupBy("qid", "did").agg(F.sort_array(F.collect_set("v")).alias("v")).where(
        F.size("v") == len(preds))
    return gold.select("qid", "did", F.col("label").alias("gold")).join(votes, ["qid", "did"]).select(
        "qid", "did", "gold", F.transform("v", lambda x: x["label"]).alias("votes"))


def ensemble_dropped(gold: DataFrame, preds: list[DataFrame]) -> DataFrame:
    """(qid, did, gold, missing ARRAY) of gold pairs that ``ensemble_join`` drops; sets that lack the pair, from 1."""
    covered = _stacked(preds).groupBy("qid", "did").agg(F.collect_set(F.col("v.set") + 1).alias("covered"))
    every = F.array(*[F.lit(i + 1) for i in range(len(preds))])
    missing = F.coalesce(F.array_except(every, F.col("covered")), every)
    return gold.select("qid", "did", F.col("label").alias("gold")).join(covered, ["qid", "did"], "left").select(
        "qid", "did", "gold", missing.alias("missing")).where(F.size("missing") > 0)


def majority_label(votes: Column) -> Column:
    """Most frequent vote; 0 when two labels tie for the top."""
    counts = F.transform(F.array_distinct(votes), lambda v: F.struct(
        F.size(F.filter(votes, lambda x: x == v)).alias("c"), v.alias("v")))
    ordered = F.sort_array(counts, asc=False)
    tied = (F.size(ordered) > 1) & (F.try_element_at(ordered, F.lit(2))["c"] == F.element_at(ordered, 1)["c"])
    return F.when(F.coalesce(tied, F.lit(False)), F.lit(0)).otherwise(F.element_at(ordered, 1)["v"])


def label_entropy(qrels: DataFrame, grades: int = 4, keys: list[str] | None = None) -> DataFrame:
    """Counts per grade, entropy in bits, purity and majority grade (the smallest on a tie)."""
    keys = keys or ["qid"]
    counts = qrels.groupBy(*keys).agg(
        *[F.count_if(F.col("label") == i).alias(f"n_{i}") for i in range(grades)],
        F.count_if(F.col("label").between(0, grades - 1)).alias("n"))
    cols = [F.col(f"n_{i}") for i in range(grades)]
    entropy = F.lit(0.0)
    for c in cols:
        share = c / F.col("n")
        entropy = entropy - F.when(c > 0, share * F.log2(share)).otherwise(0.0)
    top = F.greatest(*cols)
    majority = F.array_position(F.array(*cols), top).cast("int") - 1
    return counts.where(F.col("n") > 0).withColumns({
        "entropy": entropy, "purity": top / F.col("n"), "majority": majority})


def entropy_summary(entropy: DataFrame) -> DataFrame:
    return entropy.agg(
        F.avg("entropy").alias("mean_entropy"), F.median("entropy").alias("median_entropy"),
        F.max("entropy").alias("max_entropy"), F.avg("purity").alias("mean_purity"))


def label_distribution(qrels: DataFrame) -> DataFrame:
    """Per query: negatives (grades 0 and 1), positives, and their ratio (NULL without positives)."""
    low = F.count_if(F.col("label") <= 1)
    high = F.count_if(F.col("label") >= 2)
    return qrels.groupBy("qid").agg(low.alias("n_neg"), high.alias("n_pos"), F.try_divide(low, high).alias("neg_per_pos"))
