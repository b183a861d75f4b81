"""Ranking quality: per query first, means second.

Every metric needs ranks of judged documents only, so the run is cut to judged rows by an inner join, and one
aggregation per (run, query) yields all metrics together. Running counts, where a metric needs them, are made in
rank buckets, so that a query with very many judgments does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgeline.functions.scoring import dot, norm
from judgeline.operators.sizing import cumulate, cumulate_ranges, number_ranges
from judgeline.session import written

RUN_KEYS = ["run_id", "qid"]
RANK_BUCKET = 16_384
# Cut-offs of the judged share, of recall, and of the evaluation's defaults.
JUDGED_CUTS = (10, 20, 50, 100)
RECALL_CUTS = (10, 100, 1000)


def exp_gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1.0


def linear_gain(label: Column) -> Column:
    return label.cast("double")


GAINS = {"exp": exp_gain, "linear": linear_gain}


def discount(position: Column) -> Column:
    return F.lit(1.0) / F.log2(position + 1.0)


def discount_sum(first: Column, last: Column) -> Column:
    """Sum of the discounts of positions first..last, 0 when the range is empty."""
    positions = F.sequence(first.cast("int"), F.greatest(first, last).cast("int"))
    total = F.aggregate(positions, F.lit(0.0), lambda a, p: a + discount(p))
    return F.when(last >= first, total).otherwise(F.lit(0.0))


def ideal_dcg(qrels: DataFrame, wanted: dict[str, tuple[str, int | None]]) -> DataFrame:
    """Best possible DCG per query, from label counts: {column: (gain name, cut or None)}."""
    counts = qrels.where(F.col("label") > 0).groupBy("qid", "label").agg(F.count(F.lit(1)).alias("c"))
    above = Window.partitionBy("qid").orderBy(F.col("label").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("c").over(above), F.lit(0)))
    aggs = []
    for name, (gain, cut) in wanted.items():
        last = F.col("before") + F.col("c")
        last = last if cut is None else F.least(last, F.lit(cut))
        aggs.append(F.sum(GAINS[gain](F.col("label")) * discount_sum(F.col("before") + 1, last)).alias(name))
    return placed.groupBy("qid").agg(*aggs)


def with_run_id(run: DataFrame, run_id: str = "run") -> DataFrame:
    return run if "run_id" in run.columns else run.withColumn("run_id", F.lit(run_id))


def judged_rows(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run rows that carry a judgment, with their rank in the full run.

    A run without a ``rank`` column is ranked range by range, so that no query's rows are sorted in one task.
    """
    run = with_run_id(run)
    judgments = qrels.select("qid", "did", "label")
    if "rank" not in run.columns:
        scored = run.select(*RUN_KEYS, "did", (-F.round("score", 9)).alias("_s"))
        run = number_ranges(scored, [F.col("_s"), F.col("did")], RUN_KEYS, "rank").withColumn("rank", F.col("rank").cast("int"))
    return run.select(*RUN_KEYS, "did", "rank").join(judgments, ["qid", "did"])


def evaluated_queries(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(run_id, qid) of queries that the run answers and the judgments cover."""
    asked = with_run_id(run).select(*RUN_KEYS).distinct()
    return asked.join(qrels.select("qid").distinct(), "qid", "left_semi")


def query_metrics(
    run: DataFrame,
    qrels: DataFrame,
    metrics: Iterable[str],
    rel: int = 1,
    cap_bpref: bool = False,
) -> DataFrame:
    """One row per (run_id, qid), one column per metric name.

    Names: ``ndcg_exp@k``, ``condensed_ndcg@k``, ``ndcg_cut@k``, ``ndcg``, ``judged@k``, ``recall@k``, ``recip_rank``,
    ``map``, ``bpref``. ``@k`` becomes ``_k`` in the column name. ``rel`` is the lowest relevant grade.
    """
    metrics = list(metrics)
    ideal: dict[str, tuple[str, int | None]] = {}
    aggs: list[Column] = []
    finals: list[Column] = []
    rank, cond, label = F.col("rank"), F.col("cond_rank"), F.col("label")

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    for m in metrics:
        name, _, cut_text = m.partition("@")
        col = m.replace("@", "_")
        cut = int(cut_text) if cut_text else None
        if name in ("ndcg_exp", "condensed_ndcg", "ndcg_cut", "ndcg"):
            gain = "linear" if name in ("ndcg_cut", "ndcg") else "exp"
            pos = cond if name == "condensed_ndcg" else rank
            inside = F.lit(True) if cut is None else pos <= cut
            aggs.append(F.sum(F.when(inside, GAINS[gain](label) * discount(pos))).alias(f"a_{col}"))
            ideal[f"i_{col}"] = (gain, cut)
            finals.append(zero(F.try_divide(F.col(f"a_{col}"), F.col(f"i_{col}"))).alias(col))
        elif name == "judged":
            aggs.append(F.count_if(rank <= cut).alias(f"a_{col}"))
            finals.append(zero(F.col(f"a_{col}") / F.lit(cut)).alias(col))
        elif name == "recall":
            aggs.append(F.count_if((rank <= cut) & (label >= rel)).alias(f"a_{col}"))
            finals.append(zero(F.try_divide(F.col(f"a_{col}"), F.col("n_rel"))).alias(col))
        elif name == "recip_rank":
            aggs.append(F.min(F.when(label >= rel, rank)).alias(f"a_{col}"))
            finals.append(zero(F.lit(1.0) / F.col(f"a_{col}")).alias(col))
        elif name == "map":
            aggs.append(F.sum(F.when(label >= rel, F.col("rel_upto") / rank)).alias(f"a_{col}"))
            finals.append(zero(F.try_divide(F.col(f"a_{col}"), F.col("n_rel"))).alias(col))
        elif name == "bpref":
            bound = F.least("n_rel", "n_non")
            above = F.least(F.col("non_upto"), bound) if cap_bpref else F.col("non_upto")
            term = F.lit(1.0) - F.try_divide(above, bound)
            aggs.append(F.sum(F.when((label >= rel) & (bound > 0), term)).alias(f"a_{col}"))
            finals.append(zero(F.try_divide(F.col(f"a_{col}"), F.col("n_rel"))).alias(col))
        else:
            raise ValueError(f"unknown metric {m!r}")

    totals = qrels.groupBy("qid").agg(
        F.count_if(label >= rel).alias("n_rel"), F.count_if(label < rel).alias("n_non"))
    rows = judged_rows(run, qrels)
    names = {m.partition("@")[0] for m in metrics}
    running = {}
    if "condensed_ndcg" in names:
        running["cond_rank"] = F.lit(1).cast("long")
    if "map" in names:
        running["rel_upto"] = (label >= rel).cast("long")
    if "bpref" in names:
        running["non_upto"] = (label < rel).cast("long")
        rows = rows.join(totals, "qid")
    if running:
        rows = cumulate(rows, F.floor(rank / RANK_BUCKET), [rank], running, RUN_KEYS)
    found = rows.groupBy(*RUN_KEYS).agg(*aggs)
    out = evaluated_queries(run, qrels).join(totals, "qid").join(found, RUN_KEYS, "left")
    if ideal:
        out = out.join(ideal_dcg(qrels, ideal), "qid", "left")
    return out.select(*RUN_KEYS, *finals)


def mean_metrics(per_query: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over evaluated queries of every metric column."""
    keys = ["run_id"] if keys is None else keys
    cols = [c for c in per_query.columns if c not in RUN_KEYS and c not in keys]
    return per_query.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_queries"), *[F.avg(c).alias(c) for c in cols])


def metric_deltas(per_query: DataFrame) -> DataFrame:
    """Differences that show how incomplete judgments bias nDCG."""
    return per_query.select(
        *RUN_KEYS,
        (F.col("bpref") - F.col("ndcg_exp_10")).alias("bpref_minus_ndcg"),
        (F.col("condensed_ndcg_10") - F.col("ndcg_exp_10")).alias("condensed_minus_ndcg"),
    )


def run_delta(per_query: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """Per-query difference of a metric between two runs (second minus first)."""
    pick = lambda r: F.max(F.when(F.col("run_id") == r, F.col(metric)))
    return (
        per_query.where(F.col("run_id").isin(first, second)).groupBy("qid")
        .agg(pick(first).alias("a"), pick(second).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select("qid", "a", "b", (F.col("b") - F.col("a")).alias("delta"))
    )


def duplicate_run_rows(run: DataFrame) -> DataFrame:
    """(run_id, qid, did, n) of documents that a run ranks more than once; '0' is a filler id."""
    return (
        with_run_id(run).where(F.col("did") != "0").groupBy(*RUN_KEYS, "did").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def official_mrr(run: DataFrame, reference: DataFrame, cut: int = 10) -> DataFrame:
    """MRR over all reference queries, those without positives included.

    Positive means grade 2 or more when any grade 2 or 3 occurs in the reference, else exactly 1.
    """
    run = with_run_id(run)
    graded = reference.agg((F.max("label") >= 2).alias("g")).scalar()
    positive = F.when(graded, F.col("label") >= 2).otherwise(F.col("label") == 1)
    hits = run.where(F.col("rank") <= cut).join(reference.where(positive).select("qid", "did"), ["qid", "did"])
    best = hits.groupBy(*RUN_KEYS).agg((F.lit(1.0) / F.min("rank")).alias("rr"))
    n_ref = reference.agg(F.count_distinct("qid").alias("n")).scalar()
    ranked = run.groupBy("run_id").agg(F.count_distinct("qid").alias("queries_ranked"))
    total = best.groupBy("run_id").agg(F.sum("rr").alias("rr"))
    return ranked.join(total, "run_id", "left").select(
        "run_id", (F.coalesce("rr", F.lit(0.0)) / n_ref).alias("mrr"), "queries_ranked")


def _by_score_desc(cells: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums from the highest score down."""
    return cumulate_ranges(cells, [F.col("score").desc()], sums, keys)


def tied_ndcg(scored: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Linear-gain nDCG of (score, label) groups; documents of one score share their mean gain."""
    keys = keys or ["qid"]
    ties = scored.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("c"), F.avg(F.col("label").cast("double")).alias("gain"))
    placed = _by_score_desc(ties, keys, {"upto": F.col("c")}).withColumn("before", F.col("upto") - F.col("c"))
    dcg = placed.groupBy(*keys).agg(F.sum(F.col("gain") * discount_sum(
        F.col("before") + 1, F.least(F.col("before") + F.col("c"), F.lit(k)))).alias("dcg"))
    counts = scored.where(F.col("label") > 0).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c"))
    best = Window.partitionBy(*keys).orderBy(F.col("label").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ideal = (
        counts.withColumn("before", F.coalesce(F.sum("c").over(best), F.lit(0)))
        .groupBy(*keys).agg(F.sum(F.col("label") * discount_sum(
            F.col("before") + 1, F.least(F.col("before") + F.col("c"), F.lit(k)))).alias("idcg"))
    )
    return dcg.join(ideal, keys, "left").select(
        *keys, F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias(f"ltr_ndcg_{k}"))


def ltr_rank_metrics(run: DataFrame, qrels: DataFrame, k: int, rel: int = 2) -> DataFrame:
    """MRR@k and recall@k of a ranked run, relevant from grade 2 on; a query without positives scores 0."""
    out = query_metrics(run, qrels, ["recip_rank", f"recall@{k}"], rel=rel)
    rr = F.when(F.round(1 / F.col("recip_rank")) <= k, F.col("recip_rank")).otherwise(F.lit(0.0))
    rr = F.when(F.col("recip_rank") > 0, rr).otherwise(F.lit(0.0))
    return out.select(*RUN_KEYS, rr.alias(f"ltr_mrr_{k}"), F.col(f"recall_{k}").alias(f"ltr_recall_{k}"))


def pairwise_accuracy(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of (score_pos, score_neg) rows whose positive scores higher."""
    right = (F.col("score_pos") > F.col("score_neg")).cast("double")
    return pairs.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(right).alias("pairwise_accuracy"))


def triplet_accuracy(triplets: DataFrame, vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairwise accuracy of (anchor, positive, negative) ids by the cosine of their vectors (id, vec).

    A pair's cosine is taken once, however many triplets it is in, so that triplets move as ids and numbers. Vectors that share
    an id are combined with each other; the two scores of a triplet have the same vector of the anchor.
    """
    held = vectors.groupBy("id").agg(F.collect_list(F.struct("vec")).alias("held"))

    def cosine(a: Column, b: Column) -> Column:
        return F.round(F.try_divide(dot(a, b), norm(a) * norm(b)), 9)

    pairs = triplets.select("anchor", F.explode(F.array("positive", "negative")).alias("id")).distinct()
    anchors = held.select(F.col("id").alias("anchor"), F.posexplode("held").alias("at", "own"))
    cosines = written(pairs.join(anchors, "anchor").join(held, "id").select(
        "anchor", "at", "id", F.transform("held", lambda o: cosine(F.col("own.vec"), o["vec"])).alias("scores")), "cosines")
    of = lambda name: cosines.withColumnsRenamed({"id": name, "scores": f"_{name}"})
    rows = triplets.join(of("positive"), ["anchor", "positive"]).join(of("negative"), ["anchor", "negative", "at"])
    rows = rows.select(*(keys or []), "_negative", F.explode("_positive").alias("score_pos"))
    return pairwise_accuracy(rows.select(*(keys or []), "score_pos", F.explode("_negative").alias("score_neg")), keys)


def graded_pair_accuracy(scored: DataFrame, keys: list[str] | None = None, levels: int = 4) -> DataFrame:
    """Pairwise accuracy over all pairs of different grade in a group, without building the pairs.

    Scores are counted per (score, grade); a running sum over lower scores gives, for every document, how many
    lower-graded documents it beats.
    """
    keys = keys or ["qid"]
    cells = scored.groupBy(*keys, "score", "label").agg(F.count(F.lit(1)).alias("c"))
    per_score = cells.groupBy(*keys, "score").agg(
        *[F.sum(F.when(F.col("label") == g, F.col("c")).otherwise(0)).alias(f"c{g}") for g in range(levels)])
    upto = {f"b{g}": F.col(f"c{g}") for g in range(levels - 1)}
    run = cumulate_ranges(per_score, [F.col("score")], upto, keys)
    run = run.withColumns({f"b{g}": F.col(f"b{g}") - F.col(f"c{g}") for g in range(levels - 1)})
    won = sum((F.col(f"c{hi}") * sum((F.col(f"b{lo}") for lo in range(hi)), F.lit(0)) for hi in range(1, levels)),
              F.lit(0))
    sums = run.groupBy(*keys).agg(
        F.sum(won).alias("won"), *[F.sum(f"c{g}").alias(f"t{g}") for g in range(levels)])
    pairs = sum((F.col(f"t{hi}") * F.col(f"t{lo}") for hi in range(1, levels) for lo in range(hi)), F.lit(0))
    return sums.select(*keys, "won", pairs.alias("n_pairs"), F.try_divide("won", pairs).alias("pairwise_accuracy"))


def average_precision(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AP of (score, label 0/1) rows: precision at every distinct score, weighted by the recall it adds."""
    keys = keys or []
    steps = scored.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("label").cast("long")).alias("p"))
    cum = _by_score_desc(steps, keys, {"cc": F.col("c"), "cp": F.col("p")})
    return cum.groupBy(*keys).agg(
        F.sum("p").alias("n_pos"),
        F.try_divide(F.sum(F.col("p") * F.col("cp") / F.col("cc")), F.sum("p")).alias("average_precision"))


#: Metric sets by name.
METRIC_SETS: dict[str, tuple[str, ...]] = {
    "classic": ("recip_rank", "map", *(f"recall@{k}" for k in RECALL_CUTS), "ndcg", "ndcg_cut@10"),
    "completeness": ("ndcg_exp@10", "condensed_ndcg@10", "bpref", *(f"judged@{k}" for k in JUDGED_CUTS)),
}


def register_metric_set(name: str, metrics: tuple[str, ...]) -> None:
    """Add a metric set of one's own under a new name, or the same one again."""
    if METRIC_SETS.setdefault(name, tuple(metrics)) != tuple(metrics):
        raise ValueError(f"metric set {name} exists already")


def evaluate(run: DataFrame, qrels: DataFrame, metric_set: str = "classic", rel: int = 1) -> DataFrame:
    return query_metrics(run, qrels, METRIC_SETS[metric_set], rel=rel)
