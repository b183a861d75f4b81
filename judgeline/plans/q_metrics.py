"""Queries on ranking-quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgeline.operators import metrics as M
from judgeline.operators import retrieve as R
from judgeline.plans import fixtures as fx
from judgeline.plans.registry import query
from judgeline.plans.sqlparts import part, topk


def rounded(df, keep=("run_id", "qid", "did", "rank", "n_queries", "label", "n")):
    return df.select(*[c if c in keep else F.round(c, 6).alias(c) for c in df.columns])


part("ev", "runs gold", "SELECT DISTINCT run_id, qid FROM runs WHERE qid IN (SELECT qid FROM gold)")
part("jr", "runs gold", """SELECT run_id, qid, did, rank, label,
    row_number() OVER w cond_rank, sum(CAST(label >= 1 AS INT)) OVER w rel_upto, sum(CAST(label < 1 AS INT)) OVER w non_upto
    FROM runs JOIN gold USING (qid, did) WINDOW w AS (PARTITION BY run_id, qid ORDER BY rank)""")
part("gr", "gold", """SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY label DESC, did) pos,
    count_if(label >= 1) OVER (PARTITION BY qid) n_rel, count_if(label < 1) OVER (PARTITION BY qid) n_non FROM gold""")
part("ideal", "gr", """SELECT qid, any_value(n_rel) n_rel, any_value(n_non) n_non,
    sum((pow(2, label) - 1) / log2(pos + 1)) FILTER (pos <= 10) i_exp, sum(label / log2(pos + 1)) FILTER (pos <= 10) i_cut,
    sum(label / log2(pos + 1)) i_all FROM gr GROUP BY qid""")
part("pq", "ev jr ideal", """SELECT run_id, qid,
    coalesce(sum((pow(2, label) - 1) / log2(rank + 1)) FILTER (rank <= 10) / nullif(any_value(i_exp), 0), 0) ndcg_exp_10,
    coalesce(sum((pow(2, label) - 1) / log2(cond_rank + 1)) FILTER (cond_rank <= 10) / nullif(any_value(i_exp), 0), 0) condensed_ndcg_10,
    coalesce(sum(label / log2(rank + 1)) FILTER (rank <= 10) / nullif(any_value(i_cut), 0), 0) ndcg_cut_10,
    coalesce(sum(label / log2(rank + 1)) / nullif(any_value(i_all), 0), 0) ndcg,
    count(did) FILTER (rank <= 10) / 10 judged_10, count(did) FILTER (rank <= 20) / 20 judged_20,
    count(did) FILTER (rank <= 50) / 50 judged_50, count(did) FILTER (rank <= 100) / 100 judged_100,
    coalesce(count(did) FILTER (rank <= 10 AND label >= 1) / nullif(any_value(n_rel), 0), 0) recall_10,
    coalesce(count(did) FILTER (rank <= 100 AND label >= 1) / nullif(any_value(n_rel), 0), 0) recall_100,
    coalesce(count(did) FILTER (rank <= 1000 AND label >= 1) / nullif(any_value(n_rel), 0), 0) recall_1000,
    coalesce(1.0 / min(rank) FILTER (label >= 1), 0) recip_rank,
    coalesce(sum(rel_upto / rank) FILTER (label >= 1) / nullif(any_value(n_rel), 0), 0) map,
    coalesce(sum(1 - non_upto / least(n_rel, n_non)) FILTER (label >= 1 AND least(n_rel, n_non) > 0) / nullif(any_value(n_rel), 0), 0) bpref,
    coalesce(sum(1 - least(non_upto, least(n_rel, n_non)) / least(n_rel, n_non)) FILTER (label >= 1 AND least(n_rel, n_non) > 0) / nullif(any_value(n_rel), 0), 0) bpref_capped
    FROM ev JOIN ideal USING (qid) LEFT JOIN jr USING (run_id, qid) GROUP BY run_id, qid""")


def _one(name, metric, col=None):
    col = col or metric.replace("@", "_")

    @query(name, "pq", f"SELECT run_id, qid, round({col}, 6) {col} FROM pq")
    def run_query(spark, sf):
        return rounded(M.query_metrics(fx.runs(spark, sf), fx.gold(spark, sf), [metric]))


_one("ndcg_exp", "ndcg_exp@10")
_one("condensed_ndcg", "condensed_ndcg@10")
_one("bpref", "bpref")
_one("average_precision_map", "map")
_one("recip_rank", "recip_rank")


@query("bpref_capped", "pq", "SELECT run_id, qid, round(bpref_capped, 6) bpref FROM pq")
def bpref_capped(spark, sf):
    return rounded(M.query_metrics(fx.runs(spark, sf), fx.gold(spark, sf), ["bpref"], cap_bpref=True))


@query("judged_at_k", "pq", """SELECT run_id, qid, round(judged_10, 6) judged_10, round(judged_20, 6) judged_20,
    round(judged_50, 6) judged_50, round(judged_100, 6) judged_100 FROM pq""")
def judged_at_k(spark, sf):
    return rounded(M.query_metrics(fx.runs(spark, sf), fx.gold(spark, sf), [f"judged@{k}" for k in M.JUDGED_CUTS]))


CLASSIC = "recip_rank map recall_10 recall_100 recall_1000 ndcg ndcg_cut_10".split()


@query("classic_metrics", "pq", f"SELECT run_id, qid, {', '.join(f'round({c}, 6) {c}' for c in CLASSIC)} FROM pq")
def classic_metrics(spark, sf):
    return rounded(M.evaluate(fx.runs(spark, sf), fx.gold(spark, sf), "classic"))


@query("multi_run_eval", "pq", f"""SELECT run_id, count(*) n_queries, {', '.join(f'round(avg({c}), 6) {c}' for c in CLASSIC)}
    FROM pq GROUP BY run_id""")
def multi_run_eval(spark, sf):
    return rounded(M.mean_metrics(M.evaluate(fx.runs(spark, sf), fx.gold(spark, sf), "classic")))


@query("ranks_from_scores", "jr", "SELECT run_id, qid, did, CAST(rank AS INT) rank, label FROM jr")
def ranks_from_scores(spark, sf):
    """Ranks of judged documents in runs that come without ranks."""
    return M.judged_rows(fx.runs(spark, sf).drop("rank"), fx.gold(spark, sf))


@query("metric_deltas", "pq", """SELECT run_id, qid, round(bpref - ndcg_exp_10, 6) bpref_minus_ndcg,
    round(condensed_ndcg_10 - ndcg_exp_10, 6) condensed_minus_ndcg FROM pq""")
def metric_deltas(spark, sf):
    pq = M.query_metrics(fx.runs(spark, sf), fx.gold(spark, sf), ["bpref", "ndcg_exp@10", "condensed_ndcg@10"])
    return rounded(M.metric_deltas(pq))


@query("completeness_summary", "pq", """SELECT run_id, count(*) n_queries, round(avg(ndcg_exp_10), 6) ndcg_exp_10,
    round(avg(condensed_ndcg_10), 6) condensed_ndcg_10, round(avg(bpref), 6) bpref, round(avg(judged_10), 6) judged_10,
    round(avg(judged_20), 6) judged_20, round(avg(judged_50), 6) judged_50, round(avg(judged_100), 6) judged_100
    FROM pq GROUP BY run_id""")
def completeness_summary(spark, sf):
    return rounded(M.mean_metrics(M.evaluate(fx.runs(spark, sf), fx.gold(spark, sf), "completeness")))


@query("run_delta", "pq", """SELECT qid, round(x.map, 6) a, round(y.map, 6) b, round(y.map - x.map, 6) delta
    FROM pq x JOIN pq y USING (qid) WHERE x.run_id = 'a' AND y.run_id = 'c'""")
def run_delta(spark, sf):
    pq = M.query_metrics(fx.runs(spark, sf), fx.gold(spark, sf), ["map"])
    return rounded(M.run_delta(pq, "map", "a", "c"))


MRR_SQL = """SELECT run_id, round(coalesce(rr, 0) / (SELECT count(DISTINCT qid) FROM {ref}), 6) mrr, queries_ranked FROM
    (SELECT run_id, count(DISTINCT qid) queries_ranked FROM runs GROUP BY run_id) LEFT JOIN
    (SELECT run_id, sum(rr) rr FROM (SELECT run_id, qid, 1.0 / min(rank) rr FROM runs JOIN {ref} USING (qid, did)
    WHERE rank <= 10 AND {pos} GROUP BY run_id, qid) GROUP BY run_id) USING (run_id)"""
part("binary_gold", "gold", "SELECT qid, did, CAST(label = 3 AS INT) AS label FROM gold")


@query("official_mrr", "runs gold", MRR_SQL.format(ref="gold", pos="label >= 2"))
def official_mrr(spark, sf):
    return rounded(M.official_mrr(fx.runs(spark, sf), fx.gold(spark, sf)), ("run_id", "queries_ranked"))


@query("official_mrr_binary", "runs binary_gold", MRR_SQL.format(ref="binary_gold", pos="label = 1"))
def official_mrr_binary(spark, sf):
    ref = fx.gold(spark, sf).withColumn("label", (F.col("label") == 3).cast("int"))
    return rounded(M.official_mrr(fx.runs(spark, sf), ref), ("run_id", "queries_ranked"))


@query("duplicate_run_rows", "runs", """SELECT 'all' run_id, qid, did, count(*) n FROM runs WHERE did <> '0'
    GROUP BY qid, did HAVING count(*) > 1""")
def duplicate_run_rows(spark, sf):
    return M.duplicate_run_rows(fx.runs(spark, sf).withColumn("run_id", F.lit("all")))


part("scored", "run_c gold", """SELECT qid, did, run_c.rank, score, coalesce(label, 0) AS label FROM run_c
    LEFT JOIN gold USING (qid, did)""")
part("tied", "scored", """SELECT qid, score, count(*) c, avg(label) g,
    coalesce(sum(count(*)) OVER (PARTITION BY qid ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b
    FROM scored GROUP BY qid, score""")


def _scored(spark, sf):
    return fx.run_c(spark, sf).join(fx.gold(spark, sf), ["qid", "did"], "left").select(
        "run_id", "qid", "did", "rank", "score", F.coalesce("label", F.lit(0)).alias("label"))


@query("ltr_ndcg", "tied scored", """SELECT qid, round(coalesce(d / nullif(i, 0), 0), 6) ltr_ndcg_10 FROM
    (SELECT qid, sum(g * s) d FROM (SELECT qid, g, list_sum(list_transform(range(CAST(b AS BIGINT) + 1, CAST(least(b + c, 10) AS BIGINT) + 1),
    lambda p: 1 / log2(p + 1))) s FROM tied) GROUP BY qid) LEFT JOIN
    (SELECT qid, sum(label / log2(p + 1)) i FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY label DESC, did) p
    FROM scored) WHERE p <= 10 GROUP BY qid) USING (qid)""")
def ltr_ndcg(spark, sf):
    return rounded(M.tied_ndcg(_scored(spark, sf), 10))


@query("ltr_mrr_recall", "scored", """SELECT 'c' run_id, qid, round(coalesce(1.0 / min(rank) FILTER (label >= 2 AND rank <= 5), 0), 6) ltr_mrr_5,
    round(coalesce(count_if(label >= 2 AND rank <= 5) / nullif(count_if(label >= 2), 0), 0), 6) ltr_recall_5 FROM scored GROUP BY qid""")
def ltr_mrr_recall(spark, sf):
    scored = _scored(spark, sf)
    return rounded(M.ltr_rank_metrics(scored.drop("label"), scored.select("qid", "did", "label"), 5))


part("judged_scores", "gold runs", "SELECT run_id, qid, label >= 2 AS pos, score FROM gold JOIN runs USING (qid, did)")


@query("pairwise_accuracy", "judged_scores", """SELECT run_id, count(*) n_pairs, round(avg(CAST(p.score > n.score AS INT)), 6) pairwise_accuracy
    FROM judged_scores p JOIN judged_scores n USING (run_id, qid) WHERE p.pos AND NOT n.pos GROUP BY run_id""")
def pairwise_accuracy(spark, sf):
    """Every judged positive of a query's list against every judged negative of it: a bounded product per list."""
    rows = fx.runs(spark, sf).join(fx.gold(spark, sf), ["qid", "did"])
    pos = rows.where(F.col("label") >= 2).select("run_id", "qid", F.col("score").alias("score_pos"))
    neg = rows.where(F.col("label") < 2).select("run_id", "qid", F.col("score").alias("score_neg"))
    return rounded(M.pairwise_accuracy(pos.join(neg, ["run_id", "qid"]), ["run_id"]), ("run_id", "n_pairs"))


part("dense_same", "run_dense vecs", """SELECT qid, did, q.label = d.label AS same, round(list_dot_product(q.v, d.v)
    / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 9) s FROM run_dense JOIN vecs q ON q.id = qid JOIN vecs d ON d.id = did""")


@query("triplet_accuracy", "dense_same", """SELECT count(*) n_pairs, round(avg(CAST(p.s > n.s AS INT)), 6) pairwise_accuracy
    FROM dense_same p JOIN dense_same n USING (qid) WHERE p.same AND NOT n.same""")
def triplet_accuracy(spark, sf):
    """In every vector's list, each neighbour of its own label against each of another: a bounded product per list."""
    label = fx.vectors(spark, sf).select("id", "label")
    rows = fx.run_dense(spark, sf).select("qid", "did").join(
        label.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").join(
        label.select(F.col("id").alias("did"), F.col("label").alias("dl")), "did")
    side = lambda same, name: rows.where((F.col("ql") == F.col("dl")) == same).select(
        F.col("qid").alias("anchor"), F.col("did").alias(name))
    triplets = side(True, "positive").join(side(False, "negative"), "anchor")
    return rounded(M.triplet_accuracy(triplets, fx.vectors(spark, sf)), ("n_pairs",))


@query("graded_pair_accuracy", "scored", """SELECT x.qid, count_if(x.score > y.score) won, count(*) n_pairs,
    round(count_if(x.score > y.score) / count(*), 6) pairwise_accuracy
    FROM scored x JOIN scored y ON x.qid = y.qid AND x.label > y.label GROUP BY x.qid""")
def graded_pair_accuracy(spark, sf):
    out = M.graded_pair_accuracy(_scored(spark, sf)).where(F.col("n_pairs") > 0)
    return out.select("qid", "won", "n_pairs", F.round("pairwise_accuracy", 6).alias("pairwise_accuracy"))


@query("average_precision", "scored", """SELECT qid, CAST(sum(p) AS BIGINT) n_pos, round(sum(p * cp / cc) / nullif(sum(p), 0), 6) average_precision FROM
    (SELECT qid, p, sum(p) OVER w cp, sum(c) OVER w cc FROM (SELECT qid, score, count(*) c, count_if(label >= 2) p FROM scored
    GROUP BY qid, score) WINDOW w AS (PARTITION BY qid ORDER BY score DESC)) GROUP BY qid""")
def average_precision(spark, sf):
    scored = _scored(spark, sf).withColumn("label", (F.col("label") >= 2).cast("int"))
    return rounded(M.average_precision(scored, ["qid"]), ("qid", "n_pos"))


@query("rerank_eval", "run_dense vecs", """SELECT round(avg(rr), 6) recip_rank, round(avg(r1), 6) recall_1 FROM
    (SELECT qid, coalesce(1.0 / min(rank) FILTER (q.label = d.label), 0) rr, CAST(bool_or(rank = 1 AND q.label = d.label) AS INT) r1
    FROM run_dense JOIN vecs q ON q.id = qid JOIN vecs d ON d.id = did GROUP BY qid)""")
def rerank_eval(spark, sf):
    """Dense neighbours, where a neighbour of the same class is the relevant one."""
    run = fx.run_dense(spark, sf)
    lab = fx.vectors(spark, sf)
    judged = run.join(lab.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").join(
        lab.select(F.col("id").alias("did"), F.col("label").alias("dl")), "did")
    per_q = judged.groupBy("qid").agg(
        F.coalesce(1.0 / F.min(F.when(F.col("ql") == F.col("dl"), F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.max(((F.col("rank") == 1) & (F.col("ql") == F.col("dl"))).cast("int")).alias("r1"))
    return per_q.agg(F.round(F.avg("rr"), 6).alias("recip_rank"), F.round(F.avg("r1"), 6).alias("recall_1"))


@query("retrieve_and_evaluate", "pq", f"""SELECT run_id, count(*) n_queries, {', '.join(f'round(avg({c}), 6) {c}' for c in CLASSIC)}
    FROM pq WHERE run_id = 'a' GROUP BY run_id""")
def retrieve_and_evaluate(spark, sf):
    """Retrieve, cut and score in one plan."""
    run = R.bm25_run(fx.corpus(spark, sf), fx.queries(spark, sf), k=fx.RUN_DEPTH).withColumn("run_id", F.lit("a"))
    return rounded(M.mean_metrics(M.evaluate(run, fx.gold(spark, sf), "classic")))


@query("overlap_report", "runs gold", """SELECT run_id, count(DISTINCT qid) run_queries,
    count(DISTINCT qid) FILTER (qid IN (SELECT qid FROM gold)) judged_queries, count(*) run_rows, count(g.label) judged_rows
    FROM runs LEFT JOIN gold g USING (qid, did) GROUP BY run_id""")
def overlap_report(spark, sf):
    gold = fx.gold(spark, sf)
    known = gold.select("qid").distinct().withColumn("known", F.lit(1))
    rows = fx.runs(spark, sf).join(gold, ["qid", "did"], "left").join(known, "qid", "left")
    return rows.groupBy("run_id").agg(
        F.count_distinct("qid").alias("run_queries"),
        F.count_distinct(F.when(F.col("known") == 1, F.col("qid"))).alias("judged_queries"),
        F.count(F.lit(1)).alias("run_rows"), F.count("label").alias("judged_rows"))
