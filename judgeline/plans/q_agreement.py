"""Queries on agreement, reliability, difficulty and resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgeline.functions.text import SUMMARY_SECTIONS, extract_numbers, extract_section, section_flags
from judgeline.operators import agreement as A
from judgeline.operators import difficulty as D
from judgeline.operators import metrics as M
from judgeline.plans import fixtures as fx
from judgeline.plans.registry import query
from judgeline.plans.sqlparts import part
from judgeline.session import written

KEEP = {"qid", "n", "label", "support", "n_queries", "n_f1_zero", "n_weak_kappa", "feature", "metric", "quartile"}


def r6(df, *more):
    return df.select(*[c if c in KEEP or c in more else F.round(c, 6).alias(c) for c in df.columns])


def binary_pairs(spark, sf):
    both = A.join_gold_pred(fx.gold(spark, sf), fx.pred(spark, sf))
    return both.select("qid", "did", (F.col("gold") >= 2).cast("int").alias("gold"), (F.col("pred") >= 2).cast("int").alias("pred"))


part("gp", "gold pred", "SELECT qid, did, g.label gold, p.label pred FROM gold g JOIN pred p USING (qid, did)")
part("bp", "gp", "SELECT qid, did, CAST(gold >= 2 AS INT) gold, CAST(pred >= 2 AS INT) pred FROM gp")
# quality and toxic of the labelled documents, two binary raters; one query per source.
part("lb", "", """SELECT source qid, quality gold, toxic pred FROM labels JOIN documents USING (doc_id)""")


def _margins(src, keys):
    k = keys + ", " if keys else ""
    return f"""SELECT {k}label, sum(g) gold_n, sum(p) pred_n, sum(b) both_n FROM (
        SELECT {k}gold AS label, 1 g, 0 p, CAST(gold = pred AS INT) b FROM {src} UNION ALL
        SELECT {k}pred AS label, 0, 1, 0 FROM {src}) GROUP BY {k}label"""


def _metrics(src, keys):
    k = keys + ", " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}CAST(n AS BIGINT) n, round(same / n, 6) accuracy, round(coalesce(pb / nullif(pp, 0), 0), 6) AS precision,
        round(coalesce(pb / nullif(pg, 0), 0), 6) recall, round(coalesce(2 * pb / nullif(pg + pp, 0), 0), 6) f1,
        round(macro_precision, 6) macro_precision, round(macro_recall, 6) macro_recall, round(macro_f1, 6) macro_f1,
        round((n * same - gp) / nullif(n * n - gp, 0), 6) kappa,
        round(1 - (2 * n - 1) * 2 * (n - same) / nullif(4 * n * n - sq, 0), 6) alpha
        FROM (SELECT {k}CAST(sum(gold_n) AS DOUBLE) n, CAST(sum(both_n) AS DOUBLE) same, CAST(sum(gold_n * pred_n) AS DOUBLE) gp,
        CAST(sum((gold_n + pred_n) * (gold_n + pred_n)) AS DOUBLE) sq,
        coalesce(sum(gold_n) FILTER (label = 1), 0) pg, coalesce(sum(pred_n) FILTER (label = 1), 0) pp, coalesce(sum(both_n) FILTER (label = 1), 0) pb,
        avg(coalesce(both_n / nullif(pred_n, 0), 0)) macro_precision, avg(coalesce(both_n / nullif(gold_n, 0), 0)) macro_recall,
        avg(coalesce(2 * both_n / nullif(gold_n + pred_n, 0), 0)) macro_f1 FROM ({_margins(src, keys)}) {grp})"""


part("bpq", "bp", _metrics("bp", "qid"))


@query("confusion_matrix", "gp", "SELECT gold, pred, count(*) n FROM gp GROUP BY gold, pred")
def confusion_matrix(spark, sf):
    return A.confusion(A.join_gold_pred(fx.gold(spark, sf), fx.pred(spark, sf)))


@query("classification_metrics", "bp", _metrics("bp", ""))
def classification_metrics(spark, sf):
    return r6(A.agreement_metrics(binary_pairs(spark, sf)))


@query("classification_metrics_graded", "gp", _metrics("gp", ""))
def classification_metrics_graded(spark, sf):
    return r6(A.agreement_metrics(A.join_gold_pred(fx.gold(spark, sf), fx.pred(spark, sf))))


@query("classification_metrics_per_query", "bpq", "SELECT * FROM bpq")
def classification_metrics_per_query(spark, sf):
    return r6(A.agreement_metrics(binary_pairs(spark, sf), ["qid"]))


@query("class_report", "gp", f"""SELECT label, round(coalesce(both_n / nullif(pred_n, 0), 0), 6) AS precision,
    round(coalesce(both_n / nullif(gold_n, 0), 0), 6) recall, round(coalesce(2 * both_n / nullif(gold_n + pred_n, 0), 0), 6) f1,
    CAST(gold_n AS BIGINT) support FROM ({_margins('gp', '')})""")
def class_report(spark, sf):
    return r6(A.class_report(A.join_gold_pred(fx.gold(spark, sf), fx.pred(spark, sf))))


@query("rater_agreement_labels", "lb", _metrics("lb", "qid"))
def rater_agreement_labels(spark, sf):
    """Both label columns of the documents as raters, one group per source."""
    pairs = fx.read(spark, sf, "labels").join(fx.read(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("qid"), F.col("quality").alias("gold"), F.col("toxic").alias("pred"))
    return r6(A.agreement_metrics(pairs, ["qid"]))


@query("cohen_kappa", "bpq", "SELECT qid, kappa FROM bpq")
def cohen_kappa(spark, sf):
    return r6(A.agreement_metrics(binary_pairs(spark, sf), ["qid"]).select("qid", "kappa"))


@query("krippendorff_alpha", "bpq", "SELECT qid, alpha FROM bpq")
def krippendorff_alpha(spark, sf):
    return r6(A.agreement_metrics(binary_pairs(spark, sf), ["qid"]).select("qid", "alpha"))


part("bpq_raw", "bp", _metrics("bp", "qid").replace(", 6)", ", 15)"))


@query("agreement_summary", "bpq_raw", """SELECT count(*) n_queries, round(avg(f1), 6) mean_f1, round(avg(kappa), 6) mean_kappa,
    round(avg(alpha), 6) mean_alpha, count_if(f1 = 0) n_f1_zero, count_if(kappa < 0.2) n_weak_kappa FROM bpq_raw""")
def agreement_summary(spark, sf):
    return r6(A.agreement_summary(A.agreement_metrics(binary_pairs(spark, sf), ["qid"])))


@query("join_gold_pred", "gp", "SELECT qid, did, gold, pred FROM gp")
def join_gold_pred(spark, sf):
    return A.join_gold_pred(fx.gold(spark, sf), fx.pred(spark, sf))


@query("pair_coverage", "gold pred", """SELECT count(g.label) FILTER (p.label IS NOT NULL) n_both, count(*) FILTER (p.label IS NULL) n_gold_only,
    count(*) FILTER (g.label IS NULL) n_pred_only FROM gold g FULL JOIN pred p USING (qid, did)""")
def pair_coverage(spark, sf):
    return A.pair_coverage(fx.gold(spark, sf), fx.pred(spark, sf))


@query("align_annotators", "raters", "SELECT qid, did, r1 label_a, r2 label_b FROM raters")
def align_annotators(spark, sf):
    rows = fx.raters(spark, sf)
    return A.align_annotators(
        rows.select("qid", "did", F.col("r1").alias("label")), rows.select("qid", "did", F.col("r2").alias("label")))


@query("align_annotators_lenient", "gold pred", """SELECT qid, did, g.label label_a, p.label label_b
    FROM gold g FULL JOIN pred p USING (qid, did)""")
def align_annotators_lenient(spark, sf):
    return A.align_annotators(fx.gold(spark, sf), fx.pred(spark, sf), strict=False)


def _rater(spark, sf, name):
    return fx.raters(spark, sf).select("qid", "did", F.col(name).alias("label"))


@query("ensemble_join", "gold raters pred", """SELECT qid, did, g.label gold, r2 v1, r3 v2, p.label v3
    FROM gold g JOIN raters USING (qid, did) JOIN pred p USING (qid, did)""")
def ensemble_join(spark, sf):
    out = A.ensemble_join(fx.gold(spark, sf), [_rater(spark, sf, "r2"), _rater(spark, sf, "r3"), fx.pred(spark, sf)])
    return out.select("qid", "did", "gold", *[F.element_at("votes", i).alias(f"v{i}") for i in (1, 2, 3)])


@query("ensemble_dropped", "gold raters pred", """SELECT qid, did, g.label gold, concat_ws(',', CASE WHEN r2 IS NULL THEN '1' END,
    CASE WHEN r3 IS NULL THEN '2' END, CASE WHEN p.label IS NULL THEN '3' END) missing
    FROM gold g LEFT JOIN raters USING (qid, did) LEFT JOIN pred p USING (qid, did) WHERE r2 IS NULL OR r3 IS NULL OR p.label IS NULL""")
def ensemble_dropped(spark, sf):
    out = A.ensemble_dropped(fx.gold(spark, sf), [_rater(spark, sf, "r2"), _rater(spark, sf, "r3"), fx.pred(spark, sf)])
    return out.withColumn("missing", F.array_join("missing", ","))


part("ens", "gold raters pred", """SELECT qid, did, g.label gold, unnest([r2, r3, p.label]) v
    FROM gold g JOIN raters USING (qid, did) JOIN pred p USING (qid, did)""")
part("maj", "ens", """SELECT qid, did, gold, CASE WHEN count(*) FILTER (c = mx) > 1 THEN 0 ELSE max(v) FILTER (c = mx) END pred
    FROM (SELECT *, max(c) OVER (PARTITION BY qid, did) mx FROM (SELECT qid, did, any_value(gold) gold, v, count(*) c FROM ens GROUP BY qid, did, v))
    GROUP BY qid, did, gold""")


@query("majority_vote", "maj", "SELECT qid, did, gold, pred FROM maj")
def majority_vote(spark, sf):
    out = A.ensemble_join(fx.gold(spark, sf), [_rater(spark, sf, "r2"), _rater(spark, sf, "r3"), fx.pred(spark, sf)])
    return out.select("qid", "did", "gold", A.majority_label(F.col("votes")).alias("pred"))


part("ent", "gold", """SELECT *, greatest(n_0, n_1, n_2, n_3) / n purity,
    CASE greatest(n_0, n_1, n_2, n_3) WHEN n_0 THEN 0 WHEN n_1 THEN 1 WHEN n_2 THEN 2 ELSE 3 END majority,
    -list_sum(list_transform([n_0, n_1, n_2, n_3], lambda c: CASE WHEN c > 0 THEN c / n * log2(c / n) ELSE 0 END)) entropy
    FROM (SELECT qid, count_if(label = 0) n_0, count_if(label = 1) n_1, count_if(label = 2) n_2, count_if(label = 3) n_3, count(*) n
    FROM gold GROUP BY qid)""")


@query("label_entropy", "ent", "SELECT qid, n_0, n_1, n_2, n_3, n, round(entropy, 6) entropy, round(purity, 6) purity, majority FROM ent")
def label_entropy(spark, sf):
    return r6(A.label_entropy(fx.gold(spark, sf)), "n_0", "n_1", "n_2", "n_3", "majority")


@query("entropy_summary", "ent", """SELECT round(avg(entropy), 6) mean_entropy, round(median(entropy), 6) median_entropy,
    round(max(entropy), 6) max_entropy, round(avg(purity), 6) mean_purity FROM ent""")
def entropy_summary(spark, sf):
    return r6(A.entropy_summary(A.label_entropy(fx.gold(spark, sf))))


@query("entropy_top", "ent", "SELECT qid, n, round(entropy, 6) entropy FROM ent ORDER BY entropy DESC, n DESC, qid LIMIT 5")
def entropy_top(spark, sf):
    """The five queries with the most mixed judgments (a top-k report)."""
    ent = A.label_entropy(fx.gold(spark, sf)).orderBy(F.col("entropy").desc(), F.col("n").desc(), "qid").limit(5)
    return r6(ent.select("qid", "n", "entropy"))


@query("label_distribution", "gold", """SELECT qid, count_if(label <= 1) n_neg, count_if(label >= 2) n_pos,
    round(count_if(label <= 1) / nullif(count_if(label >= 2), 0), 6) neg_per_pos FROM gold GROUP BY qid""")
def label_distribution(spark, sf):
    return r6(A.label_distribution(fx.gold(spark, sf)), "n_neg", "n_pos")


@query("label_counts_pivot", "gold", """SELECT qid, count_if(label = 0) n_0, count_if(label = 1) n_1, count_if(label = 2) n_2,
    count_if(label = 3) n_3 FROM gold GROUP BY qid""")
def label_counts_pivot(spark, sf):
    wide = fx.gold(spark, sf).groupBy("qid").pivot("label", [0, 1, 2, 3]).count().fillna(0)
    return wide.select("qid", *[F.col(str(i)).alias(f"n_{i}") for i in range(4)])


@query("annotation_counts", "gold", "SELECT qid, count(*) n, CAST(count(*) < 30 AS INT) below FROM gold GROUP BY qid")
def annotation_counts(spark, sf):
    n = F.count(F.lit(1))
    return fx.gold(spark, sf).groupBy("qid").agg(n.alias("n"), (n < 30).cast("int").alias("below"))


# --- difficulty ------------------------------------------------------------------------------------------------

LET = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"
part("ldocs", "", f"SELECT CAST(doc_id AS VARCHAR) did, list_transform(regexp_extract_all(text, '{LET}'), lambda x: lower(x)) toks FROM documents")
part("lqs", "", f"SELECT CAST(item_id AS VARCHAR) qid, list_transform(regexp_extract_all(text, '{LET}'), lambda x: lower(x)) toks FROM benchmark")
part("lstat", "ldocs", """SELECT term, count(*) df, sum(tf) cf FROM (SELECT did, term, count(*) tf FROM (SELECT did, unnest(toks) term FROM ldocs)
    GROUP BY did, term) GROUP BY term""")
part("ltot", "ldocs", "SELECT count(*) n, sum(len(toks)) t FROM ldocs")
part("feat", "lqs lstat ltot", """SELECT qid, any_value(ql) q_len, count(*) n_unique, avg(idf) avg_idf, sum(idf) sum_idf, max(idf) max_idf,
    sum(pq * ln(pq / greatest(cf / t, 1e-12))) clarity FROM (SELECT qid, ql, qtf / ql pq, coalesce(cf, 0) cf, t,
    ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) idf FROM (SELECT qid, term, count(*) qtf, any_value(ql) ql FROM
    (SELECT qid, len(toks) ql, unnest(toks) term FROM lqs) GROUP BY qid, term) LEFT JOIN lstat USING (term), ltot) GROUP BY qid""")


@query("query_features", "feat", """SELECT qid, q_len, n_unique, round(avg_idf, 6) avg_idf, round(sum_idf, 6) sum_idf, round(max_idf, 6) max_idf,
    round(clarity, 6) clarity FROM feat""")
def query_features(spark, sf):
    return r6(D.query_features(fx.corpus(spark, sf), fx.queries(spark, sf)), "q_len", "n_unique")


part("dtab", "feat pq", "SELECT feat.*, ndcg_exp_10, bpref FROM feat JOIN pq USING (qid) WHERE run_id = 'a'")
FEATURES = ["q_len", "n_unique", "avg_idf", "sum_idf", "max_idf", "clarity"]


def difficulty_table(spark, sf):
    pq = M.query_metrics(fx.run_a(spark, sf), fx.gold(spark, sf), ["ndcg_exp@10", "bpref"]).drop("run_id")
    table = D.query_features(fx.corpus(spark, sf), fx.queries(spark, sf)).join(pq, "qid")
    return written(table, "difficulty")  # read more than once


def _corr(f, m):
    return f"""SELECT '{f}' feature, '{m}' metric, count(*) n,
        round(covar_pop({f}, {m}) / nullif(stddev_pop({f}) * stddev_pop({m}), 0), 6) pearson,
        round(covar_pop({f}, {m}) / nullif(var_pop({f}), 0), 6) slope,
        round(avg({m}) - covar_pop({f}, {m}) / nullif(var_pop({f}), 0) * avg({f}), 6) intercept FROM dtab"""


@query("feature_correlation", "dtab", " UNION ALL ".join(_corr(f, m) for f in FEATURES for m in ("ndcg_exp_10", "bpref")))
def feature_correlation(spark, sf):
    return r6(D.feature_correlation(difficulty_table(spark, sf), FEATURES, ["ndcg_exp_10", "bpref"]))


@query("quartile_effect", "dtab", """SELECT CASE WHEN avg_idf <= q[1] THEN 1 WHEN avg_idf <= q[2] THEN 2 WHEN avg_idf <= q[3] THEN 3 ELSE 4 END quartile,
    count(*) n, round(avg(ndcg_exp_10), 6) ndcg_exp_10, round(avg(bpref), 6) bpref FROM dtab,
    (SELECT quantile_cont(avg_idf, [0.25, 0.5, 0.75]) q FROM dtab) GROUP BY 1""")
def quartile_effect(spark, sf):
    return r6(D.quartile_effect(difficulty_table(spark, sf), "avg_idf", ["ndcg_exp_10", "bpref"]))


# --- resampling ------------------------------------------------------------------------------------------------

HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
part("qi", "pq", "SELECT qid, ndcg_exp_10 v, row_number() OVER (ORDER BY qid) - 1 i, count(*) OVER () n FROM pq WHERE run_id = 'a'")
part("boot", "qi", f"""SELECT b, avg(y.v) m FROM (SELECT b, {HASH.format("concat_ws('|', '42', b, i)")} % n j FROM qi, range(2000) r(b)) x
    JOIN qi y ON y.i = x.j GROUP BY b""")


@query("bootstrap_ci", "boot qi", """SELECT round((SELECT avg(v) FROM qi), 6) mean, round(quantile_cont(m, 0.025), 6) low,
    round(quantile_cont(m, 0.975), 6) high FROM boot""")
def bootstrap_ci(spark, sf):
    pq = M.query_metrics(fx.run_a(spark, sf), fx.gold(spark, sf), ["ndcg_exp@10"])
    return r6(D.bootstrap_ci(written(pq, "scores"), "ndcg_exp_10"))


part("dl", "pq", "SELECT qid, y.map - x.map d FROM pq x JOIN pq y USING (qid) WHERE x.run_id = 'a' AND y.run_id = 'b'")
part("flips", "dl", f"""SELECT rep, avg(d * CASE WHEN {HASH.format("concat_ws('|', '42', rep, qid)")} % 2 = 0 THEN 1 ELSE -1 END) m
    FROM dl, range(10000) r(rep) GROUP BY rep""")


@query("paired_randomization", "flips dl", """SELECT round(o, 6) observed, count_if(round(abs(m), 9) >= round(abs(o), 9)) hits,
    round((count_if(round(abs(m), 9) >= round(abs(o), 9)) + 1) / 10001, 6) p_value FROM flips, (SELECT avg(d) o FROM dl) GROUP BY o""")
def paired_randomization(spark, sf):
    pq = M.query_metrics(fx.runs(spark, sf), fx.gold(spark, sf), ["map"])
    return r6(D.paired_randomization(written(M.run_delta(pq, "map", "a", "b"), "deltas")), "hits")


# --- similarity and text quality -------------------------------------------------------------------------------

PUNCT = r"list_distinct(list_filter(string_split_regex(translate(lower(text), '¿?¡!,.:;', '        '), '\s+'), lambda x: x <> ''))"
part("psets", "gold", f"""SELECT qid, did, label, q, d, len(list_intersect(q, d)) b FROM gold
    JOIN (SELECT CAST(item_id AS VARCHAR) qid, {PUNCT} q FROM benchmark) USING (qid)
    JOIN (SELECT CAST(doc_id AS VARCHAR) did, {PUNCT} d FROM documents) USING (did)""")
part("psim", "psets", "SELECT qid, did, label, coalesce(b / nullif(len(q), 0), 0) r, coalesce(b / nullif(len(q) + len(d) - b, 0), 0) j FROM psets")


def _similarity(spark, sf):
    pairs = D.pair_token_sets(fx.gold(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf))
    return D.set_similarity(pairs)


@query("token_recall", "psim", "SELECT qid, did, label, round(r, 6) token_recall, round(j, 6) jaccard FROM psim")
def token_recall(spark, sf):
    return r6(_similarity(spark, sf).select("qid", "did", "label", "token_recall", "jaccard"), "did")


@query("token_recall_means", "psim", """SELECT label, count(*) n, round(avg(r), 6) token_recall, round(avg(j), 6) jaccard
    FROM psim GROUP BY GROUPING SETS ((label), ())""")
def token_recall_means(spark, sf):
    return r6(_similarity(spark, sf).groupingSets([[F.col("label")], []], F.col("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("token_recall").alias("token_recall"), F.avg("jaccard").alias("jaccard")))


part("dsj", "gold pred", f"""SELECT dataset, label, q, f, s, len(list_intersect(q, f)) bf, len(list_intersect(q, s)) bs
    FROM (SELECT 'gold' dataset, * FROM gold UNION ALL SELECT 'run', qid, did, label FROM pred)
    LEFT JOIN (SELECT CAST(item_id AS VARCHAR) qid, {PUNCT} q FROM benchmark) USING (qid)
    LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) did, {PUNCT} f, {PUNCT.replace("lower(text)", "lower(split_part(text, chr(10), 1))")} s
        FROM documents) USING (did)""")


@query("overlap_by_dataset", "dsj", """SELECT dataset, label, count(*) n, round(avg(coalesce(bf / nullif(len(q), 0), 0)), 6) token_recall_full,
    round(avg(coalesce(bf / nullif(len(q) + len(f) - bf, 0), 0)), 6) jaccard_full,
    round(avg(coalesce(bs / nullif(len(q), 0), 0)), 6) token_recall_summary,
    round(avg(coalesce(bs / nullif(len(q) + len(s) - bs, 0), 0)), 6) jaccard_summary
    FROM dsj GROUP BY GROUPING SETS ((dataset, label), (dataset))""")
def overlap_by_dataset(spark, sf):
    """Judged pairs and a run's pairs, over whole texts and over their first lines."""
    names = {"gold": fx.gold(spark, sf), "run": fx.pred(spark, sf)}
    judged = written(reduce(DataFrame.unionByName, [
        t.select(F.lit(n).alias("dataset"), "qid", "did", "label") for n, t in names.items()]), "judged")
    asked = fx.queries(spark, sf).select(F.explode(F.array(*map(F.lit, names))).alias("dataset"), "qid", "query")
    corpus = fx.corpus(spark, sf)
    lines = corpus.select("did", F.substring_index("text", "\n", 1).alias("text"))
    return r6(D.overlap_by_dataset(judged, asked, {"full": corpus, "summary": lines}), "dataset")


part("csov", "", r"""SELECT h, n, m FROM (SELECT qid, did, count(*) h FROM
    (SELECT item_id qid, unnest(list_distinct(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) t FROM benchmark) JOIN
    (SELECT doc_id did, unnest(list_distinct(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) t FROM documents) USING (t) GROUP BY qid, did)
    JOIN (SELECT item_id qid, len(list_distinct(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) n FROM benchmark) USING (qid)
    JOIN (SELECT doc_id did, len(list_distinct(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) m FROM documents) USING (did)""")


@query("mean_jaccard_all_pairs", "csov", """SELECT round(sum(h / (n + m - h)) / ((SELECT count(*) FROM benchmark) * (SELECT count(*) FROM documents)), 6)
    mean_jaccard FROM csov""")
def mean_jaccard_all_pairs(spark, sf):
    from judgeline.operators.retrieve import overlap_counts
    corpus, queries = fx.corpus(spark, sf), fx.queries(spark, sf)
    return r6(D.mean_jaccard_all_pairs(overlap_counts(corpus, queries, lower=False), queries, corpus))


part("cites", "", """SELECT CAST(doc_id AS VARCHAR) did, list_distinct(regexp_extract_all('' || n_chars || ', ' || doc_id, '\\d+')) c,
    regexp_extract_all(text, '\\d+') s FROM documents""".replace("\\\\", "\\"))
part("cacc", "cites", "SELECT did, len(list_intersect(c, s)) / nullif(len(c), 0) a FROM cites")


def _summaries(spark, sf):
    """Every document with a citation section that names its length and its number."""
    return fx.read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("did"), "text",
        F.concat(F.lit("Decisión\nCitas relevantes: "), F.col("n_chars").cast("string"), F.lit(", "),
                 F.col("doc_id").cast("string")).alias("summary"))


@query("citation_accuracy", "cacc", "SELECT did, round(a, 6) accuracy FROM cacc")
def citation_accuracy(spark, sf):
    cited = extract_numbers(extract_section("summary", "Citas relevantes"))
    return _summaries(spark, sf).select(
        "did", F.round(D.citation_accuracy(cited, extract_numbers("text")), 6).alias("accuracy"))


@query("citation_accuracy_summary", "cacc", """SELECT count(a) n, round(avg(a), 6) mean, round(min(a), 6) min, round(max(a), 6) max,
    round(stddev_samp(a), 6) std FROM cacc""")
def citation_accuracy_summary(spark, sf):
    cited = extract_numbers(extract_section("summary", "Citas relevantes"))
    acc = _summaries(spark, sf).select(D.citation_accuracy(cited, extract_numbers("text")).alias("a"))
    return r6(acc.agg(F.count("a").alias("n"), F.avg("a").alias("mean"), F.min("a").alias("min"), F.max("a").alias("max"),
                      F.stddev_samp("a").alias("std")))


@query("section_flag_means", "", "SELECT " + ", ".join(
    f"round(avg(CAST(contains(t, '{h}' || chr(10)) AS INT)), 6) has_{i}" for i, h in enumerate(SUMMARY_SECTIONS))
    + ", round(avg(len(regexp_extract_all(t, 'AMBIGUO'))), 6) n_unclear FROM (SELECT 'Decisión' || chr(10) || "
    "CASE WHEN quality = 1 THEN 'Hechos clave' || chr(10) ELSE 'AMBIGUO AMBIGUO' END || text t FROM documents JOIN labels USING (doc_id))")
def section_flag_means(spark, sf):
    rows = fx.read(spark, sf, "documents").join(fx.read(spark, sf, "labels"), "doc_id").select(F.concat(
        F.lit("Decisión\n"), F.when(F.col("quality") == 1, "Hechos clave\n").otherwise("AMBIGUO AMBIGUO"), "text").alias("t"))
    flags = rows.select(*section_flags("t"))
    return flags.agg(*[F.round(F.avg(c), 6).alias(c) for c in flags.columns])


part("jscored", "runs gold", "SELECT run_id, qid, did, score, label FROM runs JOIN gold USING (qid, did) WHERE run_id = 'a'")


def _judged_a(spark, sf):
    return fx.run_a(spark, sf).join(fx.gold(spark, sf), ["qid", "did"])


@query("score_histogram", "jscored", """SELECT relevant, bin, n, round(n / sum(n) OVER (PARTITION BY relevant), 6) AS share FROM
    (SELECT CAST(label >= 2 AS INT) relevant, CAST(least(floor((score - lo) / (hi - lo) * 20), 19) AS INT) bin, count(*) n
    FROM jscored, (SELECT min(score) lo, max(score) hi FROM jscored) GROUP BY 1, 2)""")
def score_histogram(spark, sf):
    return r6(D.score_histogram(_judged_a(spark, sf)), "relevant", "bin")


@query("score_boxes", "jscored", """SELECT CAST(label >= 2 AS INT) relevant, round(min(score), 6) q0, round(quantile_cont(score, 0.25), 6) q1,
    round(quantile_cont(score, 0.5), 6) q2, round(quantile_cont(score, 0.75), 6) q3, round(max(score), 6) q4 FROM jscored GROUP BY 1""")
def score_boxes(spark, sf):
    return r6(D.score_boxes(_judged_a(spark, sf)), "relevant")


@query("score_gaps", "jscored", """SELECT qid, round(coalesce(sum(score) FILTER (label >= 2), 0) - coalesce(sum(score) FILTER (label < 2), 0), 6) sum_gap,
    round(coalesce(avg(score) FILTER (label >= 2), 0) - coalesce(avg(score) FILTER (label < 2), 0), 6) mean_gap FROM jscored GROUP BY qid""")
def score_gaps(spark, sf):
    return r6(D.score_gaps(_judged_a(spark, sf)))
