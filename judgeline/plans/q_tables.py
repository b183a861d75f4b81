"""Queries on filters, joins, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgeline.operators import joins as J
from judgeline.operators import sampling as P
from judgeline.operators import selection as S
from judgeline.operators import setops as O
from judgeline.plans import fixtures as fx
from judgeline.plans.q_training import triplets
from judgeline.plans.registry import query
from judgeline.plans.sqlparts import part

# --- splits and filters ----------------------------------------------------------------------------------------

part("split3", "gold", """SELECT qid, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'dev' ELSE 'test' END split
    FROM (SELECT qid, row_number() OVER (ORDER BY md5('42|' || qid), qid) rn, count(*) OVER () n FROM (SELECT DISTINCT qid FROM gold))""")


def _train(spark, sf):
    return P.freeze_split(fx.gold(spark, sf)).where(F.col("split") == "train")


@query("freeze_split", "split3", "SELECT qid, split FROM split3")
def freeze_split(spark, sf):
    return P.freeze_split(fx.gold(spark, sf))


@query("freeze_split_documents", "docs", """SELECT did qid, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'dev' ELSE 'test' END split
    FROM (SELECT did, row_number() OVER (ORDER BY md5('42|' || did), did) rn, count(*) OVER () n FROM docs)""")
def freeze_split_documents(spark, sf):
    return P.freeze_split(fx.corpus(spark, sf), id_col="did").withColumnRenamed("did", "qid")


@query("two_stage_split", "gold", """SELECT qid, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + ceil((n - t) * 0.1) THEN 'valid' ELSE 'train' END split
    FROM (SELECT *, ceil(n * 0.2) t FROM (SELECT qid, row_number() OVER (ORDER BY md5('42|' || qid), qid) rn, count(*) OVER () n FROM (SELECT DISTINCT qid FROM gold)))""")
def two_stage_split(spark, sf):
    return P.two_stage_split(fx.gold(spark, sf))


@query("filter_qids", "gold split3", "SELECT qid, did, label FROM gold WHERE qid IN (SELECT qid FROM split3 WHERE split = 'train')")
def filter_qids(spark, sf):
    return S.filter_qids(fx.gold(spark, sf), _train(spark, sf))


@query("filter_qrels_pairs", "gold pred", "SELECT qid, did, label FROM gold WHERE (qid, did) IN (SELECT (qid, did) FROM pred)")
def filter_qrels_pairs(spark, sf):
    return S.filter_qrels_pairs(fx.gold(spark, sf), fx.pred(spark, sf))


@query("filter_known_docs", "gold", "SELECT qid, did, label FROM gold WHERE did IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def filter_known_docs(spark, sf):
    known = fx.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("did"))
    return S.filter_known_docs(fx.gold(spark, sf), known)


@query("queries_with_relevant", "gold", "SELECT qid, did, label FROM gold WHERE qid IN (SELECT qid FROM gold WHERE label >= 3)")
def queries_with_relevant(spark, sf):
    return S.qrels_with_relevant(fx.gold(spark, sf), rel=3)


@query("judged_queries", "gold qs", "SELECT qid, query FROM qs WHERE qid IN (SELECT qid FROM gold WHERE label >= 3)")
def judged_queries(spark, sf):
    return S.judged_queries(fx.queries(spark, sf), fx.gold(spark, sf).where(F.col("label") >= 3))


# Generated queries: the sentences of every benchmark text, named by kind in turn.
KINDS = "['corta', 'compleja', 'pregunta', 'otra']"
part("gen", "", f"SELECT item_id || '_' || ({KINDS})[(i - 1) % 4 + 1] || CASE WHEN i > 4 THEN '_' || i ELSE '' END qid, s query, item_id * 1000 + i line_no FROM (SELECT item_id, unnest(string_split(text, '. ')) s, generate_subscripts(string_split(text, '. '), 1) i FROM benchmark)")


def generated(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("corta", "compleja", "pregunta", "otra")])
    rows = fx.read(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("i", "query"))
    tail = F.when(F.col("i") > 3, F.concat(F.lit("_"), (F.col("i") + 1).cast("string"))).otherwise(F.lit(""))
    qid = F.concat(F.col("item_id").cast("string"), F.lit("_"), F.element_at(kinds, F.col("i") % 4 + 1), tail)
    return rows.select(qid.alias("qid"), "query", (F.col("item_id") * 1000 + F.col("i") + 1).alias("line_no"))


@query("filter_suffix", "gen", "SELECT qid, query FROM gen WHERE qid LIKE '%corta'")
def filter_suffix(spark, sf):
    return S.filter_suffix(generated(spark, sf), "corta").select("qid", "query")


@query("split_by_suffix", "gen", """SELECT qid, query, CASE WHEN qid LIKE '%\\_corta' ESCAPE '\\' THEN 'corta' WHEN qid LIKE '%\\_compleja' ESCAPE '\\' THEN 'compleja'
    WHEN qid LIKE '%\\_pregunta' ESCAPE '\\' THEN 'pregunta' END kind FROM gen""")
def split_by_suffix(spark, sf):
    return S.split_by_suffix(generated(spark, sf)).select("qid", "query", "kind")


@query("filter_annotator", "", "SELECT conv_id, turn, role username, text FROM conversations WHERE lower(role) = 'assistant'")
def filter_annotator(spark, sf):
    rows = fx.read(spark, sf, "conversations").withColumnRenamed("role", "username")
    return S.filter_annotator(rows, "Assistant")


@query("keyword_count_by_attr", "", "SELECT source, count(*) n_docs FROM documents WHERE contains(lower(text), 'license') GROUP BY source")
def keyword_count_by_attr(spark, sf):
    return S.keyword_count_by_attr(fx.corpus(spark, sf), "License", "source")


@query("lookup_doc", "", """SELECT '7' did, max(text) text FROM documents WHERE doc_id = 7 UNION ALL
    SELECT 'none', NULL""")
def lookup_doc(spark, sf):
    corpus = fx.corpus(spark, sf)
    return S.lookup_doc(corpus, "7").unionByName(S.lookup_doc(corpus, "none"))


part("evid", "gold qs docs", """SELECT g.qid, g.did, g.label, query evidence, lower(text) t,
    list_transform(list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> ''), lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) w
    FROM gold g JOIN qs USING (qid) JOIN docs USING (did)""")


def _evidence(spark, sf):
    """Every judgment cites its query as evidence."""
    return fx.gold(spark, sf).join(fx.queries(spark, sf), "qid").withColumnRenamed("query", "evidence")


@query("evidence_lexical_qc", "evid", """SELECT qid, did, CASE WHEN label = 0 OR r >= 1 THEN label ELSE 0 END AS label,
    CASE WHEN label = 0 OR r >= 1 THEN evidence ELSE 'Set to 0 due to low lexical match: ' || CAST(r AS VARCHAR) END evidence FROM
    (SELECT *, coalesce(len(list_filter(w, lambda x: x <> '' AND contains(t, x))) / nullif(len(w), 0), 0) r FROM evid)""")
def evidence_lexical_qc(spark, sf):
    return S.evidence_lexical_qc(_evidence(spark, sf), fx.corpus(spark, sf))


@query("evidence_exact_qc", "evid", """SELECT qid, did, CASE WHEN label = 0 OR contains(t, array_to_string(w, ' ')) THEN label ELSE 0 END AS label,
    CASE WHEN label = 0 OR contains(t, array_to_string(w, ' ')) THEN evidence ELSE 'Set to 0 due to no exact match' END evidence FROM evid""")
def evidence_exact_qc(spark, sf):
    return S.evidence_exact_qc(_evidence(spark, sf), fx.corpus(spark, sf))


@query("remap_labels", "gold", "SELECT qid, did, CASE label WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS label FROM gold")
def remap_labels(spark, sf):
    return S.remap_labels(fx.gold(spark, sf), {0: 0, 1: 0, 2: 1, 3: 2})


@query("binarize_labels", "gold", "SELECT qid, did, CAST(label >= 2 AS INT) AS label FROM gold")
def binarize_labels(spark, sf):
    return S.binarize_adaptive(fx.gold(spark, sf))


# --- joins -----------------------------------------------------------------------------------------------------


@query("enrich_pairs", "gold qs docs", "SELECT qid, did, label, query, text FROM gold JOIN qs USING (qid) JOIN docs USING (did)")
def enrich_pairs(spark, sf):
    return J.enrich_pairs(fx.gold(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf))


@query("enrich_pairs_lenient", "gold qs", """SELECT qid, did, label, query, coalesce(text, '') text FROM gold JOIN qs USING (qid)
    LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) did, text FROM documents JOIN labels USING (doc_id)) USING (did)""")
def enrich_pairs_lenient(spark, sf):
    labelled = fx.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("did"))
    corpus = fx.corpus(spark, sf).join(labelled, "did", "left_semi")
    return J.enrich_pairs(fx.gold(spark, sf), fx.queries(spark, sf), corpus, strict=False)


@query("enrich_triplets", "blocks qs docs", """SELECT qid query_id, positive pos_doc_id, negative neg_doc_id, query, p.text pos_text, n.text neg_text,
    CAST(p.text = n.text AS INT) same_text FROM blocks JOIN qs USING (qid) JOIN docs p ON p.did = positive JOIN docs n ON n.did = negative""")
def enrich_triplets(spark, sf):
    return J.enrich_triplets(triplets(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf))


@query("attach_negative_texts", "hardn docs", """SELECT qid, string_agg(text, '||' ORDER BY r) negatives FROM hardn JOIN docs USING (did)
    WHERE r <= 5 GROUP BY qid""")
def attach_negative_texts(spark, sf):
    from judgeline.operators.pooling import hard_negatives
    groups = hard_negatives(fx.run_a(spark, sf), fx.gold(spark, sf).where(F.col("label") >= 2), 15, require_full=False)
    out = J.attach_negative_texts(groups, fx.corpus(spark, sf))
    return out.select("qid", F.array_join("negatives", "||").alias("negatives"))


@query("join_run_qrels", "runs gold", """SELECT run_id, qid, did, rank, coalesce(label, 0) AS label, CAST(label IS NOT NULL AS INT) judged
    FROM runs LEFT JOIN gold USING (qid, did) WHERE qid IN (SELECT qid FROM gold)""")
def join_run_qrels(spark, sf):
    return J.join_run_qrels(fx.runs(spark, sf), fx.gold(spark, sf)).drop("score")


# --- ranks, samples, smoothing ---------------------------------------------------------------------------------

part("grank", "gold", """SELECT qid, did, label, line_no, row_number() OVER (PARTITION BY qid ORDER BY label DESC, line_no) gold_rank
    FROM (SELECT *, CAST(did AS BIGINT) line_no FROM gold)""")


def _lined(spark, sf):
    return fx.gold(spark, sf).withColumn("line_no", F.col("did").cast("long"))


@query("gold_rank", "grank", "SELECT qid, did, gold_rank FROM grank")
def gold_rank(spark, sf):
    return P.gold_rank(_lined(spark, sf)).select("qid", "did", "gold_rank")


@query("disagreement_pairs", "grank run_a", """SELECT qid, did, gold_rank, model_rank, abs_diff FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY abs_diff DESC, gold_rank) n
    FROM (SELECT g.qid, g.did, gold_rank, coalesce(rank, 41) model_rank, abs(gold_rank - coalesce(rank, 41)) abs_diff
    FROM grank g LEFT JOIN run_a a ON a.qid = g.qid AND a.did = g.did)) WHERE n <= 4""")
def disagreement_pairs(spark, sf):
    return P.disagreement_pairs(_lined(spark, sf), fx.run_a(spark, sf), 4)


@query("group_sizes", "", """SELECT event_type, min(event_id) first_line, count(*) n FROM (SELECT event_type, event_id,
    row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) g FROM events) GROUP BY event_type, g""")
def group_sizes(spark, sf):
    return P.group_sizes(fx.read(spark, sf, "events"), "event_type", "event_id")


@query("ema", "", """WITH RECURSIVE evn AS MATERIALIZED (SELECT event_type, event_id, CASE WHEN value > 3 THEN value END v,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id) n FROM events),
    walk AS (SELECT event_type, event_id, n, v, v e FROM evn WHERE n = 1 UNION ALL
    SELECT x.event_type, x.event_id, x.n, x.v, CASE WHEN x.v IS NULL THEN e WHEN e IS NULL THEN x.v ELSE 0.1 * x.v + 0.9 * e END
    FROM walk JOIN evn x ON x.event_type = walk.event_type AND x.n = walk.n + 1)
    SELECT event_type, event_id, round(CASE WHEN v IS NOT NULL THEN e END, 6) ema FROM walk""")
def ema(spark, sf):
    """Small values count as missing."""
    rows = fx.read(spark, sf, "events").select(
        "event_type", "event_id", F.when(F.col("value") > 3, F.col("value")).alias("value"))
    out = P.ema(rows, "value", "event_id", 0.1, ["event_type"], block=F.floor(F.col("event_id") / 256))
    return out.select("event_type", "event_id", F.round("ema", 6).alias("ema"))


@query("sample_per_group", "gold", """SELECT qid, did, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5('42|' || qid || '|' || did), did) n FROM gold)
    WHERE n <= 5""")
def sample_per_group(spark, sf):
    return P.sample_per_group(fx.gold(spark, sf), 5)


@query("shuffle_rows", "docs", "SELECT did, row_number() OVER (ORDER BY md5('42|' || did), did) AS position FROM docs")
def shuffle_rows(spark, sf):
    return P.shuffle_rows(fx.corpus(spark, sf).select("did"), ["did"])


@query("merge_and_shuffle", "gold pred", """SELECT src, qid, did, label, row_number() OVER (ORDER BY md5('42|' || src || '|' || qid || '|' || did), src, qid, did) AS position
    FROM (SELECT 'g' src, qid, did, label FROM gold UNION ALL SELECT 'p', qid, did, label FROM pred)""")
def merge_and_shuffle(spark, sf):
    g = fx.gold(spark, sf).withColumn("src", F.lit("g"))
    p = fx.pred(spark, sf).withColumn("src", F.lit("p"))
    return P.merge_and_shuffle([g, p], ["src", "qid", "did"])


part("dom", "gold", "SELECT DISTINCT qid b FROM gold WHERE label = 3")
part("mixed", "gen dom", """SELECT qid, 1 in_domain FROM gen WHERE split_part(qid, '_', 1) IN (SELECT b FROM dom) UNION ALL
    SELECT qid, 0 FROM (SELECT qid, row_number() OVER (ORDER BY md5('42|' || qid), qid) n FROM gen WHERE split_part(qid, '_', 1) NOT IN (SELECT b FROM dom)
    AND qid NOT LIKE '%otra%') WHERE n <= (SELECT round_even(count(*) * 0.1, 0) FROM gen WHERE split_part(qid, '_', 1) IN (SELECT b FROM dom))""")


@query("mix_domains", "mixed", "SELECT qid, in_domain FROM mixed")
def mix_domains(spark, sf):
    """Generated queries of well-judged passages, and a tenth as many others."""
    gen = generated(spark, sf)
    domain = fx.gold(spark, sf).where(F.col("label") == 3).select(F.col("qid").alias("did"))
    judged = gen.where(~F.contains("qid", F.lit("otra"))).select("qid")
    return P.mix_domains(gen, judged, domain, 0.1)


part("convs", "", "SELECT CAST(conv_id * 1000 + turn AS VARCHAR) qid, text query, conv_id * 1000 + turn line_no FROM conversations")


def _turns(spark, sf):
    line = F.col("conv_id") * 1000 + F.col("turn")
    return fx.read(spark, sf, "conversations").select(line.cast("string").alias("qid"), F.col("text").alias("query"), line.alias("line_no"))


@query("dedup_queries", "convs", "SELECT arg_min(qid, line_no) qid, query, min(line_no) line_no FROM convs GROUP BY query")
def dedup_queries(spark, sf):
    return P.dedup_queries(_turns(spark, sf))


@query("merge_renumber", "convs gen", """SELECT CAST(57 + row_number() OVER (ORDER BY s, l) AS VARCHAR) qid, query FROM
    (SELECT query, min({'s': s, 'l': line_no}).s s, min({'s': s, 'l': line_no}).l l FROM (SELECT query, 0 s, line_no FROM convs UNION ALL SELECT query, 1, line_no FROM gen) GROUP BY query)""")
def merge_renumber(spark, sf):
    return P.merge_renumber([_turns(spark, sf), generated(spark, sf)])


@query("histogram_overflow", "docs", "SELECT CAST(least(len(toks) // 20, 45) * 20 AS BIGINT) bin, count(*) n FROM docs GROUP BY 1")
def histogram_overflow(spark, sf):
    from judgeline.functions.text import tokenize_ws
    lengths = fx.corpus(spark, sf).select(F.size(tokenize_ws("text")).alias("n_words"))
    return P.histogram_overflow(lengths, "n_words", 20, 900)


# --- set operations --------------------------------------------------------------------------------------------


@query("union_queries", "convs gen", "SELECT qid, query FROM convs UNION SELECT qid, query FROM gen")
def union_queries(spark, sf):
    return O.union_queries([_turns(spark, sf), generated(spark, sf), generated(spark, sf)])


@query("intersect_qids", "runs gold", "SELECT qid FROM runs INTERSECT SELECT qid FROM gold WHERE label = 3")
def intersect_qids(spark, sf):
    return O.intersect_qids(fx.runs(spark, sf), fx.gold(spark, sf).where(F.col("label") == 3))


@query("except_qids", "runs gold", "SELECT qid FROM runs EXCEPT SELECT qid FROM gold WHERE label = 3")
def except_qids(spark, sf):
    return O.except_qids(fx.runs(spark, sf), fx.gold(spark, sf).where(F.col("label") == 3))


@query("upsert_union", "gold pred", """SELECT coalesce(p.k, g.k) k, coalesce(p.v, g.v) v FROM (SELECT qid || '_' || did k, label v FROM gold) g
    FULL JOIN (SELECT qid || '_' || did k, label v FROM pred) p ON p.k = g.k""")
def upsert_union(spark, sf):
    kv = lambda d: d.select(F.concat_ws("_", "qid", "did").alias("k"), F.col("label").alias("v"))
    return O.upsert_union([kv(fx.gold(spark, sf)), kv(fx.pred(spark, sf))], "k", "v")


@query("membership_mask", "runs", """SELECT qid, did, CAST(bit_or(CASE run_id WHEN 'a' THEN 1 WHEN 'b' THEN 2 ELSE 4 END) AS INT) mask
    FROM runs GROUP BY qid, did""")
def membership_mask(spark, sf):
    return O.membership_mask(fx.runs(spark, sf), ["a", "b", "c"])
