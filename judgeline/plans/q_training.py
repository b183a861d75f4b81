"""Queries on pools, mined negatives and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgeline.operators import pooling as P
from judgeline.plans import fixtures as fx
from judgeline.plans.q_fusion import chunk_corpus
from judgeline.plans.registry import query
from judgeline.plans.sqlparts import bm25, part, tokens, topk

HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"

part("pool3", "runs", """SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, turn, run_no, did) rank FROM (SELECT *,
    CASE WHEN tier = 5 THEN row_number() OVER (PARTITION BY qid, tier, run_no ORDER BY place, did) ELSE place END turn FROM (
    SELECT *, CASE WHEN tier <> 5 THEN 0 WHEN r1 IS NOT NULL THEN 1 WHEN r2 IS NOT NULL THEN 2 ELSE 3 END run_no,
    CASE WHEN tier = 3 THEN r2 ELSE coalesce(r1, r2, r3) END place FROM (
    SELECT *, CASE WHEN r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL THEN 1 WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN 2
    WHEN r2 IS NOT NULL AND r3 IS NOT NULL THEN 3 WHEN r1 IS NOT NULL AND r3 IS NOT NULL THEN 4 ELSE 5 END tier FROM (
    SELECT qid, did, min(rank) FILTER (run_id = 'a') r1, min(rank) FILTER (run_id = 'b') r2, min(rank) FILTER (run_id = 'c') r3
    FROM runs GROUP BY qid, did))))""")


@query("pool_three_runs", "pool3", "SELECT qid, did, tier, rank FROM pool3 WHERE rank <= 40")
def pool_three_runs(spark, sf):
    return P.pool_three_runs(fx.runs(spark, sf), ["a", "b", "c"], 40)


part("hardn", "run_a gold", """SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) r
    FROM run_a WHERE (qid, did) NOT IN (SELECT (qid, did) FROM gold WHERE label >= 2)""")


def _positives(spark, sf):
    return fx.gold(spark, sf).where(F.col("label") >= 2).select("qid", "did")


def _annotated(spark, sf):
    return fx.gold(spark, sf).where(F.col("label") == 0).select("qid", "did")


@query("hard_negatives", "hardn", """SELECT qid, string_agg(did, ',' ORDER BY r) negatives FROM hardn WHERE r <= 15
    GROUP BY qid HAVING count(*) = 15""")
def hard_negatives(spark, sf):
    out = P.hard_negatives(fx.run_a(spark, sf), _positives(spark, sf), 15)
    return out.select("qid", F.array_join("negatives", ",").alias("negatives"))


# Mined negatives are ranked on case-sensitive tokens.
part("xdocs", "", f"SELECT CAST(doc_id AS VARCHAR) did, lower(text) ltext, {tokens('text', False)} toks FROM documents")
part("xq", "", f"SELECT CAST(item_id AS VARCHAR) qid, {tokens('text', False)} toks FROM benchmark")


def _mining_parts(p, docs, k1=1.5, b=0.75):
    """SQL of the tiers for one id space: parts are prefixed with ``p``; ``docs`` is (did, ltext, toks)."""
    sql = bm25(k1, b)
    for n in ("tf", "dfs", "dls", "tot", "qt"):
        sql = sql.replace(f"JOIN {n} ", f"JOIN {p}{n} ").replace(f", {n} ", f", {p}{n} ").replace(f"FROM {n} ", f"FROM {p}{n} ")
    part(f"{p}tf", docs, f"SELECT did, term, count(*) tf FROM (SELECT did, unnest(toks) term FROM {docs}) GROUP BY did, term")
    part(f"{p}qt", "xq", "SELECT qid, term, count(*) qtf FROM (SELECT qid, unnest(toks) term FROM xq) GROUP BY qid, term")
    part(f"{p}dfs", f"{p}tf", f"SELECT term, count(*) df FROM {p}tf GROUP BY term")
    part(f"{p}dls", docs, f"SELECT did, len(toks) dl FROM {docs}")
    part(f"{p}tot", docs, f"SELECT count(*) n, avg(len(toks)) avgdl FROM {docs}")
    part(f"{p}all", f"{p}qt {p}tf {p}dfs {p}dls {p}tot", sql)
    part(f"{p}run", f"{p}all", topk(f"{p}all", 160))
    part(f"{p}plan", f"{p}pos {p}ann", f"""SELECT qid, p, a, 6 * p quota, least(a, 6 * p) n1, least(3 * p, 6 * p - least(a, 6 * p)) cap FROM
        (SELECT qid, count(*) p FROM {p}pos GROUP BY qid) LEFT JOIN (SELECT qid, count(*) a FROM {p}ann GROUP BY qid) USING (qid)
        """.replace("p, a, 6", "p, coalesce(a, 0) a, 6").replace("least(a,", "least(coalesce(a, 0),"))
    part(f"{p}t1", f"{p}plan {p}ann", f"""SELECT qid, did, 1 tier FROM (SELECT qid, did, quota,
        row_number() OVER (PARTITION BY qid ORDER BY md5('42|' || qid || '|' || did), did) n FROM {p}ann JOIN {p}plan USING (qid)) WHERE n <= quota""")
    part(f"{p}t2", f"{p}plan {p}pos {p}ann {p}run", f"""SELECT qid, did, 2 tier FROM (SELECT qid, did, cap, row_number() OVER (PARTITION BY qid ORDER BY rank) n
        FROM {p}run JOIN {p}plan USING (qid) WHERE rank > 10 AND (qid, did) NOT IN (SELECT (qid, did) FROM {p}pos)
        AND (qid, did) NOT IN (SELECT (qid, did) FROM {p}ann)) WHERE n <= cap""")
    part(f"{p}ez", f"{p}plan {p}pos {p}ann {p}t2 {docs} xq", f"""SELECT qid, did, tier FROM (SELECT qid, did, rem, tier,
        row_number() OVER (PARTITION BY qid ORDER BY tier, dist, did) n FROM (SELECT qid, did, rem,
        CASE WHEN list_bool_and(list_transform(terms, lambda t: NOT contains(ltext, t))) IS NOT FALSE THEN 3 ELSE 4 END tier,
        ({HASH.format("'42|' || did")} - {HASH.format("'42|q|' || qid")} + 4294967296) % 4294967296 dist
        FROM (SELECT qid, quota - n1 - coalesce(n2, 0) rem, list_filter(list_transform(toks, lambda x: lower(x)), lambda x: length(x) > 3) terms FROM {p}plan JOIN xq USING (qid)
        LEFT JOIN (SELECT qid, count(*) n2 FROM {p}t2 GROUP BY qid) USING (qid)), {docs}
        WHERE rem > 0 AND (qid, did) NOT IN (SELECT (qid, did) FROM {p}pos UNION ALL SELECT (qid, did) FROM {p}ann UNION ALL SELECT (qid, did) FROM {p}t2)))
        WHERE n <= rem""")
    part(f"{p}mined", f"{p}pos {p}t1 {p}t2 {p}ez", f"""SELECT qid, did, 1 AS label, 0 tier FROM {p}pos UNION ALL SELECT qid, did, 0, tier FROM {p}t1
        UNION ALL SELECT qid, did, 0, tier FROM {p}t2 UNION ALL SELECT qid, did, 0, tier FROM {p}ez""")


part("mpos", "gold", "SELECT qid, did FROM gold WHERE label >= 2")
part("mann", "gold", "SELECT qid, did FROM gold WHERE label = 0")
_mining_parts("m", "xdocs")
part("npos", "mpos", "SELECT qid, did FROM mpos")
part("nann", "mann", "SELECT qid, did FROM mann")
_mining_parts("n", "xdocs", 0.9, 0.4)


def mined(spark, sf):
    return fx.stored(spark, sf, "mined", lambda: P.mine_negatives(
        fx.corpus(spark, sf), fx.queries(spark, sf), _positives(spark, sf), _annotated(spark, sf)))


@query("mine_negatives", "mmined", "SELECT qid, did, label, tier FROM mmined")
def mine_negatives(spark, sf):
    return P.mine_negatives(
        fx.corpus(spark, sf), fx.queries(spark, sf), _positives(spark, sf), _annotated(spark, sf))


@query("mine_negatives_preset", "nmined", "SELECT qid, did, label, tier FROM nmined")
def mine_negatives_preset(spark, sf):
    return P.mine_negatives(
        fx.corpus(spark, sf), fx.queries(spark, sf), _positives(spark, sf), _annotated(spark, sf), k1=0.9, b=0.4)


@query("mine_negatives_annotated_only", "gold", """SELECT qid, did, CAST(label >= 2 AS INT) AS label, CAST(label < 2 AS INT) tier FROM gold
    WHERE (label = 0 OR label >= 2) AND qid IN (SELECT qid FROM gold WHERE label >= 2)""")
def mine_negatives_annotated_only(spark, sf):
    return P.mine_negatives(
        fx.corpus(spark, sf), fx.queries(spark, sf), _positives(spark, sf), _annotated(spark, sf), neg_ratio=0)


part("ydocs", "", f"""SELECT d, d || '__chunk' || i did, lower(array_to_string(w[i * 128 + 1 : i * 128 + 256], ' ')) ltext, w[i * 128 + 1 : i * 128 + 256] toks
    FROM (SELECT d, w, unnest(range(CAST(ceil(len(w) / 128) AS BIGINT))) i FROM (SELECT CAST(doc_id AS VARCHAR) d, {tokens('text', False)} w FROM documents))""")
part("kpos", "gold ydocs", "SELECT qid, y.did FROM (SELECT qid, did d FROM gold WHERE label >= 2) JOIN ydocs y USING (d)")
part("kann", "gold ydocs", "SELECT qid, y.did FROM (SELECT qid, did d FROM gold WHERE label = 0) JOIN ydocs y USING (d)")
_mining_parts("k", "ydocs")


@query("mine_negatives_chunked", "kmined", "SELECT qid, did cid, label, tier FROM kmined")
def mine_negatives_chunked(spark, sf):
    pos = _positives(spark, sf)
    chunks = fx.stored(spark, sf, "chunks", lambda: chunk_corpus(spark, sf))
    return P.mine_negatives_chunked(chunks, fx.queries(spark, sf), pos, _annotated(spark, sf))


@query("negative_tiers", "mmined", "SELECT tier, count(*) n FROM mmined GROUP BY tier")
def negative_tiers(spark, sf):
    return P.tier_report(mined(spark, sf))


@query("mining_shortage", "mmined", """SELECT qid, 6 * count(*) FILTER (label = 1) AS wanted, count(*) FILTER (label = 0) AS found,
    greatest(6 * count(*) FILTER (label = 1) - count(*) FILTER (label = 0), 0) AS missing FROM mmined GROUP BY qid""")
def mining_shortage(spark, sf):
    return P.shortage_report(mined(spark, sf))


part("blocks", "mmined", """SELECT p.qid, p.did positive, n.slot, n.did negative FROM
    (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY md5('42|' || qid || '|' || did), did) b FROM mmined WHERE label = 1) p JOIN
    (SELECT qid, did, (r - 1) // 4 + 1 b, CAST((r - 1) % 4 + 1 AS INT) slot FROM (SELECT qid, did,
    row_number() OVER (PARTITION BY qid ORDER BY md5('42|' || qid || '|' || did), did) r FROM mmined WHERE label = 0)) n USING (qid, b)""")


@query("partition_negatives", "blocks", "SELECT qid, positive, slot, negative FROM blocks")
def partition_negatives(spark, sf):
    return P.partition_negatives(mined(spark, sf), 4)


@query("wide_training_rows", "mmined", """SELECT p.qid query, p.did positive, """ + ", ".join(
    f"max(n.did) FILTER (slot = {i}) negative_{i}" for i in range(1, 7)) + """ FROM
    (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY did) b FROM mmined WHERE label = 1) p JOIN
    (SELECT qid, did, (r - 1) // 6 + 1 b, (r - 1) % 6 + 1 slot FROM (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY did) r
    FROM mmined WHERE label = 0)) n USING (qid, b) GROUP BY p.qid, p.did""")
def wide_training_rows(spark, sf):
    return P.wide_training_rows(mined(spark, sf), 6)


@query("training_groups", "blocks docs qs", """SELECT query, p.text pos, string_agg(n.text, '||' ORDER BY slot) neg, 'P: ' prompt, '' type
    FROM blocks b JOIN docs p ON p.did = b.positive JOIN docs n ON n.did = b.negative JOIN qs USING (qid) GROUP BY b.qid, b.positive, query, p.text""")
def training_groups(spark, sf):
    out = P.training_groups(mined(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf), 4, "P: ")
    return out.select("query", F.element_at("pos", 1).alias("pos"), F.array_join("neg", "||").alias("neg"), "prompt", "type")


@query("triplet_columns", "hardn gold", """SELECT qid anchor, did positive, n1 negative_1, n2 negative_2, n3 negative_3 FROM gold JOIN
    (SELECT qid, max(did) FILTER (r = 1) n1, max(did) FILTER (r = 2) n2, max(did) FILTER (r = 3) n3 FROM hardn GROUP BY qid) USING (qid) WHERE label >= 2""")
def triplet_columns(spark, sf):
    neg = P.hard_negatives(fx.run_a(spark, sf), _positives(spark, sf), 3, require_full=False)
    rows = _positives(spark, sf).join(neg, "qid").select(F.col("qid").alias("query"), F.col("did").alias("positive"), "negatives")
    return P.triplet_columns(rows, 3)


part("trip", "blocks", "SELECT qid, positive, negative FROM blocks")
part("bint", "trip", """SELECT qid, qid || '|' || positive || '|' || negative triplet, positive did, 1 AS label FROM trip UNION ALL
    SELECT qid, qid || '|' || positive || '|' || negative, negative, 0 FROM trip""")


def triplets(spark, sf):
    """Every positive with each of its negatives."""
    return P.partition_negatives(mined(spark, sf), 4).select(
        F.col("qid").alias("query_id"), F.col("positive").alias("pos_doc_id"), F.col("negative").alias("neg_doc_id"))


@query("binary_from_triplets", "bint", """SELECT qid, triplet, did, label,
    row_number() OVER (ORDER BY md5('42|' || triplet || '|' || label), triplet, label) AS position FROM bint""")
def binary_from_triplets(spark, sf):
    return P.binary_from_triplets(triplets(spark, sf))
