"""Queries on score normalization, fusion, chunk pooling and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgeline.functions.text import chunk_id, chunk_sliding, tokenize_ws
from judgeline.operators import fusion as U
from judgeline.operators import retrieve as R
from judgeline.plans import fixtures as fx
from judgeline.plans.registry import query
from judgeline.plans.sqlparts import bm25, part, tokens, topk

NORMS = {
    "raw": "SELECT run_id, qid, did, score FROM runs",
    "z": """SELECT run_id, qid, did, (score - avg(score) OVER w) / (CASE WHEN stddev_pop(score) OVER w > 0
        THEN stddev_pop(score) OVER w ELSE 1 END) score FROM runs WINDOW w AS (PARTITION BY run_id, qid)""",
    "minmax": """SELECT run_id, qid, did, (score - min(score) OVER w) / (CASE WHEN max(score) OVER w > min(score) OVER w
        THEN max(score) OVER w - min(score) OVER w ELSE 1 END) score FROM runs WINDOW w AS (PARTITION BY run_id, qid)""",
    "rrf": "SELECT run_id, qid, did, 1.0 / (60 + rank) score FROM runs",
}


def _register(norm):
    part(f"norm_{norm}", "runs", NORMS[norm])
    zero = norm == "rrf"
    pick = lambda n: (
        f"coalesce(max(score) FILTER (run_id = '{n}'), 0)" if zero else f"max(score) FILTER (run_id = '{n}')")
    part(f"wide_{norm}", f"norm_{norm}", f"""SELECT qid, did, {pick('a')} x, {pick('b')} y, {pick('c')} z
        FROM norm_{norm} GROUP BY qid, did""")
    variants = [("a", "x"), ("b", "y"), ("c", "z"), ("a_b", "(x + y) * 0.5"), ("a_c", "(x + z) * 0.5"),
                ("b_c", "(y + z) * 0.5"), ("all_three", "(x + y * 0.3 + z) / 2.3")]
    part(f"fused_{norm}", f"wide_{norm}", " UNION ALL ".join(
        f"SELECT '{n}' run_id, qid, did, {e} score FROM wide_{norm} WHERE {e} IS NOT NULL" for n, e in variants))

    @query(f"fuse_runs_{norm}", f"fused_{norm}", "SELECT run_id, qid, did, rank, round(score, 6) score FROM ("
           + topk(f"fused_{norm}", 30, "run_id, qid") + ")")
    def fuse(spark, sf):
        out = U.fuse_runs(fx.runs(spark, sf), ("a", "b", "c"), norm, (1.0, 0.3, 1.0), k=30)
        return out.select("run_id", "qid", "did", "rank", F.round("score", 6).alias("score"))

    if norm != "raw":
        @query(f"normalize_scores_{norm}", f"norm_{norm}",
               f"SELECT run_id, qid, did, round(score, 6) score FROM norm_{norm}")
        def normalize(spark, sf):
            return U.normalize_scores(fx.runs(spark, sf), norm).select(
                "run_id", "qid", "did", F.round("score", 6).alias("score"))


for _norm in NORMS:
    _register(_norm)


# --- reranking -------------------------------------------------------------------------------------------------

part("rr_head", "run_a", "SELECT qid, did FROM run_a WHERE rank <= 10")
part("rr_scores", "rr_head docs", "SELECT qid, did, 1.0 / (1 + len(toks)) score FROM rr_head JOIN docs USING (did)")
part("rr_lift", "run_a rr_scores", """SELECT qid, mx - mn + 0.001 lift FROM (SELECT qid, max(score) mx FROM run_a GROUP BY qid)
    JOIN (SELECT qid, min(score) mn FROM rr_scores GROUP BY qid) USING (qid)""")
MERGED = """SELECT a.qid, a.did, round(coalesce(s.score + lift, a.score), 6) score FROM run_a a
    LEFT JOIN {s} s ON s.qid = a.qid AND s.did = a.did JOIN {l} l ON l.qid = a.qid"""


def _shortness(query, text):
    return F.lit(1.0) / (F.size(tokenize_ws(text)) + 1)


@query("rerank_topk", "rr_lift run_a rr_scores", MERGED.format(s="rr_scores", l="rr_lift"))
def rerank_topk(spark, sf):
    out = U.rerank_topk(fx.run_a(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf), _shortness, k=10)
    return out.select("qid", "did", F.round("score", 6).alias("score"))


@query("merge_reranked", "rr_lift run_a rr_scores", MERGED.format(s="rr_scores", l="rr_lift"))
def merge_reranked(spark, sf):
    head = fx.run_a(spark, sf).where(F.col("rank") <= 10).select("qid", "did")
    scores = head.join(fx.corpus(spark, sf), "did").select("qid", "did", _shortness(None, F.col("text")).alias("score"))
    return U.merge_reranked(fx.run_a(spark, sf), scores).select("qid", "did", F.round("score", 6).alias("score"))


part("rc_words", "rr_head docs", f"SELECT qid, did, {tokens('text', False)} w FROM rr_head JOIN docs USING (did)")
part("rc_scores", "rc_words qs", """SELECT qid, did, max(s) score FROM (SELECT qid, did,
    len(list_intersect(qs.toks, list_transform(w[i * 64 + 1 : i * 64 + 128], lambda x: lower(x)))) / len(list_distinct(qs.toks)) s
    FROM (SELECT qid, did, w, unnest(range(CAST(ceil(len(w) / 64) AS BIGINT))) i FROM rc_words) JOIN qs USING (qid)) GROUP BY qid, did""")
part("rc_lift", "run_a rc_scores", """SELECT qid, mx - mn + 0.001 lift FROM (SELECT qid, max(score) mx FROM run_a GROUP BY qid)
    JOIN (SELECT qid, min(score) mn FROM rc_scores GROUP BY qid) USING (qid)""")


@query("rerank_topk_chunked", "rc_lift run_a rc_scores", MERGED.format(s="rc_scores", l="rc_lift"))
def rerank_topk_chunked(spark, sf):
    def recall(q, text):
        words = F.array_distinct(tokenize_ws(q))
        return F.size(F.array_intersect(words, tokenize_ws(text))) / F.size(words)

    out = U.rerank_topk(fx.run_a(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf), recall, k=10,
                        chunker=lambda t: chunk_sliding(t, 128, 64))
    return out.select("qid", "did", F.round("score", 6).alias("score"))


# --- chunk runs ------------------------------------------------------------------------------------------------

part("cdocs", "", f"""SELECT did, did || '__chunk' || i cid, w[i * 128 + 1 : i * 128 + 256] toks FROM (SELECT did, w,
    unnest(range(CAST(ceil(len(w) / 128) AS BIGINT))) i FROM (SELECT CAST(doc_id AS VARCHAR) did, {tokens('text')} w FROM documents))""")
part("ctf", "cdocs", "SELECT cid did, term, count(*) tf FROM (SELECT cid, unnest(toks) term FROM cdocs) GROUP BY cid, term")
part("cdfs", "ctf", "SELECT term, count(*) df FROM ctf GROUP BY term")
part("cdls", "cdocs", "SELECT cid did, len(toks) dl FROM cdocs")
part("ctot", "cdocs", "SELECT count(*) n, avg(len(toks)) avgdl FROM cdocs")
_sql = bm25(1.5, 0.75)
for _n in ("tf", "dfs", "dls", "tot"):
    _sql = _sql.replace(f"JOIN {_n} ", f"JOIN c{_n} ").replace(f", {_n} ", f", c{_n} ")
part("call", "qt ctf cdfs cdls ctot", f"SELECT qid, did cid, split_part(did, '__chunk', 1) did, score FROM ({_sql})")


def chunk_corpus(spark, sf):
    return fx.corpus(spark, sf).select("did", F.posexplode(chunk_sliding("text", 256, 128)).alias("idx", "text")).select(
        chunk_id("did", "idx").alias("cid"), "did", "idx", "text")


def _chunk_scores(spark, sf):
    chunks = chunk_corpus(spark, sf).withColumnRenamed("did", "doc")
    scores = R.bm25_run(chunks, fx.queries(spark, sf), id_col="cid", parent="doc")
    return scores.select("qid", F.col("did").alias("cid"), F.col("doc").alias("did"), "score")


def _pooled(how, sql):
    @query(f"pool_chunks_{how}", "call", "SELECT qid, did, rank, round(score, 6) score FROM (" + topk(f"({sql})", 20) + ")")
    def pooled(spark, sf):
        run = R.topk_run(U.pool_chunks(_chunk_scores(spark, sf), how), 20)
        return run.select("qid", "did", "rank", F.round("score", 6).alias("score"))


_pooled("max", "SELECT qid, did, max(score) score FROM call GROUP BY qid, did")
_pooled("mean", "SELECT qid, did, avg(score) score FROM call GROUP BY qid, did")
_pooled("top3", """SELECT qid, did, avg(score) score FROM (SELECT *, row_number() OVER (PARTITION BY qid, did
    ORDER BY score DESC, cid) r FROM call) WHERE r <= 3 GROUP BY qid, did""")
