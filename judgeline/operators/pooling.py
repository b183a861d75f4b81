"""Candidate pools and training negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from judgeline.functions.text import tokenize_ws
from judgeline.operators.retrieve import LONG_TERM, bm25_run, topk_run
from judgeline.operators.sizing import hash_key, number_by_hash, number_ranges, pick
from judgeline.operators.termscan import ring_negatives
from judgeline.session import written

def pool_three_runs(runs: DataFrame, names: list[str], k: int = 40) -> DataFrame:
    """k documents per query out of three runs: shared by all, by 1 and 2, by 2 and 3, by 1 and 3, then singles in turn.

    A tier is ordered by the rank in its first run. Singles take turns by their place among the leftovers of their
    run; a run that is used up is skipped.
    """
    rank_in = lambda n: F.min(F.when(F.col("run_id") == n, F.col("rank")))
    seen = runs.where(F.col("run_id").isin(*names)).groupBy("qid", "did").agg(
        *[rank_in(n).alias(f"r{i + 1}") for i, n in enumerate(names)])
    r1, r2, r3 = F.col("r1"), F.col("r2"), F.col("r3")
    has1, has2, has3 = r1.isNotNull(), r2.isNotNull(), r3.isNotNull()
    tier = (F.when(has1 & has2 & has3, 1).when(has1 & has2, 2).when(has2 & has3, 3).when(has1 & has3, 4).otherwise(5))
    only = F.when(has1, 1).when(has2, 2).otherwise(3)
    place = F.coalesce(F.when(F.col("tier") == 3, r2), r1, r2, r3)
    rows = seen.withColumn("tier", tier).withColumns({
        "run_no": F.when(F.col("tier") == 5, only).otherwise(0), "place": place})
    among = Window.partitionBy("qid", "tier", "run_no").orderBy("place", "did")
    turn = F.when(F.col("tier") == 5, F.row_number().over(among)).otherwise(F.col("place"))
    order = Window.partitionBy("qid").orderBy("tier", "turn", "run_no", "did")
    return rows.withColumn("turn", turn).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("qid", "did", "tier", "rank")


def hard_negatives(run: DataFrame, positives: DataFrame, k: int = 15, require_full: bool = True) -> DataFrame:
    """(qid, negatives): the k best documents that are not positive; short queries are left out or kept short."""
    rest = run.join(positives.select("qid", "did"), ["qid", "did"], "left_anti")
    best = topk_run(rest.select("qid", "did", "score"), k)
    listed = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "did"))).alias("d"))
    out = listed.select("qid", F.transform("d", lambda x: x["did"]).alias("negatives"))
    return out.where(F.size("negatives") == k) if require_full else out


def mine_negatives(
    corpus: DataFrame,
    queries: DataFrame,
    positives: DataFrame,
    annotated: DataFrame,
    neg_ratio: int = 6,
    med_cap: int = 3,
    med_offset: int = 10,
    med_top_k: int = 150,
    seed: str = "42",
    k1: float = 1.5,
    b: float = 0.75,
    lower: bool = False,
    run: DataFrame | None = None,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """Training pairs (qid, did, label, tier): all positives and ``neg_ratio`` negatives per positive.

    Tier 1 annotated negatives (a hash-ordered sample if there are more than needed), tier 2 a BM25 rank window taken
    before exclusions and capped at ``med_cap`` per positive, tier 3 documents without the query's longer terms, tier 4
    any document. With ratio 0 the annotated negatives are taken as they are. ``blocked`` are pairs that may not
    become mined negatives (by default the positives). ``run`` replaces the BM25 window.
    """
    pos = positives.select("qid", "did").distinct()
    hard = annotated.select("qid", "did").distinct()
    counts = pos.groupBy("qid").agg(F.count(F.lit(1)).alias("p")).join(queries, "qid").join(
        hard.groupBy("qid").agg(F.count(F.lit(1)).alias("a")), "qid", "left").withColumn("a", F.coalesce("a", F.lit(0)))
    quota = F.when(F.col("p") * neg_ratio == 0, F.col("a")).otherwise(F.col("p") * neg_ratio)
    plan = counts.withColumn("quota", quota).withColumn("n1", F.least("a", "quota")).withColumn(
        "cap", F.least(F.col("p") * med_cap, F.col("quota") - F.col("n1")))
    mixed = hard.join(plan.select("qid", "quota"), "qid").withColumn("_h", hash_key(seed, F.col("qid"), F.col("did")))
    tier1 = number_by_hash(mixed, "_h", ["did"], ["qid"]).where(F.col("rn") <= F.col("quota")).select(
        "qid", "did", F.lit(1).alias("tier"))
    if run is None:
        asked = queries.join(plan.select("qid"), "qid", "left_semi")
        run = topk_run(
            bm25_run(corpus, asked, k1=k1, b=b, lower=lower, k=med_offset + med_top_k), med_top_k, offset=med_offset)
    taken = pos.unionByName(hard) if blocked is None else blocked.select("qid", "did").unionByName(hard)
    window = run.select("qid", "did", "rank").join(taken, ["qid", "did"], "left_anti")
    by_rank = Window.partitionBy("qid").orderBy("rank")
    tier2 = written(window.join(plan.select("qid", "cap"), "qid").withColumn("_n", F.row_number().over(by_rank)).where(
        F.col("_n") <= F.col("cap")).select("qid", "did", F.lit(2).alias("tier")), "rank-window")
    n2 = tier2.groupBy("qid").agg(F.count(F.lit(1)).alias("n2"))
    words = F.array_distinct(F.filter(tokenize_ws("query"), lambda t: F.length(t) >= LONG_TERM))
    wanted = plan.join(n2, "qid", "left").select(
        "qid", (F.col("quota") - F.col("n1") - F.coalesce("n2", F.lit(0))).alias("rem"), words.alias("terms"))
    used = taken.unionByName(tier2.select("qid", "did"))
    easy = ring_negatives(wanted, corpus, used, seed).select("qid", "did", "tier")
    known = pos.join(plan.select("qid"), "qid", "left_semi").select("qid", "did", F.lit(0).alias("tier"))
    return known.unionByName(tier1).unionByName(tier2).unionByName(easy).select(
        "qid", "did", (F.col("tier") == 0).cast("int").alias("label"), "tier")


def mine_negatives_chunked(chunks: DataFrame, queries: DataFrame, positives: DataFrame, annotated: DataFrame, **kw):
    """``mine_negatives`` on chunks (cid, did, text): positives and annotated negatives are all chunks of their
    documents, and no chunk of a positive document becomes a negative."""
    ids = chunks.select("cid", "did")
    pos = positives.select("qid", "did").distinct().join(ids, "did").select("qid", F.col("cid").alias("did"))
    neg = annotated.select("qid", "did").distinct().join(ids, "did").select("qid", F.col("cid").alias("did"))
    flat = chunks.select(F.col("cid").alias("did"), "text")
    return mine_negatives(flat, queries, pos, neg, **kw).withColumnRenamed("did", "cid")


def shortage_report(pairs: DataFrame, neg_ratio: int = 6) -> DataFrame:
    """(qid, wanted, found, missing): negatives that the ratio asks for and those that mining found.

    With ratio 0 the annotated negatives are what is wanted.
    """
    counts = pairs.groupBy("qid").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("found"))
    wanted = F.col("p") * neg_ratio if neg_ratio else F.col("found")
    return counts.select("qid", wanted.alias("wanted"), "found", F.greatest(wanted - F.col("found"), F.lit(0)).alias("missing"))


def tier_report(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def partition_negatives(pairs: DataFrame, n: int, seed: str = "42", strict_ratio: bool = False) -> DataFrame:
    """(qid, positive, slot, negative): disjoint blocks of n negatives, one block per positive.

    Surplus negatives are left out in hash order; too few fail the job. ``strict_ratio`` also fails on a surplus and
    keeps the negatives in id order.
    """
    rows = pairs.select("qid", "did", "label")
    if strict_ratio:
        numbered = number_ranges(rows, [F.col("did")], ["qid", "label"])
    else:
        hashed = rows.withColumn("_h", hash_key(seed, F.col("qid"), F.col("did")))
        numbered = number_by_hash(hashed, "_h", ["did"], ["qid", "label"])
    pos = numbered.where(F.col("label") == 1).select("qid", F.col("did").alias("positive"), F.col("rn").alias("block"))
    neg = numbered.where(F.col("label") == 0)
    sizes = pairs.groupBy("qid").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("m"))
    wrong = (F.col("m") != F.col("p") * n) if strict_ratio else (F.col("m") < F.col("p") * n)
    bad = F.raise_error(F.concat(F.lit("wrong number of negatives for query "), F.col("qid"))).cast("bigint")
    checked = sizes.select("qid", F.when(wrong, bad).otherwise(F.col("p")).alias("p"))
    slots = neg.join(checked, "qid").where(F.col("rn") <= F.col("p") * n).select(
        "qid", F.col("did").alias("negative"), (F.floor((F.col("rn") - 1) / n) + 1).cast("int").alias("block"),
        ((F.col("rn") - 1) % n + 1).cast("int").alias("slot"))
    return pos.join(slots, ["qid", "block"]).select("qid", "positive", "slot", "negative")


def wide_training_rows(pairs: DataFrame, n: int, strict_ratio: bool = True, seed: str = "42") -> DataFrame:
    """(query, positive, negative_1..n) ids."""
    blocks = partition_negatives(pairs, n, seed, strict_ratio)
    cols = [F.max(F.when(F.col("slot") == i, F.col("negative"))).alias(f"negative_{i}") for i in range(1, n + 1)]
    return blocks.groupBy(F.col("qid").alias("query"), "positive").agg(*cols)


def training_groups(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, n: int, prompt: str, seed: str = "42"):
    """Training groups with texts, one per positive: query, pos, neg, empty score lists, prompt, type."""
    blocks = partition_negatives(pairs, n, seed)
    texts = pick(corpus.select("did", "text"), pairs)
    neg = blocks.join(texts.withColumnsRenamed({"did": "negative", "text": "nt"}), "negative").groupBy(
        "qid", "positive").agg(F.sort_array(F.collect_list(F.struct("slot", "nt"))).alias("neg"))
    rows = neg.join(texts.withColumnsRenamed({"did": "positive", "text": "pt"}), "positive").join(queries, "qid")
    empty = F.array().cast("array<double>")
    return rows.select(
        "query", F.array("pt").alias("pos"), F.transform("neg", lambda x: x["nt"]).alias("neg"),
        empty.alias("pos_scores"), empty.alias("neg_scores"), F.lit(prompt).alias("prompt"), F.lit("").alias("type"))


def triplet_columns(rows: DataFrame, n: int) -> DataFrame:
    """(query, positive, negatives ARRAY) to anchor, positive and negative or negative_1..n."""
    if n == 1:
        negs = [F.try_element_at("negatives", F.lit(1)).alias("negative")]
    else:
        negs = [F.try_element_at("negatives", F.lit(i)).alias(f"negative_{i}") for i in range(1, n + 1)]
    return rows.select(F.col("query").alias("anchor"), "positive", *negs)


def binary_from_triplets(triplets: DataFrame, seed: str = "42") -> DataFrame:
    """Every (query_id, pos_doc_id, neg_doc_id) row gives a positive and a negative row; ``position`` is hash order."""
    from judgeline.operators.sampling import shuffle_rows

    sides = F.array(
        F.struct(F.col("pos_doc_id").alias("did"), F.lit(1).alias("label")),
        F.struct(F.col("neg_doc_id").alias("did"), F.lit(0).alias("label")))
    key = F.concat_ws("|", "query_id", "pos_doc_id", "neg_doc_id")
    rows = triplets.select(F.col("query_id").alias("qid"), key.alias("triplet"), F.inline(sides))
    return shuffle_rows(rows, ["triplet", "label"], seed)
