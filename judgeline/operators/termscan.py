"""One pass over a corpus for many terms at once, and what can be answered from it without the texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgeline.operators.sizing import hash32
from judgeline.session import written

#: Terms handed to tasks at a time; a corpus is read once per so many bytes of distinct terms.
TERM_BYTES = 16 << 20
#: Rows of (query, arc) that one task holds at a time.
VISITS = 20_000
#: Distinct tokens whose terms a task remembers.
TOKEN_MEMORY = 1 << 20


def number_terms(terms: DataFrame) -> DataFrame:
    """(tid, term) for the distinct terms."""
    return written(terms.select("term").where(F.length("term") > 0).distinct().withColumn(
        "tid", F.monotonically_increasing_id()), "terms")


def find_terms(corpus: DataFrame, numbered: DataFrame) -> DataFrame:
    """(did, tids): the terms that every document's lower-cased text holds, inside words as well.

    Terms are free of white space, so that a text holds a term exactly if one of its tokens does: an automaton over all
    terms looks at every distinct token of a task once, and documents only look their tokens up. Documents without a
    term are rows with an empty array.
    """
    spark = corpus.sparkSession
    size = numbered.agg(F.sum(F.octet_length("term"))).head()[0] or 0
    blocks = max(1, math.ceil(size / TERM_BYTES))
    texts = corpus.select("did", F.coalesce(F.lower("text"), F.lit("")).cast("binary").alias("text"))

    def task(shared):
        def run(batches):
            import ahocorasick

            tids, terms = shared.value
            automaton = ahocorasick.Automaton()
            for tid, term in zip(tids, terms):
                automaton.add_word(term, tid)
            automaton.make_automaton()
            known: dict[bytes, tuple] = {}
            for batch in batches:
                found = []
                for text in batch.column("text").to_pylist():
                    held = set()
                    for token in set(text.split()):
                        hits = known.get(token)
                        if hits is None:
                            if len(known) >= TOKEN_MEMORY:
                                known.clear()
                            hits = known[token] = tuple({t for _, t in automaton.iter(token.decode("utf-8", "replace"))})
                        if hits:
                            held.update(hits)
                    found.append(sorted(held))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did"), pa.array(found, pa.list_(pa.int64()))], names=["did", "tids"])

        return run

    if not size:
        return corpus.select("did", F.array().cast("array<bigint>").alias("tids"))
    out = None
    for block in range(blocks):  # at most TERM_BYTES, give or take, pass the driver at a time
        rows = numbered.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).select("tid", "term").collect()
        shared = spark.sparkContext.broadcast(([r.tid for r in rows], [r.term for r in rows]))
        found = texts.mapInArrow(task(shared), "did string, tids array<bigint>") if rows else None
        out = found if out is None else (out if found is None else out.unionByName(found))
    return out if blocks == 1 else out.groupBy("did").agg(F.flatten(F.collect_list("tids")).alias("tids"))


# --- documents free of terms, by bitmap ---------------------------------------------------------------------------

def hit_bitmaps(corpus: DataFrame, query_terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bitmaps, numbers) of the documents that hold a term of a query.

    ``query_terms`` has (qid, term). ``bitmaps`` has ``qid, bucket, bitmap`` with one bit per document of a bucket, and
    only buckets with a hit; ``numbers`` has ``did, bucket, bit``. Terms get their bitmaps first and queries combine
    those of their terms, so that no row stands for a query and a document.
    """
    numbered = number_terms(query_terms)
    held = written(find_terms(corpus, numbered).withColumn("n", F.monotonically_increasing_id()), "held")
    places = held.select(
        "did", "tids", F.call_function("bitmap_bucket_number", "n").alias("bucket"),
        F.call_function("bitmap_bit_position", "n").alias("bit"))
    per_term = places.select("bucket", "bit", F.explode("tids").alias("tid")).groupBy("tid", "bucket").agg(
        F.call_function("bitmap_construct_agg", F.col("bit")).alias("bitmap"))
    asked = query_terms.distinct().join(numbered, "term").select("qid", "tid")
    bitmaps = asked.join(per_term, "tid").groupBy("qid", "bucket").agg(
        F.call_function("bitmap_or_agg", F.col("bitmap")).alias("bitmap"))
    return bitmaps, places.select("did", "bucket", "bit")


def count_free(corpus: DataFrame, queries: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(qid, n_without): the documents that hold none of the query's terms."""
    bitmaps, numbers = hit_bitmaps(corpus, query_terms)
    per_query = bitmaps.groupBy("qid").agg(F.sum(F.call_function("bitmap_count", F.col("bitmap"))).alias("n_with"))
    n_docs = numbers.agg(F.count(F.lit(1)).alias("n")).scalar()
    return queries.select("qid").join(per_query, "qid", "left").select(
        "qid", (n_docs - F.coalesce("n_with", F.lit(0))).alias("n_without"))


def free_documents(corpus: DataFrame, wanted: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(qid, did): for the queries ``wanted``, the documents that hold none of their terms.

    Every bucket is the complement of its bitmap; a bucket that a query has no bitmap for is free as a whole.
    """
    own = query_terms.join(wanted.select("qid").distinct(), "qid", "left_semi")
    bitmaps, numbers = hit_bitmaps(corpus, own)
    buckets = numbers.select("bucket").distinct()
    spread = buckets.agg(F.collect_list("bucket").alias("b"))  # one number per 32 768 documents
    asked = wanted.select("qid").distinct().select("qid", F.explode(spread.scalar()).alias("bucket")).join(
        bitmaps, ["qid", "bucket"], "left")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("getbit", byte, (F.col("bit") % 8).cast("int")) == 1
    return numbers.join(asked, "bucket").where(F.col("bitmap").isNull() | ~hit).select("qid", "did")


# --- nearest documents free of terms, on a ring ---------------------------------------------------------------------

RING = 1 << 32


def _walk(left: pa.Table, right: pa.Table) -> pa.Table:
    """The visits of one arc (left) against its documents (right).

    A visit of step 0 sees the arc from the query's start on, one of the last step what lies before it, others see all of
    it. Gives the first ``need`` documents of the wanted tier, numbered, and a row with the counts of both tiers.
    """
    out = {"qid": [], "step": [], "tier": [], "idx": [], "did": [], "n3": [], "n4": []}

    def add(qids, steps, tiers, idx, dids, n3, n4):
        for name, values in zip(out, (qids, steps, tiers, idx, dids, n3, n4)):
            out[name].extend(values)

    dids = np.array(right.column("did").to_pylist(), dtype=object)
    points = right.column("point").to_numpy()
    order = np.lexsort((dids.astype(str), points)) if len(points) else np.zeros(0, int)
    dids, points = dids[order], points[order]
    tids = right.column("tids").combine_chunks()
    sizes = np.diff(tids.offsets.to_numpy()) if len(tids) else np.zeros(0, int)
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    flat, rows = tids.flatten().to_numpy(), np.repeat(place, sizes)
    by_term = np.argsort(flat, kind="stable")
    flat, rows = flat[by_term], rows[by_term]
    at = {d: i for i, d in enumerate(dids.tolist())}
    for v in left.to_pylist():
        held = np.zeros(len(dids), bool)
        for t in v["terms"]:
            a, b = np.searchsorted(flat, t, "left"), np.searchsorted(flat, t, "right")
            held[rows[a:b]] = True
        valid = np.ones(len(dids), bool)
        for d in v["used"] or ():
            if d in at:
                valid[at[d]] = False
        low = int(np.searchsorted(points, v["start"], "left"))
        span = slice(low, None) if v["step"] == 0 else slice(0, low) if v["last"] else slice(None)
        valid, held, names = valid[span], held[span], dids[span]
        free, other = valid & ~held, valid & held
        picked = np.flatnonzero(free if v["tier"] == 3 else other)[: v["need"]]
        n = len(picked)
        add([v["qid"]] * n, [v["step"]] * n, [v["tier"]] * n, range(1, n + 1), names[picked].tolist(), [None] * n, [None] * n)
        add([v["qid"]], [v["step"]], [0], [0], [None], [int(free.sum())], [int(other.sum())])
    return pa.table(out, schema=pa.schema([
        ("qid", pa.string()), ("step", pa.int64()), ("tier", pa.int32()), ("idx", pa.int64()), ("did", pa.string()),
        ("n3", pa.int64()), ("n4", pa.int64())]))


def ring_negatives(wanted: DataFrame, corpus: DataFrame, used: DataFrame, seed: str = "42", arc_docs: int = 4096):
    """The nearest documents on a hash ring for queries that need some: free of the query's terms first, then any.

    ``wanted`` holds (qid, rem, terms), ``corpus`` (did, text), ``used`` (qid, did) that may not be taken. Texts are read
    once, by ``find_terms``; what is left of a document is its point on the ring and its terms. The ring is cut into arcs
    of about ``arc_docs`` documents. A query walks from its own point through its arc and then, while it is short of free
    documents, through four times as many arcs in every round. In an arc, the documents that hold a term of the query
    come from the arc's own postings. Tasks hand on at most ``rem`` documents per query and arc, numbered within the arc,
    and counts per arc turn these into ranks, so that no query's documents are sorted in one place. Only queries that are
    short after the whole ring visit, once more, the arcs that have the other documents they need.
    Returns (qid, did, tier 3 or 4, rn).
    """
    asked = wanted.where(F.col("rem") > 0)
    terms = asked.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    numbered = number_terms(terms)
    point = hash32(seed, F.col("did"))
    ring = written(find_terms(corpus.select("did", "text"), numbered).select("did", point.alias("point"), "tids"), "ring")
    n_docs = ring.count()
    bits = max(1, min(24, math.ceil(math.log2(max(n_docs, 2) / arc_docs)) if n_docs > arc_docs else 1))
    cells = 1 << bits
    arc_of = lambda p: F.shiftright(p, 32 - bits).cast("long")
    ring = ring.withColumn("arc", arc_of(F.col("point")))
    ids = terms.join(numbered, "term").groupBy("qid").agg(F.collect_list("tid").alias("terms"))
    start = hash32(seed, "q", F.col("qid"))
    queries = written(
        asked.select("qid", F.col("rem").cast("long").alias("rem"), start.alias("start")).withColumn("first", arc_of(F.col("start")))
        .join(ids, "qid", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<bigint>"))), "ring-queries")
    n_queries = queries.count()
    taken = used.select("qid", "did").distinct().join(queries.select("qid"), "qid", "left_semi").withColumn(
        "arc", arc_of(point)).groupBy("qid", "arc").agg(F.collect_list("did").alias("used"))
    taken = written(taken, "ring-used")

    def visit(walks: DataFrame, steps: int) -> DataFrame:
        """``walks`` has qid, start, first, terms, step, tier, need."""
        slots = max(1, math.ceil(n_queries * steps / cells / VISITS))
        visits = walks.withColumn("arc", (F.col("first") + F.col("step")) % cells).join(taken, ["qid", "arc"], "left").select(
            "arc", F.pmod(F.xxhash64("qid"), F.lit(slots)).alias("slot"), "qid", "start", "terms", "used", "step", "tier",
            "need", (F.col("step") == cells).alias("last"))
        docs = ring.join(visits.select("arc").distinct(), "arc", "left_semi").withColumn(
            "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
        both = visits.groupBy("arc", "slot").cogroup(docs.groupBy("arc", "slot"))
        return written(both.applyInArrow(
            _walk, "qid string, step long, tier int, idx long, did string, n3 long, n4 long"), "ring-walk")

    short, found, low, high = queries, None, 0, 0
    while True:
        met = visit(short.withColumn("step", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))))
                    .withColumns({"tier": F.lit(3), "need": F.col("rem")}), high - low + 1)
        found = met if found is None else found.unionByName(met)
        counts = found.where("tier = 0").groupBy("qid").agg(F.sum("n3").alias("n3"))
        short = written(queries.join(counts, "qid").where("n3 < rem"), "ring-short")
        if high == cells or short.head() is None:
            break
        short = short.drop("n3")
        low, high = high + 1, min(cells, high * 4 + 4)
    before = Window.partitionBy("qid").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(found.where("tier = 0").select("qid", "step", "n4", *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"off{n}") for n in ("n3", "n4")]), "ring-offsets")
    rank = lambda rows, off: rows.drop("n3", "n4").join(offsets.select("qid", "step", off), ["qid", "step"]).join(
        queries.select("qid", "rem"), "qid").withColumn("rn", F.col(off) + F.col("idx"))
    out = rank(found.where("tier = 3"), "offn3").where("rn <= rem").select("qid", "did", "tier", "rn")
    if "n3" not in short.columns or short.head() is None:
        return out
    rest = offsets.drop("offn3").join(short.withColumn("missing", F.col("rem") - F.col("n3")), "qid").where(
        (F.col("n4") > 0) & (F.col("offn4") < F.col("missing")))
    any_ = visit(rest.withColumns({"tier": F.lit(4), "need": F.col("missing") - F.col("offn4")}), cells + 1)
    any_ = rank(any_.where("tier = 4"), "offn4").join(short.select("qid", "n3"), "qid").select(
        "qid", "did", "tier", (F.col("n3") + F.col("rn")).alias("rn"))
    return out.unionByName(any_)
