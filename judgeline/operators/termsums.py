"""The k best documents per query by sums over shared terms, without a row per (query, document) pair.

Query terms are few against a corpus and are held by every task; a document becomes one row with the list of those of its
terms that some query asks for. Lists are summed where they are read, as a document whose id occurs once is whole in its
row. Only documents that share their id become one row per term; these meet in one of as many partitions as there are rows
to hold. A task keeps k documents per query while it goes through its documents in the order of their ids. Its memory is
bounded whatever the corpus' size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgeline.operators.ranks import SCORE_DIGITS
from judgeline.operators.sizing import fits
from judgeline.session import written

#: Rows (document, term) of a partition.
PART_ROWS = 1 << 18
#: Rows that are summed at a time, and products or (document, query) cells held for them.
STEP_ROWS, STEP_CELLS = 1 << 16, 1 << 21
#: Lists that are summed at a time.
STEP_DOCS = 1 << 10
#: Documents that a task keeps for all queries together; a run with more is joined instead.
MOST_KEPT = 1 << 21
#: The number of a term that every document has once.
PRESENT = -1


def bounded(queries: DataFrame, terms: DataFrame, k: int) -> bool:
    """Whether a task can hold the terms of all queries and k documents for each of them."""
    return fits(terms) and queries.count() * k <= MOST_KEPT


class TermLists:
    """The terms of a corpus that some query asks for, by place in ``vocabulary``.

    ``lists`` (did, dl, tids, tfs) has a row per document whose id occurs once, ``rows`` (did, dl, tid, tf) has a row per
    term, and one of ``PRESENT``, of the documents that share their id, see ``by_document``; it is None when there are none.
    """

    def __init__(self, vocabulary: pa.Array, lists: DataFrame, rows: DataFrame | None):
        self.vocabulary, self.lists, self.rows = vocabulary, lists, rows


def term_lists(docs: DataFrame, vocabulary: pa.Array) -> TermLists:
    """Written lists of the terms of ``vocabulary`` in each row (did, toks); texts are tokenized once for all runs on them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            toks = batch.column("toks")
            batch = batch.filter(toks.is_valid())
            if not batch.num_rows:
                continue
            toks = batch.column("toks")
            sizes = pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(toks.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)[code >= 0]
            key, tf = np.unique(row * max(1, len(known)) + code[code >= 0], return_counts=True)
            row, tid = np.divmod(key, max(1, len(known)))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(tid, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                names=["did", "dl", "tids", "tfs"])

    kind = docs.schema["did"].dataType.simpleString()
    every = written(docs.select("did", "toks").mapInArrow(
        run, f"did {kind}, dl int, tids array<int>, tfs array<bigint>"), "term-lists")
    often = written(every.groupBy("did").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("did").alias("_did")), "ids")
    if often.isEmpty():
        return TermLists(vocabulary, every, None)
    same = F.col("did").eqNullSafe(F.col("_did"))
    terms = F.concat(F.array(F.struct(F.lit(PRESENT).alias("tid"), F.lit(1).cast("long").alias("tf"))), F.transform(
        F.arrays_zip("tids", "tfs"), lambda x: F.struct(x["tids"].alias("tid"), x["tfs"].alias("tf"))))
    rows = every.join(often, same, "left_semi").select("did", "dl", F.explode(terms).alias("x")).select("did", "dl", "x.tid", "x.tf")
    return TermLists(vocabulary, written(every.join(often, same, "left_anti"), "term-lists"), written(rows, "term-rows"))


def by_document(rows: DataFrame) -> DataFrame:
    """``rows`` of a written table with all rows of a document in one partition of bounded size."""
    return rows.repartition(max(1, math.ceil(rows.count() / PART_ROWS)), "did")


def merged(rows: DataFrame) -> DataFrame:
    """``did, dl, tid, tf``: rows that agree in id and length count as one document."""
    return by_document(rows).groupBy("did", "dl", "tid").agg(F.sum("tf").alias("tf"))


def counts(held: TermLists) -> dict[int, tuple[int, float]]:
    """Documents that hold a term and the sum of their lengths, by ``tid``; ``PRESENT`` stands for all documents."""
    size = len(held.vocabulary)

    def run(batches):
        df, dl = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for batch in batches:
            tids = batch.column("tids").flatten().to_numpy(zero_copy_only=False)
            df[:size] += np.bincount(tids, minlength=size)
            df[size] += batch.num_rows
            dl[size] += pc.sum(batch.column("dl")).as_py() or 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(at == size, PRESENT, at), pa.int32()), pa.array(df[at]), pa.array(dl[at])], names=["tid", "df", "dl"])

    found = held.lists.select("dl", "tids").mapInArrow(run, "tid int, df long, dl long")
    if held.rows is not None:
        found = found.unionByName(merged(held.rows).groupBy("tid").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dl")))
    return {r["tid"]: (r["df"], r["dl"]) for r in found.groupBy("tid").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).collect()}


class TermWeights:
    """Weights (qid, tid, w) in lists by term, for tasks."""

    def __init__(self, weights: pa.Table):
        asked = pc.dictionary_encode(weights.column("qid").combine_chunks(), null_encoding="encode")
        self.names = asked.dictionary
        tid = weights.column("tid").to_numpy().astype(np.int64)
        order = np.lexsort((asked.indices.to_numpy(zero_copy_only=False), tid))
        self.asked = asked.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        self.w = weights.column("w").to_numpy().astype(np.float64)[order]
        self.many = np.bincount(tid, minlength=1)
        self.starts = np.cumsum(self.many) - self.many

    def sums(self, doc: np.ndarray, n_docs: int, tid: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells that share a term, sums of all cells); a cell is a document of ``n_docs`` and a query."""
        many = self.many[tid]
        at = np.repeat(self.starts[tid] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell = np.repeat(doc, many) * len(self.names) + self.asked[at]
        cells = n_docs * len(self.names)
        shared = np.zeros(cells, bool)
        shared[cell] = True
        return shared, np.bincount(cell, np.repeat(s, many) * self.w[at], minlength=cells)


class Best:
    """The k best documents of every query among those handed in, in the order of their ids."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.low = k, np.full(n_queries, -np.inf)
        self.query, self.score, self.dids, self.size = [], [], [], 0

    def add(self, shared: np.ndarray, sums: np.ndarray, dids: pa.Array) -> None:
        n = len(self.low)
        hit = np.flatnonzero(shared)
        doc, query = np.divmod(hit, n)
        more = np.round(sums[hit], SCORE_DIGITS) > self.low[query]  # of equal scores the smaller id came first
        self.query.append(query[more])
        self.score.append(sums[hit][more])
        self.dids.append(dids.take(pa.array(doc[more])))
        self.size += int(more.sum())
        if self.size > 2 * self.k * n + STEP_CELLS // 4:
            self.cut()

    def cut(self) -> None:
        query, score = np.concatenate(self.query), np.concatenate(self.score)
        rounded = np.round(score, SCORE_DIGITS)
        order = np.lexsort((np.arange(len(query)), -rounded, query))
        many = np.bincount(query, minlength=len(self.low))
        starts = np.cumsum(many) - many
        place = np.arange(len(query)) - starts[query[order]]
        full = many >= self.k
        self.low[full] = rounded[order[starts[full] + self.k - 1]]
        keep = np.sort(order[place < self.k])
        self.query, self.score = [query[keep]], [score[keep]]
        self.dids, self.size = [pa.concat_arrays(self.dids).take(pa.array(keep))], len(keep)


def best_sums(rows: DataFrame, weights: pa.Table, k: int, qid: str = "string") -> DataFrame:
    """``qid, did, score``: the sum of ``s * w`` over shared terms; every task hands on its k best documents per query.

    ``rows`` (did, tid, s) has all rows of a document in one partition, see ``by_document``; ``weights`` is (qid, tid, w),
    with ids of the type ``qid``.
    """
    if not weights.num_rows:
        return rows.where("false").select(F.lit(None).cast(qid).alias("qid"), "did", F.lit(0.0).alias("score"))
    shared = rows.sparkSession.sparkContext.broadcast(TermWeights(weights))

    def run(batches):
        lists = shared.value
        best, rest, held = Best(k, len(lists.names)), [], 0

        def steps(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            """Adds the documents that are complete and returns the rows of the last one otherwise."""
            code = pc.dictionary_encode(batch.column("did"), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            firsts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            stop = batch.num_rows if last else int(firsts[-1])
            firsts = firsts[firsts < stop]
            tid = batch.column("tid").to_numpy(zero_copy_only=False)[:stop]
            s = batch.column("s").to_numpy(zero_copy_only=False)[:stop]
            work = np.append(0, np.cumsum(lists.many[tid]))[np.append(firsts, stop)]
            at = 0
            while at < len(firsts):
                end = int(np.searchsorted(work, work[at] + STEP_CELLS, side="right")) - 1
                end = min(max(end, at + 1), at + max(1, STEP_CELLS // len(lists.names)), len(firsts))
                a, b = int(firsts[at]), int(firsts[end]) if end < len(firsts) else stop
                doc = np.searchsorted(firsts[at:end], np.arange(a, b), side="right") - 1
                best.add(*lists.sums(doc, end - at, tid[a:b], s[a:b]), batch.column("did").take(pa.array(firsts[at:end])))
                at = end
            return batch.slice(stop)

        for batch in batches:
            if batch.num_rows:
                rest.append(batch)
                held += batch.num_rows
            if held >= STEP_ROWS:
                rest = [steps(pa.concat_batches(rest), False)]
                held = 0  # a document of more rows than that waits for as many again
        rest = [r for r in rest if r.num_rows]
        if rest:
            steps(pa.concat_batches(rest), True)
        if best.query:
            best.cut()
            yield pa.RecordBatch.from_arrays(
                [lists.names.take(pa.array(best.query[0])), best.dids[0], pa.array(best.score[0])], names=["qid", "did", "score"])

    asked = rows.where(F.col("tid") != PRESENT).select("did", "tid", F.col("s").cast("double").alias("s"))
    kind = rows.schema["did"].dataType.simpleString()
    return asked.sortWithinPartitions("did", "tid").mapInArrow(run, f"qid {qid}, did {kind}, score double")


def best_of_lists(
    held: TermLists, weights: pa.Table, k: int, share: Callable[[np.ndarray, np.ndarray], np.ndarray], qid: str = "string",
) -> DataFrame:
    """``best_sums`` over the rows of ``held.lists``, where ``s`` is ``share(tf, dl)``."""
    lists = held.lists
    kind = lists.schema["did"].dataType.simpleString()
    if not weights.num_rows:
        return lists.where("false").select(F.lit(None).cast(qid).alias("qid"), "did", F.lit(0.0).alias("score"))
    shared = lists.sparkSession.sparkContext.broadcast(TermWeights(weights))

    def run(batches):
        of = shared.value
        best = Best(k, len(of.names))
        for batch in (b.slice(i, STEP_DOCS) for b in batches for i in range(0, b.num_rows, STEP_DOCS)):
            tids = batch.column("tids")
            sizes = pc.list_value_length(tids).to_numpy(zero_copy_only=False).astype(np.int64)
            tid = tids.flatten().to_numpy(zero_copy_only=False)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            dl = batch.column("dl").to_numpy(zero_copy_only=False)
            s = share(tf, np.repeat(dl, sizes)).astype(np.float64)
            ends = np.append(0, np.cumsum(sizes))
            work = np.append(0, np.cumsum(of.many[tid]))[ends]
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(work, work[at] + STEP_CELLS, side="right")) - 1
                end = min(max(end, at + 1), at + max(1, STEP_CELLS // len(of.names)), batch.num_rows)
                part = slice(ends[at], ends[end])
                doc = np.repeat(np.arange(end - at), sizes[at:end])
                best.add(*of.sums(doc, end - at, tid[part], s[part]), batch.column("did").slice(at, end - at))
                at = end
        if best.query:
            best.cut()
            yield pa.RecordBatch.from_arrays(
                [of.names.take(pa.array(best.query[0])), best.dids[0], pa.array(best.score[0])], names=["qid", "did", "score"])

    return lists.sortWithinPartitions("did").mapInArrow(run, f"qid {qid}, did {kind}, score double")
