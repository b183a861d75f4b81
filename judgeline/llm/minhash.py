"""Near copies: SimHash finds texts that may be near, and exact shingle similarity decides.

A text is the set of its shingles: ``width`` consecutive white-space words, A-Z lower-cased, as 64-bit hashes. Texts of
equal sets are one class, and one text stands for it. Every class has a SimHash of ``LANES`` lanes; multi-index hashing
(``simhash.links``) looks up all its segments of ``SEGMENT`` bits, and classes that share one and differ in at most
``APART`` bits are candidates. At a Jaccard similarity of 0.8 a bit differs with probability 0.15 and a pair is met with
95 %, at 0.9 with 99.8 %.

MinHash complements that search: classes that agree in one of ``BANDS`` bands of ``ROWS`` minima each are candidates as
well, so a pair of similarity s meets with probability 1 - (1 - s^ROWS)^BANDS at least, whatever the texts' length
(99.9 % at 0.8). A band's classes all hang on its smallest one, so a band costs a row per class, never pairs.

Inside a component of candidates the classes' whole sets come together, and links are the pairs whose exact Jaccard
similarity reaches the bound. A component of more than ``BLOCK`` shingles is dealt out as pairs of blocks. A place hands
on a spanning forest of its links.

Defined cases: null and blank texts have the empty set and are one class, near no other; a text of fewer than ``width``
words is one shingle. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgeline.llm import simhash
from judgeline.llm.common import map_texts, meet, shingle_hashes, slices, texts
from judgeline.llm.components import components
from judgeline.operators.sizing import hinter
from judgeline.session import written

#: SimHash: lanes, most differing bits of candidates (at similarity 0.8: the mean and over three deviations), bits of a segment.
LANES, APART, SEGMENT = 4, 58, 12
BANDS, ROWS = 30, 7
#: Shingles of a component that are compared in one place; more are dealt out in blocks of this size.
BLOCK = 1 << 20
#: Shingles whose minima are taken at once.
PART = 1024


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _constants(start: int, n: int) -> np.ndarray:
    return _mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


FACTORS = (_constants(1, BANDS * ROWS) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
OF_ROW, OF_BAND = _constants(10_000, ROWS), _constants(20_000, BANDS)


def shingle_set(text: bytes, width: int, hasher) -> np.ndarray:
    """The different shingles, sorted."""
    return np.unique(shingle_hashes(text, width, hasher))


def bands(shingles: np.ndarray) -> np.ndarray:
    """One key per band, none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(upper), PART):
        np.minimum(low, (FACTORS * upper[i:i + PART]).min(axis=1), out=low)
    keys = (_mix(low.reshape(BANDS, ROWS).astype(np.uint64) + OF_ROW) * OF_ROW).sum(axis=1, dtype=np.uint64)
    return _mix(keys + OF_BAND).view(np.int64)


def _classes_of(rows: DataFrame, width: int) -> DataFrame:
    """``doc_id, mark`` with ``s1, s2, n`` (the set's digest and size), ``bands`` and the lanes of the SimHash."""
    names = simhash.lane_columns(LANES)

    def make():
        from xxhash import xxh64_intdigest

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, width, xxh64_intdigest) for t in batch.column("text").to_pylist()]
            fps = np.array([simhash.bits_of(s, LANES) for s in sets], np.uint64).reshape(-1, LANES).view(np.int64)
            return {
                "doc_id": batch.column("doc_id"), "mark": batch.column("mark"),
                "s1": np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                "s2": np.array([_mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                "n": np.array([len(s) for s in sets], np.int64), "bands": [bands(s) for s in sets],
                **{c: np.ascontiguousarray(fps[:, k]) for k, c in enumerate(names)}}

        return work

    lanes = ", ".join(f"{c} long" for c in names)
    return map_texts(rows, make, f"doc_id long, mark long, s1 long, s2 long, n long, bands array<long>, {lanes}")


def _sets_of(rows: DataFrame, width: int) -> DataFrame:
    """``id, root`` with ``shingles``, the whole set as bytes; a task hands on an id once."""
    def make():
        from xxhash import xxh64_intdigest

        seen = set()

        def work(batch: pa.RecordBatch) -> dict:
            new = [own not in seen and not seen.add(own) for own in batch.column("id").to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            sets = [shingle_set(t, width, xxh64_intdigest).tobytes() for t in batch.column("text").to_pylist()]
            return {c: batch.column(c) for c in ("id", "root")} | {"shingles": sets}

        return work

    return map_texts(rows, make, "id long, root long, shingles binary")


def _forest(ids: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of at least the similarity: walk from each unvisited one to all that are near it.

    Common shingles are counted in lists of the sets that hold each shingle; visited sets leave the lists.
    """
    n, sizes = len(ids), np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    of_list, holders = code[order], np.repeat(np.arange(n), sizes)[order]
    left, built, found = np.ones(n, bool), 0, []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed], stack = False, [seed]
        while stack:
            live = np.count_nonzero(left)
            if not live:
                return found
            own = stack.pop()
            if 2 * live <= built or not built:
                stay = left[holders]
                of_list, holders, built = of_list[stay], holders[stay], live
                counts = np.bincount(of_list, minlength=code.max() + 1)
                starts = np.cumsum(counts) - counts
            mine = code[ends[own] - sizes[own]:ends[own]]
            many = counts[mine]
            at = np.repeat(starts[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(holders[at], minlength=n)
            near = np.flatnonzero(left & (both >= least * (sizes + sizes[own] - both) - 1e-9))
            left[near] = False
            found += [(ids[own], ids[x]) for x in near]
            stack += near.tolist()
    return found


def _links_of_batches(batches, least: float):
    """Rows sorted by (root, block): the links of each place, which may run over batches."""
    def links():
        pairs = np.array(_forest(list(met), list(met.values()), least), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    place, met = None, {}
    for batch in batches:
        for part in slices(batch, "shingles"):
            columns = (part.column(c).to_pylist() for c in ("root", "block", "id", "shingles"))
            for root, block, own, shingles in zip(*columns):
                if (root, block) != place:
                    if len(met) > 1:
                        yield links()
                    place, met = (root, block), {}
                met.setdefault(own, np.frombuffer(shingles, np.uint64))
    if len(met) > 1:
        yield links()


def candidates(nodes: DataFrame) -> DataFrame:
    """``a, b``: links that hold together all classes which SimHash or a band finds near."""
    plan = [(lane, at, SEGMENT, 0) for lane in range(LANES) for at in range(0, simhash.BITS - SEGMENT + 1, SEGMENT)]
    near = simhash.links(nodes.where("n > 0"), APART, plan, LANES)
    spots = nodes.select("id", F.explode("bands").alias("key"))
    low = spots.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    hung = spots.join(written(low.select("key", "low"), "bands").hint("merge"), "key").where("id > low")
    return near.union(hung.select(F.col("id").alias("a"), F.col("low").alias("b")))


def similar(rows: DataFrame, nodes: DataFrame, least: float, width: int) -> DataFrame:
    """``a, b``: links between the ids of ``nodes`` whose components are those of all candidates of the similarity.

    ``nodes`` is a written table: ``id, bands, n, first`` and the lanes of the SimHash, with the ``doc_id`` and ``mark`` of the row of ``rows`` that
    stands for the class.
    """
    loose = written(components(candidates(nodes)).withColumnRenamed("node", "id"), "loose")
    wanted = written(loose.join(nodes.hint("merge"), "id").select(
        "id", "root", "n", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")), "wanted")
    held = rows.join(hinter(wanted)(wanted), (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = _sets_of(held.select("id", "root", "text"), width)
    met = meet(sets, ["root"], wanted, BLOCK, weight=F.col("n"))
    return met.mapInArrow(lambda batches: _links_of_batches(batches, least), "a long, b long")


def drop_near(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one per component stays: that with the smallest id.

    Links are pairs of at least the exact Jaccard ``similarity`` of their shingle sets. Null ids come last; among rows
    that share the id, the text's hash decides, and of equal rows one stays.
    """
    mark = F.xxhash64(F.col(f"`{text_col}`"))
    rows = texts(docs, id_col, text_col, mark.alias("mark"))
    marked = written(_classes_of(rows, width), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    same_of_class = [F.first(c).alias(c) for c in ("bands", *simhash.lane_columns(LANES))]
    classes = marked.groupBy("s1", "s2", "n").agg(F.min(order).alias("first"), *same_of_class)
    nodes = written(classes.drop("s1", "s2").withColumn("id", F.monotonically_increasing_id()), "nodes")
    roots = components(similar(rows, nodes, similarity, width)).withColumnRenamed("node", "id")
    named = written(nodes.select("id", "first").join(roots.hint("merge"), "id", "left").select(
        "first", F.coalesce("root", "id").alias("root")), "roots")
    kept = written(named.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")), "kept")
    same = marked.join(
        kept.hint("merge"), (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    ties = same.groupBy(F.col("mark").alias("_mark"), F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_ties"))
    # Rows travel as one struct, so that no name of theirs can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(whole.alias("row"), mark.alias("own"), F.col(f"`{id_col}`").cast("long").alias("id"))
    found = carried.join(
        written(ties, "ties").hint("merge"), (F.col("own") == F.col("_mark")) & F.col("id").eqNullSafe(F.col("_id")))
    once = found.where("_ties = 1").unionByName(found.where("_ties > 1").dropDuplicates(["own", "_id"]))
    return once.select("row.*")
