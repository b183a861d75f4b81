"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. If two of them differ in at most ``distance`` bits, then, with r = distance // segments
and a = distance - r * segments, one of the first a + 1 segments differs in at most r bits or one of the others in at
most r - 1. Per segment a small Hamming ball around each fingerprint's value is enumerated and looked up among all
fingerprints, and complete distances are verified. No link within ``distance`` is missed.

Only distinct fingerprints take part, so groups of copies cost one row. Equal segment values meet in one place; a value
that more than ``common.HOT`` fingerprints share is dealt out as pairs of blocks. A place with many fingerprints hands on a
spanning forest of its links, never all pairs.

A fingerprint has 64 bits, or several lanes of 64 bits for a finer measure of similarity. It only estimates the
similarity of texts: ``drop_near`` searches by fingerprints of several lanes and compares the shingle sets of what it finds.

Defined cases: a null or blank text has fingerprint zero, linked like any other; a text of fewer than ``width`` words
is one shingle. Null ids take part; a component's id is the smallest non-null one. Repeated rows are reported as often
as they occur. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgeline.llm.common import map_texts, meet, shingle_hashes, texts
from judgeline.llm.components import components
from judgeline.session import written

BITS = 64
#: Groups up to this size hand on all their links, larger ones a spanning forest.
ALL_LINKS = 24
#: Groups up to this size are compared all at once.
WHOLE = 256
#: Shingle hashes whose bits are summed at once, and in one byte.
CHUNK, BYTE = 1 << 16, 255


def _lane(hashes: np.ndarray, k: int) -> np.ndarray:
    """The shingles' hashes for lane ``k``; lane 0 are the hashes themselves."""
    if not k:
        return hashes
    h = hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ones(bits: np.ndarray) -> np.ndarray:
    """Sums of the columns of a matrix of bits."""
    whole = len(bits) // BYTE * BYTE
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, BYTE, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return ones


def bits_of(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """SimHash of shingle hashes: a bit is 1 if set in over half of them."""
    n = len(hashes)
    if not n:
        return [0] * lanes
    ones = np.zeros(BITS * lanes, np.int64)
    for i in range(0, n, CHUNK):
        part = np.stack([_lane(hashes[i:i + CHUNK], k) for k in range(lanes)], axis=1).astype(">u8").view(np.uint8)
        ones += _ones(np.unpackbits(part, axis=1))
    return np.packbits(2 * ones > n).view(">u8").tolist()


def fingerprint(text: bytes, width: int, hasher, lanes: int = 1) -> list[int]:
    """SimHash of lower-cased (A-Z) white-space words, repeated shingles included."""
    return bits_of(shingle_hashes(text, width, hasher), lanes)


def lane_columns(lanes: int) -> list[str]:
    return ["fp", *[f"fp{k}" for k in range(1, lanes)]]


def simhash(
    docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None,
    lanes: int = 1,
) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long), one row per document; also ``mark`` of the row's own, and ``fp1``..."""
    names = lane_columns(lanes)

    def make():
        from xxhash import xxh64_intdigest

        def work(batch: pa.RecordBatch) -> dict:
            found = [fingerprint(t, width, xxh64_intdigest, lanes) for t in batch.column("text").to_pylist()]
            fps = np.array(found, np.uint64).reshape(-1, lanes).view(np.int64)
            passed = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            return passed | {n: np.ascontiguousarray(fps[:, k]) for k, n in enumerate(names)}

        return work

    rows = texts(docs, id_col, text_col, *([] if mark is None else [mark]))
    schema = ["doc_id long", *([] if mark is None else ["mark long"]), *[f"{n} long" for n in names]]
    return map_texts(rows, make, ", ".join(schema))


def segment_plan(distance: int, segments: int, lanes: int = 1) -> list[tuple[int, int, int, int]]:
    """(lane, shift, width, radius) of each segment; ``segments`` is a multiple of ``lanes``."""
    r, a = divmod(distance, segments)
    each = segments // lanes
    widths = [BITS // each + (i < BITS % each) for i in range(each)]
    shifts = np.cumsum([0, *widths[:-1]]).tolist()
    return [(i // each, shifts[i % each], widths[i % each], r if i <= a else r - 1) for i in range(segments)]


def segments_for(n: int) -> int:
    """Segments of about log2(n) bits, at least two: then a value has few chance meetings at any size."""
    return max(2, min(4, BITS // max(1, int(n).bit_length())))


def _probes(nodes: DataFrame, lanes: int, plan: list[tuple[int, int, int, int]]) -> DataFrame:
    """``seg, value, own, id`` and lanes: each fingerprint at its own segment values and at those near them.

    Only flips to a larger value are enumerated: of two fingerprints, the smaller looks for the larger.
    """
    names, out = lane_columns(lanes), []
    for i, (lane, shift, width, radius) in enumerate(plan):
        if radius < 0:
            continue
        value = F.shiftrightunsigned(names[lane], shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        spots = F.array(F.struct(value.alias("value"), F.lit(True).alias("own")))
        flips = [sum(1 << b for b in bits) for k in range(1, radius + 1) for bits in combinations(range(width), k)]
        if flips:
            near = F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: value.bitwiseXOR(x))
            larger = F.filter(near, lambda x: x > value)
            spots = F.concat(spots, F.transform(larger, lambda x: F.struct(x.alias("value"), F.lit(False).alias("own"))))
        out.append(nodes.select(F.lit(i).alias("seg"), F.explode(spots).alias("spot"), "id", *names).select(
            "seg", F.col("spot.value").alias("value"), F.col("spot.own").alias("own"), "id", *names))
    return reduce(DataFrame.union, out)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(ids: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """The links among ``fps`` if they are few; else a spanning forest: walk from each unvisited one to all that are near it."""
    ids, at = np.unique(ids, return_index=True)
    fps, found = fps[at], []
    if len(ids) <= WHOLE:
        a, b = np.nonzero(np.triu(_apart(fps[:, None], fps[None]) <= distance, 1))
        if len(a) <= 4 * len(ids):
            return list(zip(ids[a], ids[b]))
    while len(ids) > 1:
        stack, ids, fps = [(ids[0], fps[0])], ids[1:], fps[1:]
        while stack and len(ids):
            own, bits = stack.pop()
            near = _apart(fps, bits[None]) <= distance
            if near.any():
                found += [(own, x) for x in ids[near]]
                stack += list(zip(ids[near], fps[near]))
                ids, fps = ids[~near], fps[~near]
    return found


def _links_of(cuts: np.ndarray, owns: np.ndarray, ids: np.ndarray, fps: np.ndarray, distance: int) -> pa.RecordBatch:
    """Links found in each group; ``cuts`` are the groups' first rows."""
    ends = np.append(cuts[1:], len(ids))
    sizes = ends - cuts
    meets = (sizes > 1) & (np.add.reduceat(owns.astype(np.int64), cuts) > 0)
    a_all, b_all = [], []
    inside = np.repeat(meets & (sizes <= ALL_LINKS), sizes)
    group, f, n = np.repeat(np.arange(len(cuts)), sizes)[inside], fps[inside], ids[inside]
    for step in range(1, ALL_LINKS):
        same = np.flatnonzero(group[step:] == group[:-step]) if len(group) > step else np.zeros(0, np.int64)
        if not len(same):
            break
        ok = same[(_apart(f[same], f[same + step]) <= distance) & (n[same] != n[same + step])]
        a_all.append(n[ok])
        b_all.append(n[ok + step])
    for i in np.flatnonzero(meets & (sizes > ALL_LINKS)):
        pairs = np.array(_forest(ids[cuts[i]:ends[i]], fps[cuts[i]:ends[i]], distance), np.int64).reshape(-1, 2)
        a_all.append(pairs[:, 0])
        b_all.append(pairs[:, 1])
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_pydict({"a": np.concatenate(a_all or none), "b": np.concatenate(b_all or none)})


def _links_of_batches(batches, distance: int, names: list[str]):
    """Rows sorted by (seg, value, block): links found in each group; a group may run over batches."""
    keep = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("seg", "value", "block", "own", "id", *names)]
        if keep is not None:
            cols = [np.concatenate(p) for p in zip(keep, cols)]
        change = np.ones(len(cols[0]), bool)
        change[1:] = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)
        cuts = np.flatnonzero(change)
        last = int(cuts[-1])
        keep = [c[last:] for c in cols]
        if last:
            fps = np.stack([c[:last].view(np.uint64) for c in cols[5:]], axis=1)
            yield _links_of(cuts[:-1], cols[3][:last], cols[4][:last], fps, distance)
    if keep is not None:
        fps = np.stack([c.view(np.uint64) for c in keep[5:]], axis=1)
        yield _links_of(np.zeros(1, np.int64), keep[3], keep[4], fps, distance)


def links(nodes: DataFrame, distance: int, plan: list[tuple[int, int, int, int]], lanes: int = 1) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of fingerprints at most ``distance`` bits apart.

    ``nodes`` has ``id`` and the lanes of distinct fingerprints and should be a written table, as it is read again.
    """
    names = lane_columns(lanes)
    spots = _probes(nodes, lanes, plan)
    met = meet(spots, ["seg", "value"], spots.where("own"))
    return met.mapInArrow(lambda batches: _links_of_batches(batches, distance, names), "a long, b long")


def _with_roots(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``root``, the component of each node."""
    roots = components(found).withColumnRenamed("node", "id")
    return nodes.join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def near_duplicates(
    docs: DataFrame, distance: int = 3, width: int = 5, id_col: str = "doc_id", text_col: str = "text",
    segments: int | None = None,
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; the component's id is its smallest document id."""
    marked = written(simhash(docs, width, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    found = links(nodes, distance, segment_plan(distance, segments or segments_for(nodes.count())))
    named = written(_with_roots(nodes, found), "roots")
    lowest = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    classes = written(named.join(lowest.hint("merge"), "root").select("fp", "component_id"), "classes")
    return marked.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    """16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` of which one per group of near copies stays, see ``minhash.drop_near``."""
    from judgeline.llm import minhash  # which builds on this module

    return minhash.drop_near(docs, similarity, width, id_col, text_col)
