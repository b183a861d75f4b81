"""Substring deduplication by relative parsing against indexed reference blocks.

A document is parsed into factors that occur in documents with a smaller id; factors of at least ``window`` words are
duplicate spans. Every window of ``window`` words is routed to one reference block by its rarest-hash phrase of ``gram``
words (its anchor): equal windows have equal anchors, so they meet in one block, and each document is parsed against
just those blocks that can hold its windows. A block indexes the windows of its anchors by the smallest document that
has them; consecutive windows of a document that are found there make a factor. Factors from different blocks are
joined where they touch or overlap, so nothing is lost at their boundaries.

Windows are compared by hashes of their bytes (anchor 64 bits, window 48 bits within an anchor). Rows of an anchor are
streamed in order of ids; what is kept of them is one entry per different window, so a passage that a third of all
documents share needs no more memory than one that two share. Copies met again in one task are settled there.

Defined cases: a null or blank text has no words. A null id counts as the smallest. Rows that share an id never remove
words of each other; they are told apart by their text. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgeline.llm.common import SLICE_BYTES, slices, texts

#: Words per window and per anchor phrase.
WINDOW, GRAM = 13, 4
#: Bytes of a window's hash that travel.
CHECK = 6
#: Texts are hashed in pieces of so many words, and so many bytes at a time.
PIECE_WORDS, PIECE_BYTES = 100_000, 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
NO_ID = -(2**63)
#: Shift of the text's mark in ``place``; below it is the number of the first window.
MARK = 40


class PrefixHash:
    """Hashes of all word ranges of a buffer, from prefix sums of byte * BASE^position modulo 2^64."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int):
        if len(self.power) < n:
            size = max(n, 2 * PIECE_BYTES)
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            self.power = np.multiply.accumulate(steps)
            steps[1:] = pow(BASE, -1, 2**64)
            self.inverse = np.multiply.accumulate(steps)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (sums[stop] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def _pieces(batch: pa.RecordBatch, window: int):
    """(doc, mark, first word, bytes) of texts with at least one window, words joined by one space."""
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        words = text.split()
        mark = crc32(text) & 0xFFFF
        for i in range(0, len(words) - window + 1, PIECE_WORDS):
            yield NO_ID if doc is None else doc, mark, i, b" ".join(words[i:i + PIECE_WORDS + window - 1])


class _Met:
    """Runs of windows that a task has met more than once, with the smallest document that has them; bounded."""

    LIMIT = 200_000

    def __init__(self):
        self.keys, self.least = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def settle(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which of the runs are known from a smaller document, of this batch or of an earlier one."""
        order = np.lexsort((docs, keys))
        k, d = keys[order], docs[order]
        lead = np.ones(len(k), bool)
        lead[1:] = k[1:] != k[:-1]
        heads = np.flatnonzero(lead)
        least = d[heads]
        at = np.minimum(np.searchsorted(self.keys, k[heads]), max(0, len(self.keys) - 1))
        if len(self.keys):
            known = self.keys[at] == k[heads]
            least = np.where(known, np.minimum(least, self.least[at]), least)
        settled = np.empty(len(k), bool)
        settled[order] = d > least[np.cumsum(lead) - 1]
        again = np.diff(np.append(heads, len(k))) > 1
        if again.any():
            if len(self.keys) + again.sum() > self.LIMIT:
                self.__init__()
            both = np.concatenate((self.keys, k[heads][again]))
            mins = np.concatenate((self.least, least[again]))
            order = np.lexsort((mins, both))
            both, mins = both[order], mins[order]
            first = np.ones(len(both), bool)
            first[1:] = both[1:] != both[:-1]
            self.keys, self.least = both[first], mins[first]
        return settled


def _rows_of(group, tool: PrefixHash, met: _Met, window: int, gram: int) -> pa.RecordBatch:
    """One row per run of windows with the same anchor: ``anchor, doc, place, n, windows``.

    ``n`` is 0 for rows to be looked up, else the words of a factor that is settled already (without windows).
    """
    data = np.frombuffer(b" ".join(g[3] for g in group), np.uint8)
    spaces = np.flatnonzero(data == 32)
    start, stop = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(data)]))
    counts = np.array([g[3].count(b" ") + 1 for g in group])
    ends = np.cumsum(counts)
    piece = np.repeat(np.arange(len(group)), counts)
    sums = tool.sums(data)
    grams = tool.ranges(sums, start[:len(start) - gram + 1], stop[gram - 1:])
    spread = window - gram + 1
    lowest = np.lib.stride_tricks.sliding_window_view(grams, spread).argmin(axis=1)
    at = np.arange(len(lowest))
    at = at[at + window <= ends[piece[at]]]
    anchor_at = at + lowest[at]
    hashes = tool.ranges(sums, start[at], stop[at + window - 1])
    first = np.ones(len(at), bool)
    first[1:] = (anchor_at[1:] != anchor_at[:-1]) | (at[1:] != at[:-1] + 1)
    cuts = np.flatnonzero(first)
    sizes = np.diff(np.append(cuts, len(at)))
    own = piece[at[cuts]]
    docs = np.array([g[0] for g in group], np.int64)[own]
    anchor = grams[anchor_at[cuts]]
    key = (anchor ^ (np.add.reduceat(hashes, cuts) * np.uint64(BASE))) + sizes.astype(np.uint64)
    done = met.settle(key, docs)
    anchor = np.where(done, (hashes[cuts] ^ np.uint64(0x5DEECE66D)) * np.uint64(BASE) + docs.view(np.uint64), anchor)
    bytes_ = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :CHECK])[~np.repeat(done, sizes)]
    offsets = (np.concatenate(([0], np.cumsum(np.where(done, 0, sizes)))) * CHECK).astype(np.int32)
    words_before = np.array([g[2] for g in group]) - (ends - counts)
    marks = np.array([g[1] for g in group], np.int64)[own] << MARK
    return pa.RecordBatch.from_arrays([
        pa.array(anchor.view(np.int64)), pa.array(docs), pa.array(marks + at[cuts] + words_before[own]),
        pa.array(np.where(done, sizes + window - 1, 0).astype(np.int32)),
        pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])],
        names=["anchor", "doc", "place", "n", "windows"])


def anchored_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All windows of ``doc_id, text`` by anchor."""
    def run(batches):
        tool, met, group, size = PrefixHash(), _Met(), [], 0
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                for piece in _pieces(part, window):
                    group.append(piece)
                    size += len(piece[3])
                    if size > PIECE_BYTES:
                        yield _rows_of(group, tool, met, window, gram)
                        group, size = [], 0
        if group:
            yield _rows_of(group, tool, met, window, gram)

    return docs.mapInArrow(run, "anchor long, doc long, place long, n int, windows binary")


def _wide(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows as numbers, windows per row) of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, CHECK)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :CHECK] = raw
    return full.view(np.uint64).ravel(), np.diff(offsets) // CHECK


def _parse_block(batches, window: int):
    """Rows sorted by (anchor, doc): factors ``doc, place, stop`` found in the block."""
    kept = (0, np.zeros(0, np.uint64), np.zeros(0, np.int64))  # anchor, its windows so far, their smallest documents
    for batch in batches:
        settled = batch.filter(pc.greater(batch.column("n"), 0))
        if settled.num_rows:
            yield pa.RecordBatch.from_pydict({
                "doc": settled.column("doc"), "place": settled.column("place"), "n": settled.column("n").cast(pa.int64())})
        batch = batch.filter(pc.equal(batch.column("n"), 0))
        if not batch.num_rows:
            continue
        anchor, doc, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "doc", "place"))
        hashes, counts = _wide(batch.column("windows"))
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        group = np.cumsum(new) - 1
        rows = np.arange(len(anchor))
        goes_on = len(kept[1]) > 0 and kept[0] == anchor[0]
        meets = np.bincount(group)[group] > 1
        if goes_on:
            meets |= group == 0
        last = group == group[-1]
        use = np.repeat(meets | last, counts)
        owner = np.repeat(rows, counts)[use]
        offset = np.concatenate(([0], np.cumsum(counts)[:-1]))
        nth = (np.arange(len(use)) - np.repeat(offset, counts))[use]
        win, docs, key = hashes[use], doc[owner], group[owner]
        if goes_on:
            n = len(kept[1])
            win, docs = np.concatenate((kept[1], win)), np.concatenate((kept[2], docs))
            key = np.concatenate((np.zeros(n, key.dtype), key))
        order = np.lexsort((docs, win, key))
        w, d, k = win[order], docs[order], key[order]
        lead = np.ones(len(w), bool)
        lead[1:] = (w[1:] != w[:-1]) | (k[1:] != k[:-1])
        heads = np.flatnonzero(lead)
        least = d[heads][np.cumsum(lead) - 1]
        found = np.empty(len(w), bool)
        found[order] = d > least
        tail = heads[k[heads] == group[-1]]
        kept = (anchor[-1], w[tail], d[tail])
        if goes_on:
            found = found[n:]
        hit_row, hit_at = owner[found], nth[found]
        if not len(hit_row):
            continue
        opens = np.ones(len(hit_row), bool)
        opens[1:] = (hit_row[1:] != hit_row[:-1]) | (hit_at[1:] != hit_at[:-1] + 1)
        begin = np.flatnonzero(opens)
        finish = np.append(begin[1:], len(hit_row)) - 1
        row = hit_row[begin]
        yield pa.RecordBatch.from_pydict({
            "doc": doc[row], "place": place[row] + hit_at[begin],
            "n": (hit_at[finish] - hit_at[begin] + window).astype(np.int64)})


def duplicate_factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc, place, n``: factors of ``n`` words; ``place`` holds the text's mark and the first word's number."""
    routed = anchored_windows(docs, window, gram)
    blocks = routed.repartition("anchor").sortWithinPartitions("anchor", "doc")
    return blocks.mapInArrow(lambda batches: _parse_block(batches, window), "doc long, place long, n long")


def _packed(rows: DataFrame) -> DataFrame:
    """``doc_id, mark_of, packed``: texts compressed for their way through the shuffle."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark_of"),
                     pa.array(map(pack, part.column("text").to_pylist()), pa.binary())],
                    names=["doc_id", "mark_of", "packed"])

    return rows.mapInArrow(run, "doc_id long, mark_of long, packed binary")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` for every row: the words outside duplicate spans, joined by one space."""
    rows = texts(docs, id_col, text_col)
    factors = duplicate_factors(rows, window, gram)
    mark = F.crc32("text").bitwiseAND(F.lit(0xFFFF).cast("long"))
    first = F.col("place").bitwiseAND(F.lit((1 << MARK) - 1))
    spans = factors.groupBy("doc", F.shiftright("place", MARK).alias("mark")).agg(
        F.array_sort(F.collect_list(F.struct(first.alias("a"), (first + F.col("n")).alias("b")))).alias("spans"))
    both = _packed(rows.withColumn("mark_of", mark)).withColumn("place_id", F.coalesce("doc_id", F.lit(NO_ID))).join(
        spans, (F.col("place_id") == F.col("doc")) & (F.col("mark_of") == F.col("mark")), "left")
    ready = both.select(
        "doc_id", "packed", F.coalesce("spans.a", F.array().cast("array<long>")).alias("a"),
        F.coalesce("spans.b", F.array().cast("array<long>")).alias("b"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, "packed", SLICE_BYTES // 4):
                out = {"doc_id": part.column("doc_id"), "n_words": [], "n_removed": [], "text": []}
                spans_of = (part.column(c).to_pylist() for c in ("a", "b"))
                for packed, a, b in zip(part.column("packed").to_pylist(), *spans_of):
                    words, kept, at = unpack(packed).split(), [], 0
                    for x, y in zip(a, b):
                        kept += words[at:x]
                        at = max(at, y)
                    kept += words[at:]
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(kept))
                    out["text"].append(b" ".join(kept).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_pydict(out)

    return ready.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
