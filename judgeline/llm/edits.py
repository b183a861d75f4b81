"""Document fingerprints by a randomised edit embedding.

One random walk, shared by all texts, reads a text character by character and writes it out with repetitions: at output
place p the character c is written, and the reading moves on if the shared random bit of (p, c) is 1. Texts that differ
by few edits fall back into step, so their outputs differ in few places: edit distance becomes Hamming distance.

A fingerprint samples bits of the output: 64 places in each octave [2^k, 2^(k+1)) of places, every place below 64, each
hashed with its character to one bit. Likeness compares the octaves, weighted by the places that they stand for; chance
agreement counts as 0. For near-duplicates, whole octave words serve as bands, and candidates are verified by likeness.

Defined cases: a null text equals the empty one, whose fingerprint is ``00000000``. Two empty texts have likeness 1, an
empty and another one 0. Documents are ordered by id, null ids first, equal ids by text; a single document follows
itself. Repeated rows take part as often as they occur. Empty tables give empty results.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgeline.llm.common import map_texts, meet, texts
from judgeline.llm.components import components
from judgeline.session import written

#: Shared random bits repeat after so many places; characters fall into so many classes.
PERIOD, CLASSES = 1024, 256
#: Sampled bits per octave of output places.
WORD = 64
SEED = 20_240_917
#: Blocks that the ids are cut into, at most; a block is streamed, so its size is no matter of memory.
MOST_BLOCKS = 4096


class Walk:
    """The shared walk: where reading one character leads from each output place (modulo the period)."""

    def __init__(self, seed: int = SEED):
        random = np.random.default_rng(seed)
        moves = random.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
        places = list(range(PERIOD))
        self.rows = []
        for bits in moves:
            bits[-1] = 1  # no character is written for longer than the period
            ones = np.flatnonzero(bits)
            following = (ones[np.searchsorted(ones, np.arange(PERIOD))] + 1) % PERIOD
            self.rows.append([places[i] for i in following.tolist()])
        self.of = _Rows(self.rows)
        self.samples = [np.arange(WORD)]
        for k in range(6, 62):
            inside = np.random.default_rng([seed, k]).choice(1 << min(k, 40), WORD, replace=False)
            self.samples.append(np.sort(inside) + (1 << k))

    def go(self, text: str, at: int = 0) -> array:
        """Places modulo the period after each character of ``text``, starting at ``at``."""
        out = array("H")
        put, of = out.append, self.of
        for c in text:
            at = of[c][at]
            put(at)
        return out

    def fingerprint(self, text: str, track: array) -> tuple[int, np.ndarray]:
        """(length of the output, sampled words); places beyond the end give 0 bits."""
        if not text:
            return 0, np.zeros(0, np.uint64)
        after = np.frombuffer(track, np.uint16).astype(np.int64)
        steps = np.diff(after, prepend=0) % PERIOD
        steps[steps == 0] = PERIOD
        ends = np.cumsum(steps)
        length = int(ends[-1])
        octaves = max(0, length - 1).bit_length() - 6
        places = np.concatenate(self.samples[:1 + max(0, octaves)])
        inside = places < length
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars = codes[np.searchsorted(ends, places[inside], side="right")].astype(np.uint64)
        mixed = chars * np.uint64(0x9E3779B97F4A7C15) + places[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        bits = np.zeros(len(places), np.uint8)
        bits[inside] = (mixed >> np.uint64(63)).astype(np.uint8)
        return length, np.packbits(bits).view(">u8").astype(np.uint64)


class _Rows(dict):
    def __init__(self, rows):
        super().__init__()
        self.all = rows

    def __missing__(self, c: str):
        row = self[c] = self.all[(ord(c) * 2_654_435_761 >> 8) % CLASSES]
        return row


@lru_cache(maxsize=2)
def walk(seed: int = SEED) -> Walk:
    return Walk(seed)


def as_text(length: int, words: np.ndarray) -> str:
    """Eight or more hex digits of the output's length, then 16 per word."""
    return f"{length:08x}" + "".join(f"{int(w):016x}" for w in words)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], samples: list[np.ndarray]) -> float:
    """1 for equal outputs, about 0 for unrelated ones, by the share of output places that agree."""
    longer, shorter = max(a[0], b[0]), min(a[0], b[0])
    if not longer:
        return 1.0
    differ = 0.0
    for k in range(max(len(a[1]), len(b[1]))):
        low = 0 if k == 0 else 1 << (k + 5)
        weight = min(longer, 1 << (k + 6)) - low
        both = int(np.searchsorted(samples[k], shorter))
        any_ = int(np.searchsorted(samples[k], longer))
        if weight <= 0 or not any_:
            continue
        wrong = 0
        if both:
            x = (int(a[1][k]) ^ int(b[1][k])) >> (WORD - both)
            wrong = 2 * x.bit_count()
        differ += weight * min(1.0, (wrong + any_ - both) / any_)
    return max(0.0, 1.0 - differ / longer)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``doc_id, length, words, fingerprint`` for every row; ``words`` are the sampled bits as signed longs."""
    def make():
        tool = walk(seed)

        def work(batch: pa.RecordBatch) -> dict:
            marks = [tool.fingerprint(t, tool.go(t)) for t in (t.decode("utf-8", "replace") for t in batch.column("text").to_pylist())]
            return {
                "doc_id": batch.column("doc_id"), "length": [m[0] for m in marks],
                "words": [m[1].view(np.int64).tolist() for m in marks], "fingerprint": [as_text(*m) for m in marks]}

        return work

    return map_texts(
        texts(docs, id_col, text_col), make, "doc_id long, length long, words array<long>, fingerprint string")


def near_documents(
    docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", band_bits: int = 16,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: components of documents whose likeness is ``least`` or more.

    Only distinct fingerprints are compared. A band is ``band_bits`` sampled bits of one octave; fingerprints that share
    a band meet and are verified by their likeness. Places with many fingerprints hand on a spanning forest of links.
    """
    marked = written(sketches(docs, id_col, text_col), "sketches")
    nodes = written(marked.groupBy("fingerprint").agg(
        F.min("doc_id").alias("first"), F.first("length").alias("length"), F.first("words").alias("words")).withColumn(
            "id", F.monotonically_increasing_id()), "nodes")
    word = nodes.select("id", "length", "words", F.posexplode_outer("words").alias("octave", "word"))
    mask = F.lit((1 << band_bits) - 1).cast("long")
    parts = F.array(*[
        F.struct(F.lit(i).alias("part"), F.shiftrightunsigned("word", i * band_bits).bitwiseAND(mask).alias("bits"))
        for i in range(WORD // band_bits)])
    bands = word.select("id", "length", "words", "octave", F.explode(parts).alias("b")).select(
        F.coalesce("octave", F.lit(-1)).alias("octave"), F.col("b.part").alias("part"),
        F.coalesce("b.bits", F.lit(0)).alias("bits"), "id", "length", "words")
    keys = ["octave", "part", "bits"]
    met = meet(bands, keys, bands)
    found = met.mapInArrow(lambda batches: _verified(batches, [*keys, "block"], least), "a long, b long")
    roots = components(found).withColumnRenamed("node", "id")
    named = written(nodes.select("id", "fingerprint", "first").join(roots.hint("merge"), "id", "left").withColumn(
        "root", F.coalesce("root", "id")), "roots")
    lowest = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    classes = written(named.join(lowest.hint("merge"), "root").select("fingerprint", "component_id"), "classes")
    return marked.join(classes.hint("merge"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def _verified(batches, keys: list[str], least: float):
    """Rows sorted by ``keys``: a spanning forest of the links of each group."""
    samples, group, at = walk().samples, [], None

    def forest():
        left, out = group, []
        while len(left) > 1:
            stack, left = [left[0]], left[1:]
            while stack and left:
                own = stack.pop()
                near = [likeness(own[1], x[1], samples) >= least for x in left]
                stack += [x for x, y in zip(left, near) if y]
                out += [(own[0], x[0]) for x, y in zip(left, near) if y]
                left = [x for x, y in zip(left, near) if not y]
        return out

    for batch in batches:
        links = []
        columns = [batch.column(c).to_pylist() for c in keys]
        rows = zip(zip(*columns), *(batch.column(c).to_pylist() for c in ("id", "length", "words")))
        for key, node, length, words in rows:
            if key != at:
                links += forest()
                group, at = [], key
            group.append((node, (length, np.array(words, np.int64).view(np.uint64))))
        yield _pairs(links)
    yield _pairs(forest())


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Partitions of whole blocks of consecutive ids: ``block, guest, doc_id, text``, sorted.

    Blocks begin at ids that split the table evenly (a bounded list of them comes to the driver). The first rows of each
    block visit the block before as ``guest`` rows, the first of all the last block, so that every row finds the next
    one beside it. Texts are shuffled once.
    """
    rows = texts(docs, id_col, text_col)
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    parts = min(MOST_BLOCKS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("id"))
    found = ids.agg(
        F.min("id").alias("low"), F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts"))
    first = found.head()
    low, cuts = first["low"], sorted({*(first["cuts"] or [])} - {first["low"]})
    starts = [low, *cuts] if low is not None else []
    block = _block(order, cuts)
    own = rows.select(block.alias("block"), F.lit(0).alias("guest"), order.alias("place"), "doc_id", "text")
    guests = own.where(F.col("place").isin(starts)).withColumn(
        "block", F.when(F.col("block") == 0, F.lit(max(0, len(starts) - 1))).otherwise(F.col("block") - 1)).withColumn(
            "guest", F.lit(1))
    both = own.union(guests) if starts else own
    return both.repartition("block").sortWithinPartitions("block", "guest", "place", "text")


def _block(order, cuts):
    """Number of cuts at or below ``order``, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    low = _block(order, cuts[:mid])
    high = _block(order, cuts[mid + 1:])
    return F.when(order >= cuts[mid], high + (mid + 1)).otherwise(low)


def fingerprints_with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
) -> DataFrame:
    """Every document with an edited form of itself and with the next document.

    The edited text has its last quarter of characters replaced by as many from the beginning of the next document.
    ``doc_id, n_chars, edited (binary), fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    def run(batches):
        tool = walk(seed)

        def sketched(text):
            track = tool.go(text)
            return text, track, tool.fingerprint(text, track)

        def row(doc_id, own, after):
            text, track, mark = own
            head = len(text) - len(text) // 4
            tail = after[0][:len(text) - head]
            edited = text[:head] + tail
            changed = track[:head] + tool.go(tail, track[head - 1] if head else 0)
            edit_mark = tool.fingerprint(edited, changed)
            return (
                doc_id, len(text), edited.encode(), as_text(*mark), as_text(*edit_mark),
                likeness(mark, edit_mark, tool.samples), likeness(mark, after[2], tool.samples))

        out, size, held, block, closed = [], 0, None, None, False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "guest", "doc_id")]
            data = batch.column("text")
            for i, (b, guest, doc_id) in enumerate(zip(*columns)):
                if b == block and closed:
                    continue
                now = sketched(data[i].as_py().decode("utf-8", "replace"))
                if b == block:
                    out.append(row(held[0], held[1], now))
                    size += 2 * len(out[-1][2]) + 4096
                block, held, closed = b, (doc_id, now), bool(guest)
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    return in_order(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _FIELDS))


_FIELDS = (
    ("doc_id", "long"), ("n_chars", "long"), ("edited", "binary"), ("fingerprint", "string"),
    ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), _FIELDS)], [n for n, _ in _FIELDS])
