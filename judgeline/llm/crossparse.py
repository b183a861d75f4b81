"""Language identification by cross-parsing.

A suffix automaton is built over labelled text of each language. A text is parsed greedily into the longest phrases that
occur in that text; the language that needs the fewest phrases, normalised as phrases * log2(sample size) / length,
wins. Texts are parsed in lock-step: a batch is cut into windows, all windows take one step at a time through a dense
transition table, and a missing transition starts a new phrase. Windows of a text are summed, so whole texts count.

Fitting: the bound is ``rows_per_lang`` labelled rows and ``sample_bytes`` bytes per language. Rows are chosen by a hash of
the id among all labelled rows; each gives an equal share of the bytes, from a place in its text that the hash chooses as
well, so that no part of a text and no range of ids is preferred. The automata then need at most 2 * sample_bytes states
times the bytes in use.

Defined cases: a text that is null or has no letter, and any text when nothing was learned, is ``und`` with score 0.
Ties go to the first language by code point. Null ids pass through; repeated rows get equal answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgeline.llm.common import slices, texts

ROWS_PER_LANG, SAMPLE_BYTES = 64, 32_768
WINDOW = 512
UNDETERMINED = "und"
#: Classes of bytes: padding stays where it is and is never a miss, unseen bytes always are.
PAD, UNSEEN = 0, 1


def suffix_automaton(data: bytes) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links; state 0 is the empty string."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in data:
        now = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step, link


class Parser:
    """Dense automata of several languages over shared byte classes."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.langs = [lang for lang, _ in samples]
        used = sorted(set(b"".join(data for _, data in samples)))
        self.classes = np.full(256, UNSEEN, np.uint8)
        self.classes[used] = np.arange(2, len(used) + 2)
        self.width = width = len(used) + 2
        self.tables, self.bits = [], []
        for _, data in samples:
            step, _ = suffix_automaton(data)
            flat = np.full((len(step), width), -1, np.int32)
            rows = np.repeat(np.arange(len(step)), [len(s) for s in step])
            keys = np.fromiter((c for s in step for c in s), np.int64, len(rows))
            flat[rows, self.classes[keys]] = np.fromiter((v for s in step for v in s.values()), np.int64, len(rows))
            del step, rows, keys
            missing = flat < 0
            root = np.where(flat[0] < 0, 0, flat[0])
            root[PAD] = 0
            flat *= width
            np.copyto(flat, np.broadcast_to(~(root * width), flat.shape), where=missing)
            flat[:, PAD] = 0
            self.tables.append(flat.ravel())
            self.bits.append(np.log2(max(2, len(data))))

    def phrases(self, data: list[bytes]) -> np.ndarray:
        """Phrases that each text (row) needs in each language (column)."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        lanes = (sizes + WINDOW - 1) // WINDOW
        owner = np.repeat(np.arange(len(data)), lanes)
        cells = np.full(int(lanes.sum()) * WINDOW, PAD, np.uint8)
        starts = np.concatenate(([0], np.cumsum(lanes)[:-1])) * WINDOW
        for text, at in zip(data, starts.tolist()):
            cells[at:at + len(text)] = self.classes[np.frombuffer(text, np.uint8)]
        steps = np.ascontiguousarray(cells.reshape(-1, WINDOW).T).astype(np.int32)
        out = np.zeros((len(data), len(self.langs)), np.int64)
        for k, table in enumerate(self.tables):
            state, spot = np.zeros(len(owner), np.int32), np.empty(len(owner), np.int32)
            sign, misses = np.empty(len(owner), np.int32), np.ones(len(owner), np.int32)
            for row in steps:
                np.add(state, row, out=spot)
                table.take(spot, out=state, mode="clip")
                np.right_shift(state, 31, out=sign)
                misses -= sign
                np.bitwise_xor(state, sign, out=state)
            out[:, k] = np.bincount(owner, misses, len(data)) if len(owner) else 0
        return out

    def rates(self, data: list[bytes]) -> np.ndarray:
        """Normalised phrases: bits per byte that a parse into sample positions would need."""
        sizes = np.maximum(1, np.fromiter(map(len, data), np.int64, len(data)))
        return self.phrases(data) * np.array(self.bits) / sizes[:, None]


_held: dict[tuple, Parser] = {}


def parser(samples: tuple[tuple[str, bytes], ...]) -> Parser:
    """One parser per worker process; that of other samples is given up before a new one is built."""
    if samples not in _held:
        _held.clear()
        _held[samples] = Parser(samples)
    return _held[samples]


def learn_samples(
    labelled: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
    rows_per_lang: int = ROWS_PER_LANG, sample_bytes: int = SAMPLE_BYTES,
) -> tuple[tuple[str, bytes], ...]:
    """Bounded text per language from rows with a language; only that text comes to the driver.

    Candidates are numbered on narrow rows (``row_number() <= n`` is cut before the shuffle), and texts are read for the
    chosen ids only. A row's share is ``sample_bytes`` by the number of rows chosen for its language; a shorter text is
    taken whole.
    """
    text = F.col(f"`{text_col}`")
    rows = labelled.where(F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
        text.alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("lang", "id").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= rows_per_lang)
    texts_of = rows.join(chosen.drop("rn").distinct(), ["lang", "id"], "left_semi").where(text_has_letter(F.col("text")))
    # Code points: at least as many as the bytes that a row can give, with the lowest number of rows that a language has.
    start = F.pmod(F.xxhash64("id", F.lit("window")), F.greatest(F.length("text") - F.col("share") + 1, F.lit(1))) + 1
    sizes = chosen.groupBy("lang").agg(F.floor(F.lit(sample_bytes) / F.count(F.lit(1))).cast("int").alias("share"))
    cut = texts_of.join(sizes, "lang").select(
        "lang", "id", "share", F.substring("text", start.cast("int"), F.col("share")).alias("text")).distinct()
    found: dict[str, list] = {}
    for r in cut.collect():
        found.setdefault(r["lang"], []).append((r["id"], r["text"].encode().lower()[:r["share"] - 1]))
    return tuple((lang, b"\n".join(t for _, t in sorted(found[lang]))) for lang in sorted(found) if lang != UNDETERMINED)


def bit_bounds(
    labelled: DataFrame, margin: float = 1.25, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """``lang_pred, most``: the bits per byte beyond which a text is in no learned language.

    Half of the labelled rows (by a hash of the id) teach, all others are parsed: a text must not be measured by a sample
    that it is part of. The bound of a language is ``margin`` times the most bits that any of its texts needs, of those
    that are recognised as that language. At most one row per learned language; a language without one has no bound.
    """
    teaches = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.lit("half")), F.lit(2)) == 0
    samples = learn_samples(labelled.where(teaches), id_col, lang_col, text_col)
    lang = F.col(f"`{lang_col}`").cast("string").alias("lang")
    rows = labelled.where(~teaches & F.col(f"`{lang_col}`").isNotNull()).select(
        text_has_letter(F.col(f"`{text_col}`")).alias("letter"), lang, F.col(f"`{text_col}`").cast("binary").alias("text"))
    judged = _mapped(rows, samples, "lang", lambda batch: batch.column("text").cast(pa.binary()).fill_null(b""))
    return judged.where("lang = lang_pred").groupBy("lang_pred").agg((F.max("bits") * margin).alias("most"))


def text_has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _judge(samples: tuple[tuple[str, bytes], ...]):
    """A function from texts and whether they have a letter to (languages, scores, bits)."""
    tool = parser(samples) if samples else None

    def judge(data: list[bytes], letter: np.ndarray):
        n = len(data)
        lang, score, bits = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n)
        if tool and n:
            rates = tool.rates([t.lower() for t in data])
            best = rates.argmin(axis=1)
            low = rates[np.arange(n), best]
            rates[np.arange(n), best] = np.inf
            after = rates.min(axis=1)
            share = np.where(np.isfinite(after), 1 - low / np.maximum(after, 1e-12), 1.0)
            lang[letter] = np.array(tool.langs, object)[best[letter]]
            score, bits = np.where(letter, np.clip(share, 0, 1), 0.0), np.where(letter, low, 0.0)
        return lang.tolist(), score, bits

    return judge


def identify_rows(
    docs: DataFrame, samples: tuple[tuple[str, bytes], ...], text_col: str = "text",
) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``lang_pred, score, bits`` for every row.

    ``score`` is how far the best language lies before the next (0 to 1); ``bits`` is what its parse needs per byte.
    Texts travel once, inside ``row``.
    """
    letter = text_has_letter(F.col(f"`{text_col}`")).alias("letter")
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), letter)
    return _mapped(rows, samples, "row", lambda batch: batch.column("row").field(text_col).cast(pa.binary()).fill_null(b""))


def identify(
    docs: DataFrame, samples: tuple[tuple[str, bytes], ...], id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, lang_pred, score, bits`` for every row."""
    letter = text_has_letter(F.col(f"`{text_col}`")).alias("letter")
    return _mapped(texts(docs, id_col, text_col, letter), samples, "doc_id", lambda batch: batch.column("text"))


def _mapped(rows: DataFrame, samples: tuple[tuple[str, bytes], ...], passed: str, text_of) -> DataFrame:
    def run(batches):
        judge = _judge(samples)
        for batch in batches:
            for part in slices(batch, sizes=pc.binary_length(text_of(batch))):
                letter = part.column("letter").to_numpy(zero_copy_only=False).astype(bool)
                lang, score, bits = judge(text_of(part).to_pylist(), letter)
                yield pa.RecordBatch.from_arrays(
                    [part.column(passed), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)],
                    names=[passed, "lang_pred", "score", "bits"])

    schema = T.StructType(rows.select(passed).schema.fields + T.StructType.fromDDL(
        "lang_pred string, score double, bits double").fields)
    return rows.mapInArrow(run, schema)
