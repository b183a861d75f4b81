"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

The model predicts the class of a word from the classes of the words before it. Classes are the most frequent words, the
end of a text, and buckets of all other words by their last bytes; within a bucket a word has its smoothed share of the
bucket's counts, so probabilities are normalised over all words. Each of the ``width`` positions before a word has a
matrix; the context vector is the sum of the earlier words' vectors, each times the matrix of its position, and scores
are bilinear: s(h, w) = (C_1 r_1 + ... + C_n r_n) . t_w + b_w. Products of all context and target vectors, one table per
position, give the log-probabilities of all classes, which are normalised place by place.

Training has two steps. The counts of all neighbouring classes give the vectors of a model with the first position alone
(the noise term is taken in expectation). From there every task passes once over its training texts and takes Adagrad
steps of noise-contrastive estimation on batches of whole contexts, with noise classes shared within a batch; they move
matrices, target vectors and biases, while the context vectors stay those of the first step. The tasks' models are averaged by their numbers of tokens, in two rounds of sums, so that a bounded list reaches the driver.

Counts of words and of neighbouring classes cover all training texts and grow with them; words are summed in tasks before
they are shuffled. ``HOT_WORDS`` of the most frequent words (a bound on what is broadcast, not on what is counted) are
looked up in place; rarer ones meet their counts in a join, one row per text and word.

Defined cases: a null or blank text is its end alone. Without training texts every probability is that of the smoothed
empty distribution. Null ids pass through; repeated rows get equal scores and count as often as they occur in training.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgeline.llm.common import slices, texts
from judgeline.session import written

#: Words looked up without a join and their bytes, words that are classes of their own, buckets of the others.
HOT_WORDS, HOT_BYTES, CLASS_WORDS, BUCKETS = 262_144, 16 << 20, 512, 128
#: Vector length, noise words per observed word, training steps and their size.
DIMENSIONS, NOISE, STEPS, RATE = 32, 16, 120, 0.05
#: Words before a word that it is predicted from; places, noise classes and step size of a batch; groups of task models.
WIDTH, BATCH, BATCH_NOISE, BATCH_RATE, GROUPS = 4, 2048, 64, 0.02, 64
#: Places whose probabilities are computed at a time.
PLACES = 256
#: Texts of training handed to one step, as classes of two bytes.
LINE_BYTES = 1 << 20
#: The end of a text as a token; no word is empty.
END = b""
#: Distinct words that a task sums before it hands them on.
FLUSH = 300_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def bucket_of(word: bytes) -> int:
    return crc32(word[-2:]) % BUCKETS


def token_counts(train: DataFrame) -> DataFrame:
    """``token, c`` over ``doc_id, text``; every text also counts one end."""
    def run(batches):
        seen = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["token", "c"])

        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    seen.update(words_of(text))
                seen[END] += part.num_rows
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return train.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def hot_words(counts: DataFrame, most: int = HOT_WORDS, most_bytes: int = HOT_BYTES) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most`` of ``most_bytes``: those above a count that a log-scale histogram gives.

    A few hundred histogram rows and the words themselves come to the driver, whatever the size of ``counts``.
    """
    step = F.floor(F.log2("c") * 16)
    sizes = sorted(((r["s"], r["k"], r["b"], r["low"]) for r in counts.groupBy(step.alias("s")).agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.length("token")).alias("b"), F.min("c").alias("low")).collect()), reverse=True)
    least, total, size = None, 0, 0
    for _, k, b, low in sizes:
        total, size = total + k, size + b
        if total > most or size > most_bytes:
            break
        least = low
    if least is None:
        return []
    found = counts.where(F.col("c") >= least).toArrow()
    return sorted(zip(found["token"].to_pylist(), found["c"].to_pylist()), key=lambda x: (-x[1], x[0]))


class Lexicon:
    """The hot words with their classes, and what the corpus says about all words."""

    def __init__(self, hot: list[tuple[bytes, int]], total: int, distinct: int, bucket_sums: dict[int, tuple[int, int]]):
        hot = [(END, dict(hot).get(END, 0))] + [x for x in hot if x[0] != END]
        self.code = {w: i for i, (w, _) in enumerate(hot)}
        counts = np.array([c for _, c in hot], float)
        self.own = min(CLASS_WORDS, len(hot))
        self.classes = np.arange(len(hot), dtype=np.int32)
        self.classes[self.own:] = [self.own + bucket_of(w) for w, _ in hot[self.own:]]
        self.n_classes = self.own + BUCKETS
        self.all_log = np.log10(total + 0.5 * (distinct + 1))
        self.base = np.log10(counts + 0.5) - self.all_log
        rest = np.array([bucket_sums.get(b, (0, 0)) for b in range(BUCKETS)], float)
        self.bucket_log = np.log10(rest[:, 0] + 0.5 * (rest[:, 1] + 1))
        self.within = np.zeros(len(hot))
        more = slice(self.own, None)
        self.within[more] = np.log10(counts[more] + 0.5) - self.bucket_log[self.classes[more] - self.own]

    def codes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(codes, classes, words that are not hot)."""
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int32, len(words))
        classes = self.classes[codes]
        cold = [words[i] for i in np.flatnonzero(codes < 0).tolist()]
        classes[codes < 0] = [self.own + bucket_of(w) for w in cold]
        return codes, classes, cold


def class_lines(train: DataFrame, lexicon) -> DataFrame:
    """``classes``: the classes of every text's words, two bytes each, so that texts are split once for all steps of training."""
    def run(batches):
        lex = lexicon.value
        for batch in batches:
            for part in slices(batch):
                lines = [lex.codes(words_of(t))[1].astype(np.int16).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["classes"])

    return train.mapInArrow(run, "classes binary")


def _lines(batches):
    """Lists of texts, given by their classes, that sum to about ``LINE_BYTES``."""
    for batch in batches:
        for part in slices(batch, "classes", LINE_BYTES):
            yield [np.frombuffer(x, np.int16) for x in part.column("classes").to_pylist()]


def class_pairs(lines: DataFrame, n_classes: int) -> DataFrame:
    """``pair, n``: how often class h is followed by class w, pair = h * classes + w."""
    def run(batches):
        k, pairs, end = n_classes, None, np.zeros(1, np.int16)
        for texts in _lines(batches):
            line = np.concatenate([x for text in texts for x in (end, text)] + [end]).astype(np.int64)
            counts = np.bincount(line[:-1] * k + line[1:], minlength=k * k)
            pairs = counts if pairs is None else pairs + counts
        if pairs is not None:
            at = np.flatnonzero(pairs)
            for i in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_pydict({"pair": at[i:i + 100_000], "n": pairs[at[i:i + 100_000]]})

    return lines.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def train_nce(counts: np.ndarray, dims: int = DIMENSIONS, noise: int = NOISE, steps: int = STEPS, seed: int = 7) -> dict:
    """Context vectors ``r``, target vectors ``t`` and ``b`` of a model of one position, fitted to a matrix of counts.

    Noise-contrastive estimation tells the observed words from ``noise`` draws of the smoothed word frequencies per
    observation; the objective sums over all pairs, so that the draws are taken in expectation. Adam takes the steps.
    """
    size = len(counts)
    random = np.random.default_rng(seed)
    data = counts.astype(np.float32) / np.float32(max(1, counts.sum()))
    context = data.sum(axis=1, keepdims=True)
    frequency = counts.sum(axis=0) + 0.5
    q = (frequency / frequency.sum()).astype(np.float32)
    shift = np.log(noise * q)
    values = {
        "r": random.normal(0, 0.1, (size, dims)).astype(np.float32),
        "t": random.normal(0, 0.1, (size, dims)).astype(np.float32),
        "b": np.log(q)}
    first = {k: np.zeros_like(v) for k, v in values.items()}
    second = {k: np.zeros_like(v) for k, v in values.items()}
    scale = np.sqrt(context + 1e-6)  # rare contexts learn as well: their rows weigh as the root of their share
    data, weight = data / scale, noise * (context / scale) * q
    for step in range(1, steps + 1):
        s = values["r"] @ values["t"].T + values["b"]
        p = 1 / (1 + np.exp(np.clip(shift - s, -30, 30)))
        g = data * (1 - p) - weight * p
        slopes = {"r": g @ values["t"], "t": g.T @ values["r"], "b": g.sum(axis=0)}
        for k, slope in slopes.items():
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope * slope
            move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
            values[k] += np.float32(RATE * (1 - step / (steps + 1))) * move
    return values


class Net:
    """Context vectors ``r`` (class, dim), position matrices ``c`` (position, dim, dim), targets ``t`` and biases ``b``."""

    NAMES = ("r", "c", "t", "b")

    def __init__(self, r, c, t, b):
        self.r, self.c, self.t, self.b = r, c, t, b
        self.width = len(c)

    @classmethod
    def first(cls, values: dict, width: int) -> Net:
        """The model of one position: its matrix is the unit matrix, the others are nought."""
        dims = values["r"].shape[1]
        c = np.zeros((width, dims, dims), np.float32)
        c[0] = np.eye(dims)
        return cls(values["r"].copy(), c, values["t"].copy(), values["b"].copy())

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def like(self, flat: np.ndarray) -> Net:
        cuts = np.cumsum([getattr(self, n).size for n in self.NAMES])[:-1]
        parts = np.split(np.asarray(flat, np.float32), cuts)
        return Net(*[x.reshape(getattr(self, n).shape) for n, x in zip(self.NAMES, parts)])

    def lines(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, targets, starts) of texts given by their classes; ends stand before and after each text."""
        pad, end = np.zeros(self.width, np.int32), np.zeros(1, np.int32)
        line = np.concatenate([x for text in texts for x in (pad, text, end)])
        sizes = np.array([len(text) + 1 for text in texts])
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat((np.arange(len(texts)) + 1) * self.width, sizes)
        return line[at[:, None] - 1 - np.arange(self.width)], line[at], starts

    def log10(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Log-probability of every target after its context, normalised over all classes.

        A score is a sum over positions, so its exponential is a product of one table row per position; the tables are
        computed once a call, each row as shares of its largest value, and a place takes neither a product of matrices nor
        an exponential.
        """
        logs = [self.r @ c.T @ self.t.T for c in self.c]
        logs[0] = logs[0] + self.b
        tables = [np.exp(x - x.max(axis=1, keepdims=True)) for x in logs]
        tops = [x.max(axis=1).astype(np.float64) for x in logs]
        out = np.zeros(len(targets))
        for j, x in enumerate(logs):
            out += x[contexts[:, j], targets].astype(np.float64) - tops[j].take(contexts[:, j])
        places, more = np.empty((2, PLACES, len(self.b)), np.float32)
        ones = np.ones(len(self.b), np.float32)
        for i in range(0, len(targets), PLACES):
            part = contexts[i:i + PLACES]
            n = len(part)
            s, row = places[:n], more[:n]
            np.take(tables[0], part[:, 0], axis=0, out=s, mode="clip")
            for j, table in enumerate(tables[1:], 1):
                np.take(table, part[:, j], axis=0, out=row, mode="clip")
                s *= row
            total = s @ ones
            low = np.flatnonzero(~(total > 1e-30))  # the positions' largest values lie apart beyond what 32-bit numbers can hold
            if len(low):
                exact = sum(x[part[low, j]].astype(np.float64) - tops[j][part[low, j], None] for j, x in enumerate(logs))
                top = exact.max(axis=1)
                total = np.log(total, where=total > 1e-30, out=np.zeros(n, np.float64))
                total[low] = top + np.log(np.exp(exact - top[:, None]).sum(axis=1))
            else:
                total = np.log(total.astype(np.float64))
            out[i:i + PLACES] -= total
        return out / np.log(10)


class Trainer:
    """Adagrad steps of noise-contrastive estimation from a common starting model."""

    def __init__(self, net: Net, q: np.ndarray, seed: int = 7):
        self.net, self.tokens = net.like(net.flat()), 0
        self.log_q = np.log(BATCH_NOISE * q).astype(np.float32)
        self.cut = np.cumsum(q)
        self.random = np.random.default_rng(seed)
        self.squares = {n: np.full_like(getattr(net, n), 1e-4) for n in Net.NAMES}

    def _move(self, name: str, slope: np.ndarray, at=slice(None)) -> None:
        squares = self.squares[name]
        squares[at] += slope * slope
        getattr(self.net, name)[at] += np.float32(BATCH_RATE) * slope / np.sqrt(squares[at])

    def step(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        net, n = self.net, len(targets)
        drawn = np.minimum(np.searchsorted(self.cut, self.random.random(BATCH_NOISE) * self.cut[-1]), len(self.cut) - 1)
        words = net.r.take(contexts.ravel(), axis=0).reshape(n, -1)  # positions side by side
        h = words @ net.c.transpose(0, 2, 1).reshape(words.shape[1], -1)
        t_own, t_noise = net.t.take(targets, axis=0), net.t[drawn]
        own = np.einsum("ij,ij->i", h, t_own) + net.b[targets] - self.log_q[targets]
        other = h @ t_noise.T
        other += net.b[drawn] - self.log_q[drawn]
        up = (1 / (1 + np.exp(np.clip(own, -30, 30)))) / n
        np.exp(np.clip(np.negative(other, out=other), -30, 30, out=other), out=other)
        other += 1
        down = np.divide(np.float32(-1 / n), other, out=other)
        slope_h = up[:, None] * t_own + down @ t_noise
        at, sums = _added(np.concatenate((targets, drawn)), np.concatenate((
            np.column_stack((up[:, None] * h, up)), np.column_stack((down.T @ h, down.sum(axis=0))))))
        slopes_c = (slope_h.T @ words).reshape(len(slope_h.T), net.width, -1).transpose(1, 0, 2)
        self._move("t", sums[:, :-1], at)
        self._move("b", sums[:, -1], at)
        self._move("c", slopes_c)
        self.tokens += n


def _added(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    order = np.argsort(keys.astype(np.int16), kind="stable")  # there are fewer classes than 2^15, and short keys sort faster
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(rows[order], starts, axis=0).astype(np.float32)


def trained(lines: DataFrame, net: Net, q: np.ndarray) -> Net:
    """One pass of every task over its texts, starting from ``net``; the average of their models by tokens."""
    shared = lines.sparkSession.sparkContext.broadcast((net, q))

    def run(batches):
        tool = Trainer(*shared.value)
        for texts in _lines(batches):
            contexts, targets, _ = tool.net.lines(texts)
            order = tool.random.permutation(len(targets))
            for i in range(0, len(order), BATCH):
                chosen = order[i:i + BATCH]
                tool.step(contexts.take(chosen, axis=0), targets[chosen])
        if tool.tokens:
            values = tool.net.flat().astype(np.float64) * tool.tokens
            yield pa.RecordBatch.from_pydict({"n": pa.array([tool.tokens], pa.int64()), "v": pa.array([values.tobytes()], pa.binary())})

    def add(batches):
        n, total = 0, None
        for batch in batches:
            for count, values in zip(batch.column("n").to_pylist(), batch.column("v").to_pylist()):
                values = np.frombuffer(values, np.float64)
                n, total = n + count, values.copy() if total is None else total + values
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    models = lines.mapInArrow(run, "n long, v binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    found = models.repartition("g").select("n", "v").mapInArrow(add, "n long, v binary").collect()
    total = sum(np.frombuffer(r["v"], np.float64) for r in found)
    return net.like(total / sum(r["n"] for r in found))


class Model:
    """Counts of words (a written table), the broadcast lexicon and the broadcast network."""

    def __init__(self, counts: DataFrame, lexicon, net, total: int):
        self.counts, self.lexicon, self.net, self.total = counts, lexicon, net, total


def learn(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> Model:
    """Counts all texts of ``train`` and fits a model of ``width`` context words to them."""
    spark = train.sparkSession
    rows = texts(train, id_col, text_col)
    counts = written(token_counts(rows), "token-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).head()
    hot = hot_words(counts)
    own = [w for w, _ in [(END, 0)] + [x for x in hot if x[0] != END]][:CLASS_WORDS]
    bucket = F.pmod(F.crc32(F.expr("substring(token, -2, 2)")), F.lit(BUCKETS)).cast("int")
    bucket_sums = counts.where(~F.col("token").isin(own)).groupBy(bucket.alias("b")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    lexicon = Lexicon(hot, sums["n"], sums["v"], {r["b"]: (r["n"], r["v"]) for r in bucket_sums})
    shared = spark.sparkContext.broadcast(lexicon)
    k = lexicon.n_classes
    if not sums["n"]:
        empty = {"r": np.zeros((k, DIMENSIONS), np.float32), "t": np.zeros((k, DIMENSIONS), np.float32), "b": np.zeros(k, np.float32)}
        return Model(counts, shared, spark.sparkContext.broadcast(Net.first(empty, width)), 0)
    matrix = np.zeros(k * k, np.int64)
    lines = written(class_lines(rows, shared), "class-lines")
    pairs = class_pairs(lines, k).toArrow()
    matrix[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    matrix = matrix.reshape(k, k)
    q = matrix.sum(axis=0) + 0.5
    net = trained(lines, Net.first(train_nce(matrix), width), q / q.sum())
    return Model(counts, shared, spark.sparkContext.broadcast(net), sums["n"])


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: Column,
) -> DataFrame:
    """``doc_id``, the columns of ``more``, ``n_tokens, n_known, base_score, score`` for every row.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` the model's.
    """
    lexicon, net, fitted = model.lexicon, model.net, model.total > 0
    rows = texts(docs, id_col, text_col, *more)
    passed = [c for c in rows.columns if c != "text"]
    names = ("n_tokens", "hot_known", "base_part", "part", "cold", "cold_n")
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    schema = T.StructType(rows.drop("text").schema.fields + T.StructType.fromDDL(
        "n_tokens long, hot_known long, base_part double, part double, cold array<binary>, cold_n array<long>").fields)

    def run(batches):
        lex, tool = lexicon.value, net.value
        for batch in batches:
            for part in slices(batch):
                out, lines = {n: [] for n in names}, []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    codes, classes, cold = lex.codes(words)
                    hot = codes[codes >= 0]
                    lines.append(classes)
                    rare = Counter(cold)
                    out["n_tokens"].append(len(words) + 1)
                    out["hot_known"].append(len(hot) + int(fitted))
                    out["base_part"].append(float(lex.base[hot].sum() + lex.base[0] - len(cold) * lex.all_log))
                    cold_log = lex.bucket_log[classes[codes < 0] - lex.own].sum() if cold else 0.0
                    out["part"].append(float(lex.within[hot].sum() - cold_log))
                    out["cold"].append(list(rare.keys()))
                    out["cold_n"].append(list(rare.values()))
                contexts, targets, starts = tool.lines(lines)
                out["part"] = np.add.reduceat(tool.log10(contexts, targets), starts) + np.array(out["part"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in passed] + [pa.array(out[n], k) for n, k in zip(names, kinds)],
                    names=[*passed, *names])

    scored = written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("cold", "cold_n")).alias("x")).select(
        "row", F.col("x.cold").alias("token"), F.col("x.cold_n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    rest = rare.join(model.counts.hint("merge"), "token", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("rest"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rest_known"))
    both = scored.drop("cold", "cold_n").join(rest.hint("merge"), "row", "left")
    added = F.coalesce("rest", F.lit(0.0))
    base = F.col("base_part") + added
    return both.select(
        *passed, "n_tokens",
        (F.col("hot_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), base.alias("base_score"),
        (F.col("part") + added if fitted else base).alias("score"))
