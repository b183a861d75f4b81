"""TF-IDF features, class weights, a boosted-tree relevance classifier and reranking with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from judgeline.operators.agreement import class_report, confusion
from judgeline.operators.ranks import topk_run
from judgeline.operators.sizing import pick
from judgeline.session import written

WORD = r"[\p{L}\p{N}_]{2,}"  # Fixed value: a feature word has at least two word characters.


def _texts(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    return queries.select(F.lit("q").alias("kind"), F.col("qid").alias("id"), F.col("query").alias("text")).unionByName(
        corpus.select(F.lit("d").alias("kind"), F.col("did").alias("id"), "text"))


#: Terms that tasks hold with their document frequency, and their longest length; other terms meet theirs in a join.
HELD_TERMS, HELD_LENGTH = 500_000, 64
#: Texts that are counted at a time.
STEP_TEXTS = 512


def _counted(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place in the vocabulary, count) for every row of word lists and each of its words, and that vocabulary."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = pc.dictionary_encode(words.flatten())
    key, tf = np.unique(
        np.repeat(np.arange(len(words)), sizes) * max(1, len(code.dictionary)) + code.indices.to_numpy(zero_copy_only=False),
        return_counts=True)
    row, term = np.divmod(key.astype(np.int64), max(1, len(code.dictionary)))
    return row, term, tf, code.dictionary


def _steps(batches):
    return (b.slice(i, STEP_TEXTS) for b in batches for i in range(0, b.num_rows, STEP_TEXTS))


def tfidf_features(queries: DataFrame, corpus: DataFrame, max_terms: int | None = None) -> DataFrame:
    """(kind, id, term, weight): smoothed tf-idf fitted on queries and documents together, unit length per text.

    ``max_terms`` keeps the most frequent terms of the collection as the vocabulary. A text is weighted where it is read: tasks
    hold the document frequencies of the most common terms, and only its rare terms meet theirs in a join. Texts that share
    their id count as one and are a row per term.
    """
    texts = _texts(queries, corpus)
    n = texts.count()
    split = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1)).alias("words")
    often = written(texts.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(
        F.col("kind").alias("_kind"), F.col("id").alias("_id")), "ids")
    same = (F.col("kind") == F.col("_kind")) & F.col("id").eqNullSafe(F.col("_id"))
    once, shared = texts, None
    if not often.isEmpty():
        once = texts.join(often, same, "left_anti")
        shared = texts.join(often, same, "left_semi").select("kind", "id", F.explode(split).alias("term")).groupBy(
            "kind", "id", "term").agg(F.count(F.lit(1)).alias("tf"))

    def totals(batches):
        for batch in _steps(batches):
            _, term, tf, names = _counted(batch.column("words"))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(term, minlength=len(names)), pa.int64()), pa.array(
                np.bincount(term, tf, minlength=len(names)).astype(np.int64))], names=["term", "df", "cf"])

    found = once.select(split).mapInArrow(totals, "term string, df long, cf long")
    if shared is not None:
        found = found.unionByName(shared.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    vocab = written(found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "vocabulary")
    if max_terms is not None:
        vocab = written(vocab.orderBy(F.col("cf").desc(), "term").limit(max_terms), "vocabulary")

    short, least, many = F.length("term") <= HELD_LENGTH, None, 0
    for r in sorted(vocab.where(short).groupBy("df").agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["df"]):
        many += r["c"]
        if many > HELD_TERMS:
            break
        least = r["df"]
    common = short & (F.col("df") >= least) if least is not None else F.lit(False)
    held = vocab.where(common).select("term", "df").toArrow()
    known = texts.sparkSession.sparkContext.broadcast((held.column("term").combine_chunks(), held.column("df").to_numpy()))
    rare = vocab.where(~common).select("term", "df")
    id_kind = texts.schema["id"].dataType.simpleString()

    def others(batches):
        for batch in _steps(batches):
            row, term, _, names = _counted(batch.column("words"))
            at = np.flatnonzero(pc.is_null(pc.index_in(names, value_set=known.value[0])).to_numpy(zero_copy_only=False)[term])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(row[at])) for c in ("kind", "id")), names.take(pa.array(term[at]))],
                names=["kind", "id", "term"])

    whole = once.select("kind", "id", "text")
    if rare.isEmpty():
        whole = whole.withColumn("rare", F.lit(None).cast("array<struct<term:string,df:bigint>>"))
    else:
        met = once.select("kind", "id", split).mapInArrow(others, f"kind string, id {id_kind}, term string").join(rare, "term")
        lists = met.groupBy(F.col("kind").alias("_kind"), F.col("id").alias("_id")).agg(
            F.collect_list(F.struct("term", "df")).alias("rare"))
        whole = whole.join(lists, same, "left")

    def weigh(batches):
        terms, dfs = known.value
        for batch in _steps(batches):
            row, term, tf, names = _counted(batch.column("words"))
            place = pc.index_in(names, value_set=terms)
            hit = place.is_valid().to_numpy(zero_copy_only=False)
            df = np.zeros(len(names))
            df[hit] = dfs[place.drop_null().to_numpy()]
            more = batch.column("rare").flatten()
            at = pc.index_in(more.field("term"), value_set=names).to_numpy()
            df[at] = more.field("df").to_numpy(zero_copy_only=False)
            in_vocabulary = df[term] > 0
            row, term, tf = row[in_vocabulary], term[in_vocabulary], tf[in_vocabulary]
            w = tf * (np.log((n + 1) / (df[term] + 1)) + 1.0)
            length = np.sqrt(np.bincount(row, w * w, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(row)) for c in ("kind", "id")), names.take(pa.array(term)), pa.array(w / length[row])],
                names=["kind", "id", "term", "weight"])

    out = whole.select("kind", "id", split, "rare").mapInArrow(weigh, f"kind string, id {id_kind}, term string, weight double")
    if shared is None:
        return out
    raw = shared.join(vocab, "term").select(
        "kind", "id", "term", (F.col("tf") * (F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1.0)).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("kind", "id")))
    return out.unionByName(raw.select("kind", "id", "term", (F.col("w") / size).alias("weight")))


def fit_text_vectors(queries: DataFrame, corpus: DataFrame, cells: int = 1024) -> PipelineModel:
    """A fitted pipeline text -> unit tf-idf vector.

    Every term of the collection counts: terms are hashed into ``cells`` numbers, whose size bounds a tree's work. For
    the exact vectors of single terms see ``tfidf_features`` and ``pair_terms``.
    """
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD, gaps=False),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=cells),
        IDF(inputCol="counts", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(_texts(queries, corpus))


def pair_features(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``features``: the query vector followed by the document vector. Unknown ids fail the job."""
    q = model.transform(queries.select("qid", F.col("query").alias("text"))).select("qid", F.col("features").alias("qv"))
    wanted = pick(corpus.select("did", "text"), pairs)  # only texts of the pairs are turned into vectors
    d = model.transform(wanted).select("did", F.col("features").alias("dv"))
    rows = pairs.join(q, "qid", "left").join(d, "did", "left")
    return VectorAssembler(inputCols=["qv", "dv"], outputCol="features", handleInvalid="error").transform(rows).drop("qv", "dv")


def pair_terms(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """The pairs' feature vectors in sparse rows: the columns of ``pairs`` and ``side`` (q or d), ``term, weight``.

    ``features`` is the result of ``tfidf_features``: the whole vocabulary, one unit vector per text.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(key).alias("id")) for kind, key in (("q", "qid"), ("d", "did"))]))
    asked = pairs.withColumn("_side", sides).select(*pairs.columns, "_side.kind", "_side.id")
    first = ["qid", "did"]  # features are read once for both sides
    return asked.join(features, ["kind", "id"]).select(
        *first, *[c for c in pairs.columns if c not in first], F.col("kind").alias("side"), "term", "weight")


def class_weights(labels: DataFrame, alpha: float = 1.0, classes: int | None = None, strict: bool = True) -> DataFrame:
    """(label, n, weight): (total / (C * n)) ** alpha, scaled to mean 1; C counts the classes.

    One of the ``classes`` without a row has no weight: it fails the job, or is left out and not counted when not ``strict``.
    """
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if classes is not None:
        spine = labels.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
        counts = spine.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
        counts = counts if strict else counts.where(F.col("n") > 0)
    everything = Window.partitionBy()
    total, c = F.sum("n").over(everything), F.count(F.lit(1)).over(everything)
    empty = F.raise_error(F.concat(F.lit("no rows of class "), F.col("label").cast("string"))).cast("double")
    raw = F.when(F.col("n") == 0, empty).otherwise(F.pow(total / (c * F.col("n")), F.lit(alpha)))
    rows = counts.withColumn("_raw", raw)
    return rows.select("label", "n", (F.col("_raw") * c / F.sum("_raw").over(everything)).alias("weight"))


POSITIVE_FACTOR = 0.16666  # Fixed value: damping of the positive weight in one of the two forms.


def positive_weight(labels: DataFrame, damped: bool = False) -> DataFrame:
    """One row: negatives per positive, optionally damped."""
    neg, pos = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    return labels.agg((F.try_divide(neg, pos) * (POSITIVE_FACTOR if damped else 1.0)).alias("positive_weight"))


def train_pair_classifier(
    train: DataFrame, rounds: int = 2000, depth: int = 4, seed: int = 42, dev: DataFrame | None = None, tolerance: float = 0.01,
):
    """Weighted boosted trees on (features, label 0/1); positives weigh as much as there are negatives per positive.

    With ``dev``, training stops when the error on it falls by less than ``tolerance``, and keeps the best number of
    rounds. Without it all ``rounds`` are trained, so hand in fewer. Training pairs without a negative leave positives
    without weight; if ``dev`` has no negative either, its error is 0 / 0, no round is better than the first, and only that
    one is trained.
    """
    ratio = positive_weight(train).select("positive_weight").scalar()
    rows = train.select("features", "label", F.lit(False).alias("dev"))
    if dev is not None:
        rows = rows.unionByName(dev.select("features", "label", F.lit(True).alias("dev")))
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1, ratio).otherwise(F.lit(1.0)))
    if dev is not None and weighted.where("dev").agg(F.sum("weight")).head()[0] == 0:
        rounds = 1
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, weightCol="weight", seed=seed, validationTol=tolerance)
    return (trees if dev is None else trees.setValidationIndicatorCol("dev")).fit(weighted)


def predict(model, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``score`` (probability of relevance) and ``pred``."""
    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(rows).withColumn("score", p).withColumn("pred", (p > threshold).cast("int")).drop(
        "rawPrediction", "probability", "prediction")


def classifier_report(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, label, predicted_0, predicted_1, precision, recall, f1, support, accuracy), one row per label that occurs."""
    keys = keys or []
    pairs = scored.select(*keys, F.col("label").cast("int").alias("gold"), F.col("pred").cast("int").alias("pred"))
    cells = confusion(pairs, keys)
    counts = cells.groupBy(*keys, F.col("gold").alias("label")).agg(*[
        F.coalesce(F.sum(F.when(F.col("pred") == p, F.col("n"))), F.lit(0)).alias(f"predicted_{p}") for p in (0, 1)])
    right = cells.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("accuracy"))
    report = class_report(pairs, keys).join(counts, [*keys, "label"], "left").fillna(0, ["predicted_0", "predicted_1"])
    report = report.join(right, keys) if keys else report.withColumn("accuracy", right.scalar())
    return report.select(*keys, "label", "predicted_0", "predicted_1", "precision", "recall", "f1", "support", "accuracy")


def rerank_with_model(run: DataFrame, queries: DataFrame, corpus: DataFrame, vectors: PipelineModel, model, k: int) -> DataFrame:
    """The k best documents of a run in the order of the classifier."""
    head = run.where(F.col("rank") <= k).select("qid", "did")
    scored = predict(model, pair_features(head, queries, corpus, vectors)).select("qid", "did", "score")
    return topk_run(scored, k)
