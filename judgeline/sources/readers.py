"""Readers for the file layouts of corpora, queries, judgments, runs and training sets.

Schemas are declared; nothing is inferred from the data but the column order of judgment files, for which one line is
looked at. Reads of line files carry ``line_no`` where later steps depend on file order: a struct of file, block start
and row, which sorts like the lines themselves even when a file is read in several splits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgeline import schemas as C
from judgeline.sources.splits import PLACE, csv_records, json_object_pairs, read_csv_splits

S = T.StringType()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of text files."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", place.alias("line_no"))


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with id and text (or contents); malformed and blank lines are skipped."""
    schema = T.StructType([T.StructField(n, S) for n in ("id", "title", "text", "contents")])
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    text = F.coalesce("text", "contents", F.lit(""))
    return rows.where(F.col("id").isNotNull()).select(F.col("id").alias("did"), "title", text.alias("text"))


def read_corpus_json_map(spark: SparkSession, path: str, layout: str = "object") -> DataFrame:
    """Files that hold one JSON object {did: text}.

    ``object`` reads files of any layout in byte ranges, see ``splits.json_object_pairs``. ``pairs`` is the shorter way
    for files with one pair per line. Anything but an object fails the job.
    """
    pairs = T.MapType(S, S)
    if layout == "pairs":
        body = F.regexp_replace(F.trim("value"), ",$", "")
        rows = spark.read.text(path).where(~F.trim("value").isin("{", "}", ""))
        parsed = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), pairs)
    else:
        return json_object_pairs(spark, path)
    failed = F.raise_error(F.lit("corpus file is not a JSON object")).cast(pairs)
    return rows.select(F.explode(F.coalesce(parsed, failed)).alias("did", "text"))


def read_corpus_csv(
    spark: SparkSession, path: str, did: str = "Codigo", text: str = "text", title: str | None = None, keep: tuple = ()
) -> DataFrame:
    """CSV with quoted, possibly multi-line texts, read in byte ranges; only the named columns are returned."""
    rows = read_csv_splits(spark, path)
    head = [F.col(did).alias("did"), F.col(title).alias("title") if title else F.lit(None).cast("string").alias("title")]
    return rows.select(*head, F.col(text).alias("text"), *keep)


# First fields that mark a header line of a query file.
QUERY_HEADERS = ["id", "qid", "query_id", "topic_id"]


def read_queries(spark: SparkSession, path: str, sep: str = "\t", header: bool | None = None) -> DataFrame:
    """(qid, query, line_no): trimmed; lines without a second field or an id are dropped.

    ``header=True`` drops the first line of every file, ``None`` drops lines that look like a header.
    """
    if sep == ",":
        raw = csv_records(spark, path).select("value", F.struct(*PLACE).alias("line_no"))
        fields = F.from_csv("value", F.lit("qid STRING, query STRING"), {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
        rows = raw.select(fields.alias("f"), "line_no").select("f.*", "line_no")
    else:
        raw = lines(spark, path)
        parts = F.split("value", re.escape(sep), 2)
        rows = raw.select(
            F.get(parts, F.lit(0)).alias("qid"), F.get(parts, F.lit(1)).alias("query"), "line_no")
    rows = rows.withColumns({"qid": F.trim("qid"), "query": F.trim("query")})
    if header:
        firsts = raw.groupBy("line_no.file").agg(F.min("line_no").alias("line_no")).select("line_no")
        rows = rows.join(firsts, "line_no", "left_anti")
    elif header is None:
        rows = rows.where(~F.lower("qid").isin(QUERY_HEADERS))
    return rows.where((F.col("qid") != "") & F.col("query").isNotNull()).select("qid", "query", "line_no")


# Names under which judgment files head their columns.
QRELS_NAMES = {
    "qid": ["qid", "query_id", "topic_id", "id"],
    "did": ["doc_id", "docid", "did", "pid"],
    "label": ["label", "rel", "relevance", "gain"],
    "iter": ["run", "q0", "iter", "iteration"],
    "evidence": ["evidence"],
}
QRELS_LAYOUTS = {
    3: ["qid", "did", "label"],
    4: ["qid", "iter", "did", "label"],
    5: ["qid", "iter", "did", "label", "evidence"],
}


def _qrels_columns(first: str, sep: str) -> list[str]:
    import re

    fields = re.split(sep, first.strip())
    names = {alias: name for name, aliases in QRELS_NAMES.items() for alias in aliases}
    known = [names.get(f.strip().lower()) for f in fields]
    if {"qid", "did", "label"} <= set(known):
        return [n or f"_{i}" for i, n in enumerate(known)]
    if len(fields) < 3:
        raise ValueError("judgment lines need at least three columns")
    return QRELS_LAYOUTS[min(len(fields), 5)]


def read_qrels(
    spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t", dedupe: bool = True
) -> DataFrame:
    """(qid, iter, did, label, evidence, line_no) of 3-, 4- or 5-column judgments.

    Without ``columns`` the first line decides: a header names them, otherwise their number does. Lines without an
    integer label are dropped, so a header line is too; the last line of a (qid, did) pair wins.
    """
    if columns is None:
        head = spark.read.text(path).where(F.trim("value") != "").head()
        if head is None:
            columns = QRELS_LAYOUTS[3]
        else:
            columns = _qrels_columns(head["value"], sep)
    parts = F.split("value", sep, len(columns))

    def field(name: str) -> Column:
        if name not in columns:
            return F.lit(None).cast("string")
        return F.trim(F.get(parts, F.lit(columns.index(name))))

    rows = lines(spark, path).select(
        field("qid").alias("qid"), field("iter").alias("iter"), field("did").alias("did"),
        field("label").try_cast("int").alias("label"), field("evidence").alias("evidence"), "line_no",
    ).where(F.col("label").isNotNull() & F.col("did").isNotNull() & (F.col("qid") != ""))
    if not dedupe:
        return rows
    last = rows.groupBy("qid", "did").agg(F.max_by(F.struct("iter", "label", "evidence", "line_no"), "line_no").alias("r"))
    return last.select("qid", "r.iter", "did", "r.label", "r.evidence", "r.line_no")


def read_trec_run(spark: SparkSession, path: str) -> DataFrame:
    """Six-column runs; lines with fewer fields are skipped."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(f) >= 6)
    return rows.select(
        f[5].alias("run_id"), f[0].alias("qid"), f[2].alias("did"), f[3].cast("int").alias("rank"),
        f[4].cast("double").alias("score"))


def read_ranked_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Three tab-separated columns: qid, did, rank."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 3)
    return rows.select(F.trim(f[0]).alias("qid"), F.trim(f[1]).alias("did"), F.trim(f[2]).cast("int").alias("rank"))


def read_qid_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("qid")).where(F.col("qid") != "")


def read_annotation_export(spark: SparkSession, path: str) -> DataFrame:
    """(username, topic_id, did, label_name) of nested exports.

    Files hold either an object with ``groundtruths.labels_ground_truths`` or a list of records.
    """
    labels = T.ArrayType(T.StructType([T.StructField("label", S)]))
    truth = T.StructType([T.StructField("topic_id", S), T.StructField("id_report_hashed", S), T.StructField("labels", labels)])
    schema = T.StructType([
        T.StructField("groundtruths", T.StructType([T.StructField("labels_ground_truths", T.ArrayType(truth))])),
        T.StructField("username", S), T.StructField("topic_id", S), T.StructField("id_report", S),
        T.StructField("labels", labels)])
    rows = spark.read.schema(schema).json(path, multiLine=True)
    flat = F.array(F.struct(F.col("topic_id"), F.col("id_report").alias("id_report_hashed"), F.col("labels")))
    records = rows.select("username", F.explode(F.coalesce("groundtruths.labels_ground_truths", flat)).alias("r"))
    return records.select(
        "username", F.col("r.topic_id").alias("topic_id"), F.col("r.id_report_hashed").alias("did"),
        F.get("r.labels", F.lit(0))["label"].alias("label_name"))


def read_batch_responses(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, content): the first choice of every answered request."""
    message = T.StructType([T.StructField("message", T.StructType([T.StructField("content", S)]))])
    body = T.StructType([T.StructField("choices", T.ArrayType(message))])
    schema = T.StructType([
        T.StructField("custom_id", S), T.StructField("response", T.StructType([T.StructField("body", body)]))])
    rows = spark.read.schema(schema).json(path)
    return rows.select("custom_id", F.get("response.body.choices", F.lit(0))["message"]["content"].alias("content"))


def read_train_groups(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Groups to (query, positive, negative_1..n), NULL where a group has fewer negatives.

    ``n`` is the width; without it the widest group is looked up first.
    """
    rows = spark.read.schema(C.TRAIN_GROUP).json(path)
    if n is None:
        n = rows.agg(F.max(F.size("neg"))).head()[0] or 0
    negs = [F.get("neg", F.lit(i)).alias(f"negative_{i + 1}") for i in range(n)]
    return rows.select("query", F.get("pos", F.lit(0)).alias("positive"), *negs)


# The numbers a training log line reports.
LOG_FIELDS = ["loss", "grad_norm", "learning_rate", "epoch"]


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, step, loss, grad_norm, learning_rate, epoch) from ``{'loss': ...}`` entries inside text lines."""
    from judgeline.operators.sizing import LINE_BUCKET, number_rows

    entries = lines(spark, path).select(
        "line_no", F.posexplode(F.regexp_extract_all("value", F.lit(r"(\{[^{}]*\})"), F.lit(1))).alias("pos", "e"))
    number = r"[-+0-9.eE]+|nan|inf"
    values = {f: F.regexp_extract("e", rf"'{f}':\s*'?({number})'?", 1).try_cast("double") for f in LOG_FIELDS}
    rows = entries.where(F.contains("e", F.lit("'loss'"))).withColumns(values)
    bucket = F.struct("line_no.file", "line_no.block", F.floor(F.col("line_no.row") / LINE_BUCKET).alias("r"))
    return number_rows(rows, bucket, [F.col("line_no"), F.col("pos")], name="step").select("line_no", "step", *LOG_FIELDS)


def read_benchmark_tables(spark: SparkSession, path: str, cache: str | None = None, negatives: int | None = None) -> DataFrame:
    """(query, positive, negative_1..n) of a wide passage collection; ``negatives`` reads only the first of them.

    With ``cache`` the pruned table is written there once and read from there afterwards.
    """
    if negatives is None:
        names = set(spark.read.parquet(path).columns)
        negatives = next(i for i in range(len(names) + 1) if f"negative_{i + 1}" not in names)
    wanted = ["query", "positive", *[f"negative_{i}" for i in range(1, negatives + 1)]]
    if cache is None:
        return spark.read.parquet(path).select(*wanted)
    try:
        return spark.read.parquet(cache)
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    spark.read.parquet(path).select(*wanted).write.parquet(cache)
    return spark.read.parquet(cache)
