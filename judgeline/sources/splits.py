"""Files whose records may hold line breaks, read in byte ranges.

Spark's text source cuts a file into ranges at any one-byte separator. Whether a range starts inside a quoted text is
not to be seen in the range itself, but follows from the quotes before it: ranges count theirs, and running sums over the
ranges of a file give every piece its state. Only these short counts are summed; texts are shuffled when records are put
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgeline.operators.sizing import cumulate
from judgeline.session import written

PLACE = ["file", "block", "row"]


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, row, value): the pieces between separators, in file order by block and row."""
    return written(spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value"), "pieces")


def _running(slim: DataFrame, **sums: Column) -> DataFrame:
    """Adds inclusive running sums in file order."""
    return cumulate(slim, F.col("block"), [F.col("row")], sums, ["file"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, value): one row per record, at the place of its first line.

    Quotes inside a field are doubled and such fields are quoted, so that a line break ends a record exactly if the quotes
    up to it are even. Records of one line, nearly all, go out as they are; only the lines of longer ones are grouped.
    """
    lines = pieces(spark, path, "\n")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    slim = lines.select(*PLACE, quotes.cast("long").alias("q"))
    state = _running(slim, upto=F.col("q")).withColumn("before", (F.col("upto") - F.col("q")) % 2)
    state = state.withColumn("starts", (F.col("before") == 0).cast("long"))
    state = written(_running(state, record=F.col("starts")).select(
        *PLACE, "record", "starts", ((F.col("starts") == 1) & (F.col("upto") % 2 == 0)).alias("whole")), "line-states")
    rows = lines.join(state, PLACE)
    single = rows.where("whole").select(*PLACE, F.regexp_replace("value", r"\r$", "").alias("value"))
    long = rows.where("NOT whole").groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "row", "value"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["value"]), "\n")
    return single.unionByName(long.select(
        "file", F.col("l")[0]["block"].alias("block"), F.col("l")[0]["row"].alias("row"), F.regexp_replace(text, r"\r$", "").alias("value")))


def read_csv_splits(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """All columns as strings, by the names in the first file's header; every file's first record is its header.

    Without ``header`` the columns are ``_c0, _c1, ...`` as in the first record. ``line_no`` is the record's place.
    """
    names = spark.read.csv(path, sep=sep, header=header, multiLine=True, escape='"').columns
    schema = ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)
    rows = csv_records(spark, path).where(F.col("value") != "")
    if header:
        first = rows.groupBy("file").agg(F.min(F.struct("block", "row")).alias("f")).select("file", "f.block", "f.row")
        rows = rows.join(first, PLACE, "left_anti")
    fields = F.from_csv("value", F.lit(schema), {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
    return rows.select(F.struct(*PLACE).alias("line_no"), fields.alias("f")).select("f.*", "line_no")


def json_object_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(did, text): the pairs of files that hold one JSON object each; a value that is no string stays JSON.

    Files are cut at quotes. A quote after an odd number of backslashes belongs to its text, so that counting the others
    tells texts from structure; brackets of the structure give the nesting, and a colon at nesting one ends a key.
    """
    rows = pieces(spark, path, '"')
    slashes = F.length(F.regexp_extract("value", r"(\\*)$", 1))
    count = lambda marks: F.length("value") - F.length(F.translate("value", marks, ""))
    opened, closed = count("{["), count("}]")
    slim = rows.select(
        *PLACE, (slashes % 2 == 0).cast("long").alias("real"), (opened - closed).cast("long").alias("turn"),
        F.col("value").rlike(r"^\s*:").alias("colon"), F.col("value").rlike(r"^\s*\{").alias("object"))
    starts = slim.groupBy("file").agg(F.min(F.struct("block", "row", "object")).alias("s"))
    state = _running(slim, upto=F.col("real")).withColumn("token", F.col("upto") - F.col("real")).withColumn(
        "turn", F.when(F.col("token") % 2 == 0, F.col("turn")).otherwise(0))
    state = written(_running(state, depth=F.col("turn")), "nesting")
    top = (F.col("token") % 2 == 0) & F.col("colon") & (F.col("depth") - F.col("turn") == 1)
    bad = state.groupBy("file").agg(F.sum("turn").alias("t"), (F.max("token") % 2).alias("q")).join(starts, "file").where(
        (F.col("t") != 0) | (F.col("q") != 0) | ~F.col("s.object"))
    first_bad = bad.select("file").head()
    if first_bad:
        raise ValueError(f"corpus file is not a JSON object: {first_bad[0]}")
    entries = _running(state.withColumn("top", top.cast("long")), entry=F.col("top")).select(*PLACE, "token", "top", "entry")
    entries = written(entries, "entries")
    keys = entries.where("top = 1").select("file", (F.col("token") - 1).alias("token"), F.lit(True).alias("key"))
    marked = entries.join(keys, ["file", "token"], "left").select(
        *PLACE, (F.col("entry") + F.when(F.col("key"), 1).otherwise(0)).alias("entry"), F.coalesce("key", F.lit(False)).alias("key"))
    joined = rows.join(marked.where("entry > 0"), PLACE)
    part = lambda key: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
        F.col("key") == key, F.struct("block", "row", "value")))), lambda x: x["value"]), '"')
    pairs = joined.groupBy("file", "entry").agg(part(True).alias("k"), part(False).alias("v"))
    # What follows the colon, without the comma or the object's closing bracket.
    value = F.regexp_replace(F.regexp_replace("v", r"^\s*:\s*", ""), r"\s*[,}]\s*$", "")
    pair = F.from_json(F.concat(F.lit('{"'), F.col("k"), F.lit('":'), value, F.lit("}")), F.lit("map<string,string>"))
    failed = F.raise_error(F.lit("corpus file is not a JSON object")).cast("map<string,string>")
    return pairs.select(F.explode(F.coalesce(pair, failed)).alias("did", "text"))
