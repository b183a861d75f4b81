"""Request tables for external judges, and their answers back to judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgeline.operators.selection import QUERY_KINDS
from judgeline.operators.sizing import hinter


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``template`` with every ``{name}`` replaced; a filled-in text is not searched for placeholders again."""
    import re

    pieces = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(values[p], F.lit("")) for i, p in enumerate(pieces)])


def request_json(custom_id: Column, system: str | None, user: Column, max_tokens: Column | int, as_json: bool = True) -> Column:
    """One request line: custom_id and a body with messages, token limit and answer format."""
    messages = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))] if system else []
    messages.append(F.struct(F.lit("user").alias("role"), user.alias("content")))
    limit = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    body = [limit.alias("max_tokens"), F.array(*messages).alias("messages")]
    if as_json:
        body.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.struct(*body).alias("body")))


def render_pair_requests(
    pool: DataFrame, queries: DataFrame, corpus: DataFrame, template: str, system: str | None = None, max_tokens: int = 256
) -> DataFrame:
    """(custom_id, value) for pooled pairs; placeholders {query} and {doc}, ids ``qid_did``."""
    asked = pool.select("qid", "did").join(queries.select("qid", "query"), "qid")
    rows = corpus.select("did", "text").join(hinter(asked)(asked), "did")
    cid = F.concat_ws("_", "qid", "did")
    user = fill_template(template, {"query": F.col("query"), "doc": F.col("text")})
    return rows.select(cid.alias("custom_id"), request_json(cid, system, user, max_tokens).alias("value"))


def render_doc_requests(
    corpus: DataFrame, template: str, system: str | None = None, max_tokens: Column | int = 256, as_json: bool = False
) -> DataFrame:
    """(custom_id, value) per document; placeholder {doc}; ``max_tokens`` may depend on the text."""
    user = fill_template(template, {"doc": F.col("text")})
    return corpus.select(
        F.col("did").alias("custom_id"), request_json(F.col("did"), system, user, max_tokens, as_json).alias("value"))


def render_query_requests(queries: DataFrame, template: str, system: str | None = None, max_tokens: int = 256) -> DataFrame:
    """(custom_id, value) per query; placeholder {query}."""
    user = fill_template(template, {"query": F.col("query")})
    return queries.select(
        F.col("qid").alias("custom_id"), request_json(F.col("qid"), system, user, max_tokens).alias("value"))


def parse_relevance_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(custom_id, content) to judgments (qid, did, label, evidence) and the rejected rows with a reason."""
    answer = F.from_json("content", "relevant STRING, evidence STRING")
    # A query id may hold underscores itself; the document id follows the last one.
    qid, did = (F.regexp_extract("custom_id", r"(?s)^(.+)_([^_]+)$", i) for i in (1, 2))
    # A broken answer parses to a struct of NULLs; JSON validity is told apart by a map parse.
    valid = F.from_json("content", "map<string,string>").isNotNull() & F.trim("content").startswith("{")
    label = F.when(F.col("a.relevant") == "yes", 1).when(F.col("a.relevant") == "no", 0)
    reason = F.when(F.coalesce(qid, F.lit("")) == "", "bad id").when(~F.coalesce(valid, F.lit(False)), "not json").when(
        label.isNull(), "no label")
    rows = responses.withColumn("a", answer).select(
        "custom_id", "content", qid.alias("qid"), did.alias("did"),
        label.alias("label"), F.col("a.evidence").alias("evidence"), reason.alias("reason"))
    good = rows.where(F.col("reason").isNull()).select("qid", "did", "label", "evidence")
    return good, rows.where(F.col("reason").isNotNull()).select("custom_id", "content", "reason")


def parse_generated_queries(responses: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(did, content) with a JSON object of at least three queries to queries (qid, query, did) and judgments of 1.

    Queries are named by position; further ones are ignored. Undecodable rows are dropped, too few queries are
    dropped or, when ``strict``, fail the job.
    """
    rows = responses.withColumn("m", F.from_json("content", "map<string,string>")).where(F.col("m").isNotNull())
    enough = F.size("m") >= len(QUERY_KINDS)
    if strict:
        short = F.raise_error(F.concat(F.lit("fewer than three queries for "), F.col("did"))).cast("boolean")
        rows = rows.where(F.when(enough, F.lit(True)).otherwise(short))
    else:
        rows = rows.where(enough)
    kinds = F.array(*[F.lit(k) for k in QUERY_KINDS])
    items = rows.select("did", F.posexplode(F.slice(F.map_values("m"), 1, len(QUERY_KINDS))).alias("i", "query"))
    queries = items.select(F.concat_ws("_", "did", F.get(kinds, F.col("i"))).alias("qid"), "query", "did")
    return queries, queries.select("qid", "did", F.lit(1).alias("label"))
