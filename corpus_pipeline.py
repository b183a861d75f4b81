"""A corpus pipeline of five stages: language, exact copies, near copies, mixture, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and reads it again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.

Stages work on whatever columns ``docs`` has besides ``doc_id``, ``text`` and ``source``; null ids, sources and texts
pass through where a stage does not reject them (a null text has no language).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgeline.llm import crossparse, digest_index, mixing, pieces, simhash
from judgeline.llm.common import fold, table
from judgeline.llm.queries import piece_model_path
from judgeline.session import written

#: Near copies: shingles of so many words, and their least similarity.
WIDTH, SIMILARITY = 5, 0.8


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the labelled rows of ``docs`` teach; texts without a letter and foreign ones go.

    A text is foreign if it needs far more bits per byte than any labelled text of its language, see ``bit_bounds``.
    """
    labelled = docs.where(fold("doc_id", 4) != 2)
    samples = crossparse.learn_samples(labelled)
    bounds = F.broadcast(crossparse.bit_bounds(labelled))  # one row per learned language
    known = crossparse.identify_rows(docs, samples).where(F.col("lang_pred") != crossparse.UNDETERMINED)
    return known.join(bounds, "lang_pred", "left").where(
        F.col("bits") <= F.coalesce("most", F.lit(float("inf")))).select("row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts, the one with the largest id."""
    return digest_index.drop_copies(docs, digest_index.DigestIndex(spark))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id: SimHash, then an exact check of what it finds."""
    return simhash.drop_near(docs, SIMILARITY, WIDTH)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them; sources weigh 1, 2, 3, repeating."""
    return mixing.mix(docs, [1, 2, 3])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, with digests of the ids and of the text that they decode to."""
    out = pieces.encode_decode(docs, piece_model_path())
    return out.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_languages),
    ("exact_dedup", keep_distinct),
    ("near_dedup", keep_one_of_near),
    ("mix", mix),
    ("tokens", tokens),
]

#: Fingerprints, language models and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
