"""The order of run rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 9


def ranking(keys: list[str]) -> "Window":
    """Score descending, document id ascending; scores are compared on nine digits so that summation order
    cannot swap equal documents."""
    return Window.partitionBy(*keys).orderBy(F.round("score", SCORE_DIGITS).desc(), F.col("did").asc())


def topk_run(run: DataFrame, k: int, offset: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Ranks (offset, offset + k] of every query."""
    keys = keys or [c for c in ("run_id", "qid") if c in run.columns]
    ranked = run.withColumn("rank", F.row_number().over(ranking(keys))).where(F.col("rank") <= offset + k)
    return ranked.where(F.col("rank") > offset) if offset else ranked
