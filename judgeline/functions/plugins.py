"""User functions: chunkers, embedders, scorers and metrics enter as columns, pandas UDFs or names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgeline.functions import text as X
from judgeline.functions.scoring import softmax  # noqa: F401  (part of the plug-in surface)

#: Chunkers by name: (text column, window) -> ARRAY<STRING>.
CHUNKERS: dict[str, Callable[[Column, int], Column]] = {
    "sliding": lambda text, window: X.chunk_sliding(text, window),
    "fixed": lambda text, window: X.chunk_fixed(text, window),
    "paragraphs": lambda text, window: X.chunk_paragraphs(text),
    "packed": lambda text, window: X.chunk_paragraph_pack(text, window),
}


def chunk_corpus(corpus: DataFrame, chunker: Callable[[Column, int], Column] | str, window: int) -> DataFrame:
    """(cid, did, idx, text) with a named chunker or one's own column function."""
    make = CHUNKERS[chunker] if isinstance(chunker, str) else chunker
    rows = corpus.select("did", F.posexplode(make(F.col("text"), window)).alias("idx", "text"))
    return rows.select(X.chunk_id("did", "idx").alias("cid"), "did", "idx", "text")


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """A pandas UDF text -> vector from a function that loads a model; it is loaded once per Python worker task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist())))

    return embed


def scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """A pandas UDF (query, text) -> score from a function that loads a pair model."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            out = list(model(queries.tolist(), texts.tolist()))
            if len(out) != len(queries):
                raise ValueError("a scorer must return one score per pair")
            yield pd.Series(out, dtype="float64")

    return score
