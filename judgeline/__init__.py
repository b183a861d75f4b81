"""judgeline: retrieval-data preparation and relevance evaluation as Spark DataFrame operators.

Tables are plain DataFrames with fixed column names (see ``judgeline.schemas``):
corpus(did, text), queries(qid, query), qrels(qid, did, label), run(run_id, qid, did, rank, score).
"""

__version__ = "0.1.0"
