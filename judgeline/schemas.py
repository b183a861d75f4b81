"""Canonical schemas. Ids stay strings end to end."""

from pyspark.sql import types as T


def _schema(*cols):
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols])


S, I, D, L = T.StringType(), T.IntegerType(), T.DoubleType(), T.LongType()

CORPUS = _schema(("did", S), ("title", S), ("text", S))
QUERIES = _schema(("qid", S), ("query", S))
QRELS = _schema(("qid", S), ("iter", S), ("did", S), ("label", I), ("evidence", S))
RUN = _schema(("run_id", S), ("qid", S), ("did", S), ("rank", I), ("score", D))
CHUNKS = _schema(("cid", S), ("did", S), ("idx", I), ("text", S))
TRAIN_GROUP = _schema(
    ("query", S),
    ("pos", T.ArrayType(S)),
    ("neg", T.ArrayType(S)),
    ("pos_scores", T.ArrayType(D)),
    ("neg_scores", T.ArrayType(D)),
    ("prompt", S),
    ("type", S),
)
