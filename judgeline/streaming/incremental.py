"""Streaming forms of the batch-bounded loops: top-k over arriving documents, running statistics, growing data sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from judgeline.operators.retrieve import topk_run

RUN_ROWS = T.StructType([
    T.StructField("qid", T.StringType()), T.StructField("did", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("rank", T.IntegerType())])


class SlotState:
    """A table that every batch replaces, in two slots of a shared folder.

    A batch overwrites the slot that the last finished batch before it did not use, and then notes its number and slot
    in ``done``. A batch that is repeated after a failure therefore starts from the same state and writes the same
    result; batches without rows, which never run, leave the state as it is.
    """

    DONE = "batch long, slot int"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _done(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.DONE).parquet(f"{self.path}/done")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.DONE)

    def _last(self, below: int | None = None) -> Row | None:
        done = self._done()
        return (done if below is None else done.where(F.col("batch") < below)).orderBy(F.desc("batch")).head()

    def _read(self, last: Row | None) -> DataFrame:
        if last is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/slot={last['slot']}")

    def before(self, batch_id: int) -> DataFrame:
        return self._read(self._last(batch_id))

    def save(self, rows: DataFrame, batch_id: int) -> None:
        last = self._last(batch_id)
        slot = 0 if last is None else 1 - last["slot"]
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/slot={slot}")
        self.spark.createDataFrame([(batch_id, slot)], self.DONE).coalesce(1).write.mode("append").parquet(f"{self.path}/done")

    def latest(self) -> DataFrame:
        """The state after the last finished batch, also when this application processed none."""
        return self._read(self._last())


class RunState(SlotState):
    """The top-k so far."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, RUN_ROWS)


def incremental_topk(
    docs: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    state: RunState,
    k: int,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the k best documents per query while document batches arrive.

    ``docs`` is a streaming DataFrame; ``retrieve`` turns one batch of documents into scored (qid, did, score) rows,
    already cut to k per query. The state holds k rows per query, whatever the number of documents seen.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # ``retrieve`` may read it more than once
        fresh = retrieve(batch).select("qid", "did", "score")
        seen = state.before(batch_id).select("qid", "did", "score")
        state.save(topk_run(seen.unionByName(fresh), k, keys=["qid"]), batch_id)
        batch.unpersist()

    writer = docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_score_stats(scores: DataFrame) -> DataFrame:
    """Streaming (or batch) count, mean, population deviation, minimum and maximum of scores per query."""
    return scores.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
        F.min("score").alias("min"), F.max("score").alias("max"))


def write_running(stats: DataFrame, state: SlotState, checkpoint: str) -> StreamingQuery:
    """Write the complete statistics after every batch, in place of the previous ones."""
    return (
        stats.writeStream.outputMode("complete").foreachBatch(state.save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def append_stream(rows: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append arriving rows to a data set; the checkpoint makes every row arrive once."""
    return (
        rows.writeStream.outputMode("append").format(fmt).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
