"""I1 score_stream: score arriving records continuously.

readStream (schema fixed up front) -> the same typed projection and scorer as
batch scoring -> valid rows to a parquet sink, rows over the slot limit to a
quarantine sink.  Each micro-batch writes its own folder (``epoch=N``) with
overwrite, so a batch that is replayed after a crash between the two writes
replaces its rows instead of adding them again.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import Scorer, score_batch, score_requests
from ..session import DROP_SHUFFLES, settings

PACKED = "zstd"  # of the documents' files: texts of one kind pack well


def start_score_stream(spark: SparkSession, source: DataFrame, to_records: Callable[[DataFrame], DataFrame],
                       scorer: Scorer, keep: Sequence[str], out_path: str, quarantine_path: str,
                       checkpoint: str, available_now: bool = True):
    """Start the streaming query; returns the StreamingQuery (foreachBatch, two sinks)."""
    scored = score_batch(to_records(source), scorer, keep)

    sink = epoch_sink(out_path, quarantine_path)
    w = scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_request_stream(requests: DataFrame, with_posthoc: Scorer, without: Scorer, out_path: str, quarantine_path: str,
                         checkpoint: str, request_id: str = "request_id", arrived: str = "arrived", body: str = "body",
                         within: str = "1 hour", available_now: bool = True):
    """Score request documents as they come; returns the StreamingQuery.

    A request that is sent again within ``within`` of its first arrival is dropped, by
    its id (the state holds the ids of that time only, in RocksDB: on disk, not in the
    executors' heap).  Bodies that can't be read, and configurations over the slot limit,
    go to the quarantine with their error.
    """
    once = requests.withWatermark(arrived, within).dropDuplicatesWithinWatermark([request_id])
    scored = score_requests(once, with_posthoc, without, column=body, keep=[request_id, body])
    scored = scored.select(request_id, body, "model_type", "probability", "importance", "error")
    w = scored.writeStream.foreachBatch(epoch_sink(out_path, quarantine_path)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    with settings(requests.sparkSession, STATE | DROP_SHUFFLES):  # the query keeps the settings it starts with
        return w.start()


#: Ids in RocksDB, its memory bounded however many stores an executor holds.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def epoch_sink(out_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """Write a scored micro-batch to the two sinks, under its epoch."""
    def sink(batch: DataFrame, epoch: int) -> None:
        # the micro-batch feeds two sinks: it is scored once and stored packed, which takes far less room than a persisted copy
        staged = f"{out_path}/_staged/epoch={epoch}"
        batch.write.mode("overwrite").option("compression", PACKED).parquet(staged)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(staged)
        rows.where(F.col("error").isNull()).write.mode("overwrite").option("compression", PACKED).parquet(f"{out_path}/epoch={epoch}")
        rows.where(F.col("error").isNotNull()).write.mode("overwrite").option("compression", PACKED).parquet(f"{quarantine_path}/epoch={epoch}")
        _remove(batch.sparkSession, f"{out_path}/_staged")
    return sink


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
