"""Runs of Structured Streaming queries that end when the input is read and go on from the caller's checkpoint the next time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: States in RocksDB; and no batches without input, which a state that expires by the clock would ask for without end.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def arrived(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files under ``path``, the oldest first; a batch takes so many files at most, which bounds it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str) -> dict:
    """Give ``sink`` each batch of what came since the last run with this ``checkpoint``.

    Returns the numbers of batches with input and of rows read."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            conf.set(k, v)
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)
    try:
        q.awaitTermination()
        read = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()
    return {"batches": len(read), "rows": sum(read)}
