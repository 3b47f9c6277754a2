"""A kept snapshot that is refreshed by what has come since the last run, and daily counts that leave the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.operators.feedback import DAILY, route
from lodestack.streaming.commits import KeyedSnapshot
from lodestack.streaming.runs import run

COUNTED = "client string, day date, valid long, batch long"


class RefreshedSnapshot:
    """The newest row of each key of all that came; ``path`` has the snapshot and the query's checkpoint, and is the same in each run.

    The stream keeps no state: a batch is reduced to its newest rows and merged into the buckets that these fall into."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, version: list[str], buckets: int = 16):
        self._path = path.rstrip("/")
        self.snapshot = KeyedSnapshot(spark, f"{self._path}/snapshot", schema, [key], version, buckets)

    def run(self, stream: DataFrame) -> dict:
        return run(stream, f"{self._path}/checkpoint", self.snapshot.merge, "append")


class DailyCounts:
    """(client, day, valid, accepted) per client and UTC day; counts leave the state when a day two days later is seen, and stay in the table.

    Requests that come in a later batch than such a day are not counted: files should come in about the order of their days. Where each request needs its status, use ``limits``."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = path.rstrip("/")
        self.counts = KeyedSnapshot(spark, f"{self._path}/counts", StructType.fromDDL(COUNTED), ["client", "day"], ["batch"])

    def run(self, requests: DataFrame) -> dict:
        midnight = F.timestamp_seconds(F.unix_date(F.to_date("ts")) * 86_400)  # the same in every session time zone
        routed = route(requests).withColumn("midnight", midnight).withWatermark("midnight", "2 days")
        valid = F.col("routed").isNull() & F.coalesce("valid", F.lit(False))
        counted = routed.groupBy("client", "midnight").agg(F.sum(valid.cast("long")).alias("valid"))
        counted = counted.select("client", F.date_from_unix_date((F.unix_seconds("midnight") / 86_400).cast("int")).alias("day"), "valid")
        return run(counted, f"{self._path}/checkpoint", lambda b, n: self.counts.merge(b.withColumn("batch", F.lit(n).cast("long")), n), "update")

    def read(self, daily: int = DAILY) -> DataFrame:
        return self.counts.read().select("client", "day", "valid", F.least("valid", F.lit(daily)).alias("accepted"))
