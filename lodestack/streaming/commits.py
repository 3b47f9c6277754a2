"""Tables that a stream's batches are committed to, so that a query may stop, fail and go on, and a repeated batch changes nothing.

A batch is written beside what is there, under its number; a small file in the log then makes it count. Batches commit in order of their numbers, which
the caller's checkpoint keeps from run to run. Readers see committed batches alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CommitLog:
    """One small JSON file for each committed batch."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = path.rstrip("/")
        self._fs = self.at(self._path).getFileSystem(self._conf)

    def at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(path))) if self._fs.exists(self.at(path)) else []

    def remove(self, path: str) -> None:
        self._fs.delete(self.at(path), True)

    def last(self) -> int:
        """The number of the last committed batch, -1 if there is none."""
        return max((int(n.split(".")[0]) for n in self.names(self._path) if n.endswith(".json") and n[0].isdigit()), default=-1)

    def entry(self, number: int) -> dict:
        stream = self._fs.open(self.at(f"{self._path}/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, number: int, entry: dict) -> None:
        """Written whole under another name, then renamed: there is no half of an entry."""
        staged = self.at(f"{self._path}/_{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not self._fs.rename(staged, self.at(f"{self._path}/{number:012d}.json")):
            raise OSError(f"cannot commit batch {number} to {self._path}")


class AppendedTable:
    """The rows of all committed batches."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self._spark, self._path, self._schema, self.log = spark, path.rstrip("/"), schema, CommitLog(spark, f"{path.rstrip('/')}/log")

    def add(self, batch: DataFrame, number: int) -> None:
        if number <= self.log.last():
            return
        batch.write.mode("overwrite").parquet(f"{self._path}/data/batch={number}")  # in place of what a broken run left
        self.log.commit(number, {})

    def read(self) -> DataFrame:
        """With the number of its batch in each row."""
        if (last := self.log.last()) < 0:
            return self._spark.createDataFrame([], StructType(list(self._schema)).add("batch", "long"))
        rows = self._spark.read.schema(StructType(list(self._schema)).add("batch", "long")).parquet(f"{self._path}/data")
        return rows.where(F.col("batch") <= last)


class KeyedSnapshot:
    """The newest row of each key. Keys are dealt to ``buckets``; a batch rewrites only the buckets that it has rows for, and the log says where each bucket lies.

    ``version``: columns that tell which of two rows is newer; of equal ones, the one that is there stays."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], version: list[str], buckets: int = 16):
        self._spark, self._path, self._schema = spark, path.rstrip("/"), schema
        self._key, self._version, self._buckets = key, version, buckets
        self.log = CommitLog(spark, f"{self._path}/log")

    def _places(self) -> dict[str, int]:
        """The batch that wrote each bucket."""
        return self.log.entry(last)["buckets"] if (last := self.log.last()) >= 0 else {}

    def _newest(self, rows: DataFrame, order: Column) -> DataFrame:
        rest = [c for c in self._schema.names if c not in self._key]
        newest = rows.groupBy("bucket", *self._key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
        return newest.select("bucket", *self._key, "_r.*").select(*self._schema.names, "bucket")

    def merge(self, batch: DataFrame, number: int) -> None:
        if number <= self.log.last():
            return
        staged = f"{self._path}/staged/batch={number}"
        keyed = batch.select(*self._schema.names).withColumn("bucket", F.pmod(F.xxhash64(*self._key), F.lit(self._buckets)).cast("int"))
        self._newest(keyed, F.struct(*self._version)).write.mode("overwrite").partitionBy("bucket").parquet(staged)
        touched = [n.split("=")[1] for n in self.log.names(staged) if n.startswith("bucket=")]
        places = self._places()
        if touched:
            full = StructType(list(self._schema)).add("bucket", "integer")
            new = self._spark.read.schema(full).parquet(staged).withColumn("_new", F.lit(1))
            before = [f"{self._path}/data/batch={places[b]}/bucket={b}" for b in touched if b in places]
            if before:
                old = self._spark.read.schema(full).option("basePath", f"{self._path}/data").parquet(*before).select(*full.names, F.lit(0).alias("_new"))
                new = new.unionByName(old)
            self._newest(new, F.struct(*self._version, -F.col("_new"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self._path}/data/batch={number}")
        self.log.commit(number, {"buckets": places | {b: number for b in touched}})
        self.log.remove(staged)

    def read(self) -> DataFrame:
        places = self._places()
        if not places:
            return self._spark.createDataFrame([], self._schema)
        paths = [f"{self._path}/data/batch={n}/bucket={b}" for b, n in places.items()]
        return self._spark.read.schema(self._schema).parquet(*paths)

    def tidy(self) -> None:
        """Delete what the last commit no longer uses; not while an earlier state is being read."""
        places = self._places()
        for name in self.log.names(f"{self._path}/data"):
            number = int(name.split("=")[1])
            used = {f"bucket={b}" for b, n in places.items() if n == number}
            if number <= self.log.last():
                for bucket in self.log.names(f"{self._path}/data/{name}"):
                    if bucket not in used and bucket.startswith("bucket="):
                        self.log.remove(f"{self._path}/data/{name}/{bucket}")
