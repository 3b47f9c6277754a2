"""Reading and keeping snapshots: Parquet tables, JSON lines with declared schemas, and the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.sources.shipping import ship

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; its times have no zone and are read as UTC."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Only a local session without that setting (tests) gets a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestack-")
    return _own[sc.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; it goes when the driver ends, or by ``remove``."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            continue


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines by a declared schema; a malformed line gives nulls and its text in ``_corrupt_record``."""
    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """The current snapshot as JSON lines, in place of the one before.

    It is written whole beside ``path`` and then renamed, so a failed job leaves the old one, and ``df`` may read it."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    tag = uuid.uuid4().hex
    staged, old = f"{path.rstrip('/')}.staged-{tag}", f"{path.rstrip('/')}.old-{tag}"
    df.write.option("ignoreNullFields", "false").json(staged)
    fs = at(path).getFileSystem(conf)
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(at(staged), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"cannot put the snapshot at {path}")
    if had:
        fs.delete(at(old), True)


def append_history(df: DataFrame, path: str, day: str = "snap_date") -> None:
    df.write.mode("append").partitionBy(day).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a written table in the shared folder: worked out once, and safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_history(spark: SparkSession, path: str, key: str, day: str = "snap_date", version: str = "version") -> DataFrame:
    """One row per key and day, the one of the largest version."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, day)]
    newest = rows.groupBy(key, day).agg(F.max_by(F.struct(*rest), version).alias("r"))
    return newest.select(key, day, "r.*")


def compact_history(spark: SparkSession, path: str, key: str, day: str = "snap_date", version: str = "version") -> int:
    """Folds each day that has several files to one row per key, the newest, in few files; returns how many days were folded. Readers get the same rows before and after.

    The folded days are written whole beside the history first; each then takes its day's place by Spark's overwrite of single partitions. A run that breaks off is done again; days
    that were appended to while it ran must not be among those folded, so it runs between appends, as the refresh does."""
    rows = spark.read.parquet(path)
    files = rows.groupBy(day).agg(F.count_distinct("_metadata.file_path").alias("files")).where("files > 1").select(day)
    days = [r[0] for r in files.collect()]  # a row per day at most
    if not days:
        return 0
    rest = [c for c in rows.columns if c not in (key, day)]
    newest = rows.where(F.col(day).isin(days)).groupBy(key, day).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, day, "r.*").select(rows.columns)
    folded = kept(newest.repartition(day), "folded")
    folded.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return len(days)
