"""What every operator of this subpackage needs: the shared folder, written tables, and shipped code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.sources.shipping import ship  # noqa: F401  for the operators here
from lodestack.sources.tables import remove
from lodestack.sources.tables import shared_path as scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestack_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    if path := getattr(df, "_lodestack_path", None):
        remove(df.sparkSession, path)


def parallelism(spark: SparkSession) -> int:
    """How many parts a shuffle gets where the number has to be named."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
