"""A corpus pipeline: five stages over ``documents``, each written and read again before the next.

Toxic documents go; of equal texts the smallest id stays; of each group of near copies (five-word shingles, Jaccard
0.8) the smallest id stays; secrets in the texts are masked (``n_chars`` follows); the rest is packed into sequences of 2048 tokens.

Cases: null and empty texts are no toxic ones, and all but the first of them go as equal texts; documents with a null id are judged as others are, and stay where no copy with an id
is there; rows alike in id and text count as copies; very long texts are read whole in each stage; further columns, those named as an operator's own too, are kept up to the
last stage; an empty table gives an empty result; null ``n_chars``, ``lang`` and ``source`` are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from lodestack.llm.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a secret keep their ``n_chars`` as it was."""
    masked = secrets.mask(docs.withColumn("__length_before", F.length("text")), secrets.train(spark))
    changed = F.contains("text", F.lit(secrets.MASK)) & (F.col("__length_before") != F.length("text"))
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: SQL cannot express training, sketches or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
