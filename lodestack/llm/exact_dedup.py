"""Operator 6: exact deduplication with DataFrame functions only.

Texts are grouped by a 128-bit content hash (two 64-bit hashes) together with the text itself, so
that the aggregation compares bytes inside a hash group and a collision never merges texts. Rows are counted before the shuffle,
so a text that a third of all rows share is one row per task afterwards. The groups, without texts, are joined back
to the rows by hash; only if some hash has two texts (a collision) do those rows' texts join too.

Cases: a null text counts as empty; a null id stands behind all others and is kept only if its group has no other id; rows that share
an id are each returned, with ``kept`` true on all that hold the id that stays; an empty table gives an empty table; other columns are kept by
``dedup`` and left out by ``groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit("second"), text).alias("_h2")]


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__dedup_key")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row; of equal texts the row with the ``keep`` ("min", the
    default, or "max") id stays."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    content = F.coalesce(F.col(text), F.lit("")).alias("_text")
    rows = df.select(F.col(doc_id).alias("_id"), content)
    hashed = rows.select("_id", *_hashes(F.col("_text")), "_text")
    best = F.min if keep == "min" else F.max
    per_text = hashed.groupBy("_h1", "_h2", "_text").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"))
    # which texts share both hashes: the first text's SHA-256 tells them apart in the written table
    table = written(per_text.select("_h1", "_h2", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    collided = table.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where("_n > 1").select("_h1", "_h2")
    narrow = hashed.select("_id", "_h1", "_h2")
    if collided.isEmpty():
        out = narrow.join(table, ["_h1", "_h2"])
    else:
        collided = written(collided, "collided")
        clear = narrow.join(table.join(collided, ["_h1", "_h2"], "left_anti"), ["_h1", "_h2"])
        again = hashed.join(collided, ["_h1", "_h2"], "left_semi")
        out = clear.unionByName(
            again.join(per_text.join(collided, ["_h1", "_h2"], "left_semi").withColumn("text_sha256", F.sha2("_text", 256)), ["_h1", "_h2", "_text"]).select(clear.columns)
        )
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("_id").alias(doc_id), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``df`` that stay, all columns; rows alike in id and text stay once."""
    stay = groups(df, doc_id, text, keep).where("kept").select(_key(doc_id), F.col("text_sha256").alias("__dedup_sha")).distinct()
    rows = df.select("*", _key(doc_id), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__dedup_sha"))
    # both steps deal rows by text and id, so a text with many rows is spread over tasks
    return rows.join(stay, ["__dedup_sha", "__dedup_key"], "left_semi").dropDuplicates(["__dedup_sha", "__dedup_key"]).select(df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_exact_dedup."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
