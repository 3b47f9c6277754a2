"""Comments organised: the terms that tell a pack's comments from all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinguishing_terms(comments: DataFrame, pack: str, text: str, most: int) -> DataFrame:
    """(pack_id, term, n, score, rank): the ``most`` terms of each pack that stand out most, by the log-likelihood ratio of their share in the pack's comments and in all others'.

    Only terms more frequent in the pack than elsewhere count. Scores are rounded to six digits, and equal ones ranked by term. Ranks are cut per task before the shuffle, so a pack's
    terms never meet whole in one."""
    words = comments.select(F.col(pack).alias("pack_id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    n = words.groupBy("pack_id", "term").agg(F.count("*").cast("double").alias("a"))
    packs = n.groupBy("pack_id").agg(F.sum("a").alias("c"))
    terms = n.groupBy("term").agg(F.sum("a").alias("t"))
    every = n.agg(F.sum("a").alias("all"))  # one row
    a, c, t, total = (F.col(x) for x in ("a", "c", "t", "all"))
    inside, outside = a * F.ln(a * total / (c * t)), F.when(t > a, (t - a) * F.ln((t - a) * total / ((total - c) * t))).otherwise(0.0)
    scored = n.join(packs, "pack_id").join(terms, "term").join(F.broadcast(every)).where(a * total > c * t)
    scored = scored.select("pack_id", "term", a.cast("long").alias("n"), F.round(2 * (inside + outside), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("pack_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long"))
