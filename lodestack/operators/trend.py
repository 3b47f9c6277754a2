"""Trend series, change over a period, ranking and comparison.

The reference formulas are unknown; these are this library's own: change is the cumulative value now less that at the last day not after
``as_of - days`` (null without one), the index is a weighted sum of ln(1 + x) / max ln(1 + x).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(F.col("value").cast(MONEY)).cast(MONEY).alias("v"))


def series(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("day")
    return daily(events).select(
        "user_id", "day", F.col("v").cast("double").alias("value"), F.lag("v").over(w).cast("double").alias("previous"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"),
    )


def change(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """(user_id, now, trend): all in one aggregation, since running totals at two days are two filtered sums."""
    day, then = F.to_date("ts"), F.date_sub(F.to_date(F.lit(as_of)), days)
    v = F.col("value").cast(MONEY)
    total = events.where(day <= F.to_date(F.lit(as_of))).groupBy("user_id").agg(F.sum(v).alias("now"), F.sum(F.when(day <= then, v)).alias("base"))
    return total.select("user_id", F.col("now").cast("double").alias("now"), (F.col("now") - F.col("base")).cast("double").alias("trend"))


def changes(events: DataFrame, periods: list[int]) -> DataFrame:
    """(user_id, day, value, change_<days>...): for every day of a pack, its cumulative value less that at the last day not after so many days before.

    The frames are ranges of day numbers, so days without a value need no rows; without a day to compare with, a change is null."""
    w = Window.partitionBy("user_id").orderBy("n")
    total = daily(events).withColumn("n", F.unix_date("day")).withColumn("total", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = [(F.col("total") - F.last("total").over(w.rangeBetween(Window.unboundedPreceding, -d))).cast("double").alias(f"change_{d}") for d in periods]
    return total.select("user_id", "day", F.col("v").cast("double").alias("value"), *since)


def period(events: DataFrame, begin: str, end: str) -> DataFrame:
    """(user_id, gained): the sum over the days from ``begin`` to ``end``, both included."""
    day = F.to_date("ts")
    return events.where(day.between(F.to_date(F.lit(begin)), F.to_date(F.lit(end)))).groupBy("user_id").agg(F.sum(F.col("value").cast(MONEY)).alias("gained"))


def leaderboard(events: DataFrame, as_of: str, days: int, k: int) -> DataFrame:
    return change(events, as_of, days).orderBy(F.desc_nulls_last("trend"), "user_id").limit(k)


def composite(measures: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, score, position). The largest values are one row, joined by broadcast; positions need one global order of keys."""
    logs = measures.select(key, *[F.log1p(c).alias(c) for c in weights])
    tops = logs.agg(*[F.max(c).alias(f"top_{c}") for c in weights])
    parts = [F.lit(w) * F.coalesce(F.try_divide(F.col(c), F.col(f"top_{c}")), F.lit(0.0)) for c, w in weights.items()]
    scored = logs.join(F.broadcast(tops)).select(key, F.round(reduce(lambda a, b: a + b, parts).cast("decimal(20,10)"), 6).cast("double").alias("score"))
    return ranked(scored, "score", key)


def _cuts(rows: DataFrame, columns: list[str], parts: int) -> dict[str, list[float]]:
    """For each column the values that cut it into ``parts`` ranges of about as many rows, by one mergeable quantile sketch each."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    quantiles = lambda x: F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x), shares))
    found = rows.agg(*[quantiles(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: sorted({x for x in found[c] or [] if x is not None}) for c in columns}


def ranked(scored: DataFrame, by: str, key: str, parts: int | None = None) -> DataFrame:
    """Adds ``position`` = 1 + rows with a larger value, ties by key; null values come last.

    Quantile sketches cut the values, and the keys, into ranges of about equal size. Rows are counted by value and range of keys, the counts are summed up in order, range of
    values by range, and each row finds its place among those of its value and range of keys: one shuffle of the rows, and a value that half of them have is still many groups.
    Keys that are no numbers are one range. The sketches only deal rows out; positions are exact."""
    parts = parts or max(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    numeric = scored.schema[key].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")
    cuts = _cuts(scored, [by, key] if numeric else [by], parts)
    above = lambda c, keep: F.size(F.filter(F.array(*[F.lit(x) for x in cuts[c]]).cast("array<double>"), lambda x: keep(x, F.col(c).cast("double"))))
    band = F.when(F.col(by).isNull(), len(cuts[by]) + 1).otherwise(above(by, lambda x, v: x > v))
    rows = scored.select("*", band.alias("_band"), (F.coalesce(above(key, lambda x, v: x < v), F.lit(-1)) if numeric else F.lit(0)).alias("_range"))
    counts = rows.groupBy("_band", F.col(by).alias("_by"), "_range").agg(F.count("*").alias("n"))
    bands = counts.groupBy("_band").agg(F.sum("n").alias("n"))  # a row per range of values
    before_band = bands.select("_band", F.coalesce(F.sum("n").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_band").orderBy(F.desc_nulls_last("_by"), "_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_i", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(before_band), "_band").select("_by", F.col("_range").alias("_of"), (F.col("_b") + F.col("_i")).alias("_before"))
    placed = rows.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    own = F.row_number().over(Window.partitionBy(by, "_range").orderBy(key))
    return placed.select(*scored.columns, (F.col("_before") + own).alias("position"))
