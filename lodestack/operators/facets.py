"""Counts of facet values beside the filters that are set, by bitmaps.

Each value of a facet has a bitmap of its packs, in buckets of 32,768 ids, so a value that a third of all packs have is many rows of 4 KB each. A filter is the union of its
values' bitmaps. A facet's values are counted among the packs that all other facets' filters leave: what choosing a value would give; its own filter does not hold for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(values: DataFrame) -> DataFrame:
    """(facet, value, bucket, map) of rows (facet, value, id); repeated rows count once."""
    held = values.dropna().select("facet", "value", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"))
    return held.groupBy("facet", "value", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))


def counts(maps: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """(facet, value, packs) of every value of the table of ``bitmaps``, 0 included; ``chosen``: the values set in each facet that has a filter."""
    values = maps.select("facet", "value", "bucket", "map")
    if not chosen:
        return values.groupBy("facet", "value").agg(F.sum(F.bitmap_count("map")).alias("packs"))
    is_chosen = reduce(lambda a, b: a | b, [(F.col("facet") == f) & F.col("value").isin(v) for f, v in chosen.items()])
    filters = values.where(is_chosen).groupBy(F.col("facet").alias("by"), "bucket").agg(F.bitmap_or_agg("map").alias("map"))
    others = filters.join(values.select("facet", "value", "bucket"), "bucket").where("by <> facet").select("facet", "value", "bucket", "map")
    met = values.unionByName(others).groupBy("facet", "value", "bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("map").alias("map"))
    # a bucket in which another filter has no pack has no row of that filter
    needed = 1 + F.lit(len(chosen)) - F.col("facet").isin(list(chosen)).cast("int")
    return met.groupBy("facet", "value").agg(F.sum(F.when(F.col("n") == needed, F.bitmap_count("map")).otherwise(0)).alias("packs"))
