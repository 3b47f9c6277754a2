"""Search and facet filters over packs (composite items), their tags, components (mods) and comments.

Terms are literal and case is ignored; all terms of a box must match, facets combine by AND, values of a facet by OR
unless "all" is asked for. Filters through the bridge table are semi-joins, so packs never multiply.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(text: Column, *terms: str) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(t.lower())) for t in terms])


def bridge(lineitem: DataFrame) -> DataFrame:
    """Distinct (pack, mod) pairs."""
    return lineitem.select(F.col("l_orderkey").alias("pack_id"), F.col("l_partkey").alias("mod_id")).distinct()


def packs_with(lineitem: DataFrame, part: DataFrame, condition: Column) -> DataFrame:
    """pack_id of the packs with a component that meets the condition."""
    chosen = part.where(condition).select(F.col("p_partkey").alias("l_partkey"))
    return lineitem.select("l_orderkey", "l_partkey").join(chosen, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("pack_id")).distinct()


def packs_with_all(lineitem: DataFrame, part: DataFrame, column: str, values: list) -> DataFrame:
    """pack_id of the packs whose components have every value: relational division by a distinct count."""
    chosen = part.where(F.col(column).isin(values)).select(F.col("p_partkey").alias("l_partkey"), column)
    pairs = lineitem.select("l_orderkey", "l_partkey").join(chosen, "l_partkey")
    counted = pairs.groupBy(F.col("l_orderkey").alias("pack_id")).agg(F.count_distinct(column).alias("n"))
    return counted.where(F.col("n") == len(values)).select("pack_id")


def packs_by_field(lineitem: DataFrame, part: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(pack_id, field): packs with a component that meets the field's condition; components and bridge are read once for all fields."""
    met = F.filter(F.array(*[F.when(c, F.lit(field)) for field, c in conditions.items()]), lambda x: x.isNotNull())
    chosen = part.select(F.col("p_partkey").alias("l_partkey"), met.alias("met")).where(F.size("met") > 0)
    pairs = lineitem.select("l_orderkey", "l_partkey").join(chosen, "l_partkey")
    return pairs.select(F.col("l_orderkey").alias("pack_id"), F.explode("met").alias("field")).distinct()


def any_field(hits: dict[str, DataFrame], *by_field: DataFrame) -> DataFrame:
    """(pack_id, fields): the union of hits by field and of tables (pack_id, field), and which fields hit."""
    each = [df.select("pack_id", F.lit(name).alias("field")) for name, df in hits.items()] + [df.select("pack_id", "field") for df in by_field]
    return reduce(DataFrame.unionByName, each).groupBy("pack_id").agg(F.array_join(F.sort_array(F.collect_set("field")), ",").alias("fields"))
