"""Staleness and newest-wins refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale(items: DataFrame, updated: str, as_of: str, days: int | None) -> DataFrame:
    """Items not updated within ``days`` before ``as_of``; all of them for None. A plain range filter, which reaches the scan."""
    if days is None:
        return items
    return items.where(F.col(updated) < F.expr(f"TIMESTAMP_NTZ '{as_of} 00:00:00' - INTERVAL {int(days)} DAYS"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: list[str]) -> DataFrame:
    """One row per key, the newest by ``version``: an aggregation with a partial step, not a window."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c != key and c not in version]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*version, *rest), F.struct(*version)).alias("r"))
    return newest.select(key, "r.*").select(old.columns)
