"""The daily limit of requests as a state per client and UTC day, kept from batch to batch and from run to run.

The state is how many requests of the day were accepted. It expires a day after it was last written (by the clock, as a stored counter with a time to live does), so what is kept is
bounded by the clients of about two days. Nothing depends on a watermark: each request gets a status, however late it comes.

A batch is decided in the order of (ts, id), batches in the order of their arrival. A request that stands before one of an earlier batch is marked ``late``: its status follows from
the order of arrival and may differ from what the order of times would give. All others agree with ``operators.feedback.limited``. Late ones also go to a table of their own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from lodestack.operators.feedback import DAILY, route
from lodestack.sources.shipping import ship
from lodestack.streaming.commits import AppendedTable
from lodestack.streaming.runs import run

DECIDED = "id long, client string, day date, status int, late boolean"
#: Fixed value: how long a count is kept after it was written.
TTL_MS = 86_400_000


class DailyLimiter(StatefulProcessor):
    def __init__(self, daily: int, ttl_ms: int):
        self._daily, self._ttl = daily, ttl_ms

    def init(self, handle) -> None:
        self._used = handle.getValueState("used", "n int", self._ttl)
        self._seen = handle.getValueState("seen", "at long, id long", self._ttl)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows go out as soon as their status is certain; only those that may yet be accepted are held, about as many as the limit."""
        used = self._used.get()[0] if self._used.exists() else 0
        seen = tuple(self._seen.get()) if self._seen.exists() else None
        room, held, last = self._daily - used, None, seen
        for frame in rows:
            frame = frame.sort_values(["at", "id"])
            top = tuple(int(frame[c].iloc[-1]) for c in ("at", "id"))
            last = top if last is None else max(last, top)
            routed = frame["routed"].notna()
            yield self._out(key, frame[routed], frame.loc[routed, "routed"], seen)
            posts = frame[~routed]
            held = posts if held is None else pd.concat([held, posts]).sort_values(["at", "id"])
            before = held["valid"].cumsum() - held["valid"]  # accepted ones at least, before each
            full = before >= room
            yield self._out(key, held[full], 429, seen)
            held = held[~full]
        if held is not None and len(held):
            accepted = held["valid"].astype(bool)
            yield self._out(key, held, accepted.map({True: 200, False: 400}), seen)
            if accepted.any():
                self._used.update((used + int(accepted.sum()),))
        if last is not None:
            self._seen.update(last)

    @staticmethod
    def _out(key, frame: pd.DataFrame, status, seen) -> pd.DataFrame:
        late = [seen is not None and (a, i) < seen for a, i in zip(frame["at"], frame["id"])]
        return pd.DataFrame({"id": frame["id"], "client": key[0], "day": key[1], "status": status, "late": late}).astype({"status": "int32", "late": bool})


class LimitedRequests:
    """Where the decisions of a stream of requests are kept: ``path`` has the tables and the query's checkpoint, and is the same in each run."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        schema = StructType.fromDDL(DECIDED)
        self.decisions = AppendedTable(spark, f"{self._path}/decisions", schema)
        self.late = AppendedTable(spark, f"{self._path}/late", schema)

    def _keep(self, batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            self.late.add(batch.where("late"), number)
            self.decisions.add(batch, number)
        finally:
            batch.unpersist()

    def run(self, requests: DataFrame, daily: int = DAILY, ttl_ms: int = TTL_MS) -> dict:
        """Decide what has come since the last run; ``requests``: a stream with id, ts, ip, method and valid. Returns the numbers of batches and rows."""
        ship(self._spark)
        # Spark also unpickles the processor in a process of the driver that has no files of ours
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        routed = route(requests).withColumns({"day": F.to_date("ts"), "at": F.unix_micros(F.col("ts").cast("timestamp")), "valid": F.coalesce("valid", F.lit(False))})
        keyed = routed.select("id", "at", "client", "day", "routed", "valid").groupBy("client", "day")
        decided = keyed.transformWithStateInPandas(DailyLimiter(daily, ttl_ms), DECIDED, "Append", "ProcessingTime")
        return run(decided, f"{self._path}/checkpoint", self._keep, "append")
