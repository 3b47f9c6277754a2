"""Streams in several batches and runs: state that goes on, batches that are repeated, days out of order, and what expires."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestack.operators import feedback
from lodestack.streaming.commits import AppendedTable, KeyedSnapshot
from lodestack.streaming.limits import LimitedRequests
from lodestack.streaming.refresh import DailyCounts, RefreshedSnapshot
from lodestack.streaming.runs import arrived

REQUESTS = "id long, ts timestamp, ip string, method string, valid boolean"


def at(day, minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, minutes=minute)


def deliver(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # files are taken by their times


def in_order_of_arrival(batches, daily=10):
    """Each request's status, decided one by one: batches as they come, a batch by (ts, id)."""
    used, want = {}, {}
    for rows in batches:
        for i, ts, ip, method, valid in sorted(rows, key=lambda r: (r[1], r[0])):
            key = (ip or "unknown", ts.date())
            if method != "POST":
                want[i] = 200 if method == "OPTIONS" else 405
            elif used.get(key, 0) >= daily:
                want[i] = 429
            elif not valid:
                want[i] = 400
            else:
                used[key] = used.get(key, 0) + 1
                want[i] = 200
    return want


def test_every_request_is_decided_over_batches_days_and_runs(spark, tmp_path):
    r = random.Random(7)
    batches, i = [], 0
    for days in ([0], [9, 10], [1, 9], [11], [0, 12], [1, 10], [9]):
        rows = []
        for _ in range(60):
            i += 1
            rows.append((i, at(r.choice(days), r.randrange(1440)), r.choice(["a", "b", None, ""]), r.choice(["POST", "POST", "POST", "GET", "OPTIONS"]), r.random() < 0.8))
        batches.append(rows)
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = spark.createDataFrame([], REQUESTS).schema
    for rows in batches[:4]:
        deliver(spark, path, rows, REQUESTS)
    assert LimitedRequests(spark, out).run(arrived(spark, path, schema, 1)) == {"batches": 4, "rows": 240}
    for rows in batches[4:]:
        deliver(spark, path, rows, REQUESTS)
    decided = LimitedRequests(spark, out)  # as after a restart
    assert decided.run(arrived(spark, path, schema, 1)) == {"batches": 3, "rows": 180}
    got = decided.decisions.read().collect()
    assert len(got) == 420 and {x["id"]: x["status"] for x in got} == in_order_of_arrival(batches)
    # late: behind a request of an earlier batch of the client's day, and no other
    seen, late = {}, set()
    for rows in batches:
        late |= {x[0] for x in rows if (x[1], x[0]) < seen.get((x[2] or "unknown", x[1].date()), (datetime.datetime.min, 0))}
        for x in rows:
            key = (x[2] or "unknown", x[1].date())
            seen[key] = max(seen.get(key, (datetime.datetime.min, 0)), (x[1], x[0]))
    assert late and {x["id"] for x in got if x["late"]} == late == {x["id"] for x in decided.late.read().collect()}
    # a client's day without late requests is decided as in one batch
    days = {(x["client"], x["day"]) for x in got if x["late"]}
    whole = feedback.limited(spark.createDataFrame([x for rows in batches for x in rows], REQUESTS)).collect()
    same = {x["id"]: x["status"] for x in whole if (x["client"], x["ts"].date()) not in days}
    assert same and all({x["id"]: x["status"] for x in got}[k] == s for k, s in same.items())
    assert decided.run(arrived(spark, path, schema, 1)) == {"batches": 0, "rows": 0}


def test_counts_expire_and_large_groups_come_in_pieces(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/in", spark.createDataFrame([], REQUESTS).schema
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "7")
    try:
        first = [(i, at(0, (i * 37) % 100), "a", "POST", i % 3 > 0) for i in range(100)]
        deliver(spark, path, first, REQUESTS)
        decided = LimitedRequests(spark, f"file://{tmp_path}/out")
        decided.run(arrived(spark, path, schema), ttl_ms=1)
        assert {x["id"]: x["status"] for x in decided.decisions.read().collect()} == in_order_of_arrival([first])
        time.sleep(0.1)
        second = [(200 + i, at(0, 200 + i), "a", "POST", True) for i in range(12)]
        deliver(spark, path, second, REQUESTS)
        decided.run(arrived(spark, path, schema), ttl_ms=1)
    finally:
        spark.conf.set(limit, before)
    got = [x["status"] for x in decided.decisions.read().where("id >= 200").orderBy("id").collect()]
    assert got == [200] * 10 + [429] * 2  # the count of the first run is gone


def test_refresh_reads_only_what_is_new_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    ddl = "k long, v long, x string"
    schema, path = spark.createDataFrame([], ddl).schema, f"file://{tmp_path}/in"
    deliver(spark, path, [(k, 1, "one") for k in range(50)], ddl)
    deliver(spark, path, [(3, 2, "two"), (3, 0, "old"), (99, 1, None)], ddl)
    kept = RefreshedSnapshot(spark, f"file://{tmp_path}/kept", schema, "k", ["v"], 8)
    assert kept.run(arrived(spark, path, schema, 1)) == {"batches": 2, "rows": 53}
    deliver(spark, path, [(3, 1, "late"), (4, 5, "new"), (5, 1, "as old")], ddl)
    kept = RefreshedSnapshot(spark, f"file://{tmp_path}/kept", schema, "k", ["v"], 8)
    assert kept.run(arrived(spark, path, schema, 1)) == {"batches": 1, "rows": 3}
    want = {k: (1, "one") for k in range(50)} | {3: (2, "two"), 99: (1, None), 4: (5, "new")}
    rows = lambda: {r["k"]: (r["v"], r["x"]) for r in kept.snapshot.read().collect()}
    assert rows() == want and kept.snapshot.read().count() == 51
    kept.snapshot.merge(spark.createDataFrame([(7, 9, "again")], ddl), 2)
    assert rows() == want
    touched = {b for b, n in kept.snapshot.log.entry(2)["buckets"].items() if n == 2}
    assert 0 < len(touched) <= 3  # the other buckets were not written again
    kept.snapshot.tidy()
    assert rows() == want and sum(len(list(p.glob("bucket=*"))) for p in (tmp_path / "kept/snapshot/data").glob("batch=*")) == len(kept.snapshot.log.entry(2)["buckets"])


def test_a_batch_that_broke_off_is_not_seen_and_is_done_again(spark, tmp_path):
    ddl = "k long, v long"
    schema = spark.createDataFrame([], ddl).schema
    table = AppendedTable(spark, f"file://{tmp_path}/t", schema)
    assert table.read().count() == 0
    table.add(spark.createDataFrame([(1, 1)], ddl), 0)
    spark.createDataFrame([(8, 8)], ddl).write.parquet(f"file://{tmp_path}/t/data/batch=1")  # written, never committed
    assert [r["k"] for r in table.read().collect()] == [1]
    table.add(spark.createDataFrame([(2, 2)], ddl), 1)
    assert sorted((r["k"], r["batch"]) for r in table.read().collect()) == [(1, 0), (2, 1)]
    snap = KeyedSnapshot(spark, f"file://{tmp_path}/s", schema, ["k"], ["v"], 4)
    assert snap.read().count() == 0
    snap.merge(spark.createDataFrame([(1, 1), (None, 3)], ddl), 0)
    with pytest.raises(Exception):
        snap.merge(spark.createDataFrame([(1, 2)], ddl).select("k", F.raise_error(F.lit("no")).cast("long").alias("v")), 1)
    snap.merge(spark.createDataFrame([], ddl), 1)
    assert sorted(map(tuple, snap.read().collect()), key=repr) == [(1, 1), (None, 3)]


def test_daily_counts_in_two_runs(spark, tmp_path):
    path, schema = f"file://{tmp_path}/in", spark.createDataFrame([], REQUESTS).schema
    counts = DailyCounts(spark, f"file://{tmp_path}/counts")
    deliver(spark, path, [(i, at(0, i), "a", "POST", True) for i in range(7)], REQUESTS)
    counts.run(arrived(spark, path, schema))
    deliver(spark, path, [(10 + i, at(1 if i else 0, i), "a", "POST", True) for i in range(12)], REQUESTS)
    counts.run(arrived(spark, path, schema))
    assert sorted((r["day"].day, r["valid"], r["accepted"]) for r in counts.read().collect()) == [(1, 8, 8), (2, 11, 10)]
