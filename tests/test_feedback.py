"""The exact rules of feedback requests, one case each, and the window against a sequential run."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import web
from lodestack.operators import feedback, refresh, report
from lodestack.sources import pages, tables


def test_validation(spark):
    cases = {
        '{"content":"x"}': 200, '{"content":"  "}': 200, '{"content":""}': 400, '{"content":0}': 400, '{"content":false}': 400, '{"content":null}': 400, "{}": 400,
        '{"content":[]}': 200, '{"content":{}}': 200, "null": 500, '{"a":1}x': 400, "": 400, "{'a':1}": 400, '{"content":NaN}': 400,
        '{"content":"' + "a" * 4000 + '"}': 200, '{"content":"' + "a" * 4001 + '"}': 400, '{"content":"' + "😀" * 2001 + '"}': 400, '{"content":"　' + "a" * 4000 + ' "}': 200,
    }
    rows = feedback.validated(spark.createDataFrame([(b,) for b in cases], "body string")).collect()
    assert {r["body"]: r["status"] for r in rows} == cases


def test_validation_of_what_scripts_make_of_values(spark):
    words = lambda n: '{"content":[' + ",".join(['"seven77"'] * n) + "]}"
    cases = {
        "\nnull": 500, '{"content":"a","content":"b"}': 200, '{"content":"a","content":""}': 400, '{"x":1,"x":2,"content":"hi"}': 200,
        '{"content":{"a":"' + "b" * 5000 + '"}}': 200, words(450): 200, words(501): 400, '{"content":[1,null,1.5,true]}': 200, "[1]": 400, '"x"': 400, "3": 400, '{"content":1e999}': 200,
    }
    rows = feedback.validated(spark.createDataFrame([(b,) for b in cases], "body string")).collect()
    assert {r["body"][:40]: r["status"] for r in rows} == {b[:40]: s for b, s in cases.items()}


def test_no_body_fails_the_job(spark):
    bodies = {
        '{"content":' + "[" * 3000 + "]" * 3000 + "}": 400, '{"content":' + "9" * 5000 + "}": 400, '\ufeff{"content":"x"}': 200, '{"content":"x"}{"content":"y"}': 400, '{"content":"x"},{"content":"y"}': 400,
        '{"content":"x"}]': 400, "]": 400, "[": 400, '{"content":"\\ud800"}': 200, '{"content":{"a":1,"a":2}}': 400, '{"content":[[1],{"a":2}]}': 200, "\0": 400, '{"content":-0.0}': 400, '{"content":0e5}': 400,
    }
    rows = feedback.validated(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert {r["body"][:30]: r["status"] for r in rows} == {b[:30]: s for b, s in bodies.items()}
    replies = spark.createDataFrame([(True, b) for b in bodies], "up boolean, reply string")
    assert {r["status"] for r in feedback.answered(replies, "up", "reply").collect()} == {502}


def test_replies_keys_and_received_bodies(spark):
    replies = [(True, "{", 502), (True, "null", 500), (False, '{"ok":true}', 502), (True, '{"ok":true}', 200), (True, '{"ok":0}', 502), (True, '{"ok":[]}', 200), (None, '{"ok":1}', 502), (True, None, 502), (True, "[]", 502)]
    got = feedback.answered(spark.createDataFrame(replies, "up boolean, reply string, want int"), "up", "reply").collect()
    assert all(r["status"] == r["want"] for r in got)
    bodies = feedback.received(spark.createDataFrame([("",), (None,), ('{"a":1}',)], "body string"))
    assert [r[0] for r in bodies.select(F.to_json("data")).collect()] == ["{}", "{}", '{"a":1}']
    for bad in ("{", '{"a":1}x', '{"a":1}]', '1],[2', '{"a":1},{"a":2}', '{"a":1,"a":2}', " "):
        with pytest.raises(Exception):
            feedback.received(spark.createDataFrame([(bad,)], "body string")).collect()
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        last = feedback.received(spark.createDataFrame([('{"a":1,"a":2}',)], "body string"))
        assert last.select(F.to_json("data")).first()[0] == '{"a":2}'
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    keys = spark.createDataFrame([(None, datetime.datetime(2024, 1, 2, 3))], "ip string, ts timestamp_ntz").select(feedback.limit_key(F.col("ip"), F.col("ts")))
    assert keys.first()[0] == "feedback:unknown:2024-01-02"


def test_snapshot_may_be_written_from_itself_and_survives_a_failure(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    tables.write_snapshot(df, path)
    again = tables.read_jsonl(spark, path, df.schema).drop("_corrupt_record")
    tables.write_snapshot(again.where("id = 2"), path)
    with pytest.raises(Exception):
        tables.write_snapshot(df.select("id", F.raise_error(F.lit("no")).alias("x")), path)
    assert tables.read_jsonl(spark, path, df.schema).drop("_corrupt_record").collect() == [(2, "b")]


def test_bundle_and_titles(spark, tmp_path):
    parts = report.write_bundle(spark.createDataFrame([(i, "<x>") for i in range(10)], "id long, x string"), f"file://{tmp_path}/b", "T<", "id", 3)
    assert {(r["part"], r["rows"]) for r in parts.collect()} == {("data/bucket=0", 4), ("data/bucket=1", 3), ("data/bucket=2", 3)}
    text = (tmp_path / "b" / "index.html").read_text()
    assert "T&lt;" in text and all(f"data/bucket={i}" in text for i in range(3))
    assert "The first 2 rows" in report.page("t", spark.range(3), 2)
    html = "<title>A &amp; b</title><svg><title>icon</title></svg><a href=x>link</a><script>no</script> text"
    row = pages.extract(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert tuple(row[0]) == (1, "A & b", 1, 8) and tuple(row[1]) == (2, None, 0, 0)


def test_limit_is_sequential(spark):
    r, start, rows = random.Random(3), datetime.datetime(2024, 1, 1), []
    for i in range(600):
        rows.append((i, start + datetime.timedelta(minutes=r.randrange(4000)), r.choice(["a", "b", None, ""]), r.choice(["POST", "POST", "POST", "GET", "OPTIONS"]), r.random() < 0.8))
    got = {x["id"]: x["status"] for x in feedback.limited(spark.createDataFrame(rows, "id long, ts timestamp, ip string, method string, valid boolean")).collect()}
    used, want = {}, {}
    for i, ts, ip, method, valid in sorted(rows, key=lambda x: (x[1], x[0])):
        k = (ip or "unknown", ts.date())
        if method != "POST":
            want[i] = 200 if method == "OPTIONS" else 405
        elif used.get(k, 0) >= 10:
            want[i] = 429
        elif not valid:
            want[i] = 400
        else:
            used[k] = used.get(k, 0) + 1
            want[i] = 200
    assert got == want


def test_the_limits_rank_is_cut_before_the_shuffle(spark):
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i // 60, i % 60), None, "POST", True) for i in range(300)]
    df = feedback.limited(spark.createDataFrame(rows, "id long, ts timestamp, ip string, method string, valid boolean"))
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in df.where("status = 200").collect()) == list(range(10))
    none = feedback.limited(spark.createDataFrame(rows[:3], "id long, ts timestamp, ip string, method string, valid boolean"), 0)
    assert {r["status"] for r in none.collect()} == {429}


def test_web_functions(spark):
    df = spark.createDataFrame([("😀",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(web.utf16_length(F.col("s"))).collect()] == [2, 0, None]
    assert [r[0] for r in df.select(web.or_default(F.col("s"), "d")).collect()] == ["😀", "d", "d"]
    nums = spark.createDataFrame([("12",), ("",), ("x",), (None,)], "s string")
    assert [r[0] for r in nums.select(web.number_or_zero(F.col("s"))).collect()] == [12, 0, 0, 0]


def test_mail_needs_secret(spark):
    df = spark.createDataFrame([(1, "k", None, None, None, None, "c"), (2, None, "t", "1", "m", "i", "c")], "id long, secret string, type string, version string, contact string, ip string, content string")
    one, two = feedback.mail_rows(df, "k", "to").orderBy("id").collect()
    assert one["ok"] and one["subject"].endswith("其他") and "类型: undefined" in one["body"] and not two["ok"]
    assert not any(r["ok"] for r in feedback.mail_rows(df, "", "to").collect())


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, v long, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "k long, v long, x string")
    once = refresh.upsert(old, new, "k", ["v"])
    assert sorted(once.collect()) == sorted(refresh.upsert(once, new, "k", ["v"]).collect()) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]


def test_snapshot_history_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01", 1, "é<"), (1, "2024-01-01", 2, "new"), (2, "2024-01-02", 1, None)], "id long, snap_date string, version long, name string")
    path = f"file://{tmp_path}"
    tables.write_snapshot(df, f"{path}/snap")
    assert sorted(tables.read_jsonl(spark, f"{path}/snap", df.schema).drop("_corrupt_record").collect()) == sorted(df.collect())
    with open(tmp_path / "bad.jsonl", "w") as f:
        f.write('{"id": 1}\n\n{broken\n')
    rows = tables.read_jsonl(spark, f"{path}/bad.jsonl", df.schema).collect()
    assert [r["_corrupt_record"] for r in rows] == [None, "{broken"]
    tables.append_history(df, f"{path}/history")
    tables.append_history(df, f"{path}/history")
    assert sorted((r["id"], r["name"] or "") for r in tables.read_history(spark, f"{path}/history", "id").collect()) == [(1, "new"), (2, "")]
    report.write_parts(report.bucketed(df, "id", 2), f"{path}/data")
    assert sorted(p.name for p in (tmp_path / "data").glob("bucket=*")) == ["bucket=0", "bucket=1"]
    assert "&lt;" in report.page("t", df.select("name"))
