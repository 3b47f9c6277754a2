"""Posting lists, the text index, facet bitmaps and daily changes against plain Python, on odd tables and hot terms."""

import datetime
import random

from pyspark.sql import functions as F

from lodestack.operators import facets, postings, trend

PAIRS = "term string, id long"


def pairs_of(seed=1):
    """A term that a third of all ids have, terms of a range of ids, and rare ones."""
    r = random.Random(seed)
    rows = [("hot", i) for i in range(0, 3000, 3)] + [("low", i) for i in range(0, 200)] + [("high", i) for i in range(2500, 3000)]
    rows += [(f"t{r.randrange(40)}", r.randrange(3000)) for _ in range(2000)]
    return [*rows, *rows[:50], (None, 1), ("hot", None), ("negative", -5), ("negative", 7)]


def test_lists_are_sorted_whole_and_bounded(spark):
    rows = pairs_of()
    table = postings.build(spark.createDataFrame(rows, PAIRS), ["term"], "p", 64)
    got = table.collect()
    assert all(0 < r["n"] == len(r["ids"]) <= 64 and r["ids"] == sorted(set(r["ids"])) and 0 <= r["ids"][0] and r["ids"][-1] < 64 for r in got)
    assert all((r["first"], r["last"]) == (r["block"] * 64 + r["ids"][0], r["block"] * 64 + r["ids"][-1]) for r in got)
    assert len({(r["term"], r["block"]) for r in got}) == len(got)
    want = {(t, i) for t, i in rows if t is not None and i is not None}
    back = [(r["term"], r["id"]) for r in postings.ids(table, 64).select("term", "id").collect()]
    assert len(back) == len(want) and set(back) == want
    assert postings.build(spark.createDataFrame([], PAIRS), ["term"], "p").count() == 0


def test_any_and_all_are_sets_of_ids(spark):
    rows = pairs_of()
    table = postings.build(spark.createDataFrame(rows, PAIRS), ["term"], "p", 64)
    has = {}
    for term, i in rows:
        if term is not None and i is not None:
            has.setdefault(term, set()).add(i)
    found = lambda df: sorted(r["id"] for r in df.collect())
    assert found(postings.any_of(table, F.col("term").isin("hot", "t1", "nowhere"), 64)) == sorted(has["hot"] | has["t1"])
    own = F.when(F.col("term").isin("hot", "low", "t3"), F.col("term"))
    assert found(postings.all_of(table, own, 3, 64)) == sorted(has["hot"] & has["low"] & has["t3"])
    grouped = F.when(F.col("term").isin("t1", "t2"), "a").when(F.col("term") == "hot", "b")
    assert found(postings.all_of(table, grouped, 2, 64)) == sorted((has["t1"] | has["t2"]) & has["hot"])
    apart = F.when(F.col("term").isin("low", "high"), F.col("term"))
    assert found(postings.all_of(table, apart, 2, 64)) == []
    assert postings.skipped(table, apart, 2).first()["read"] == 0  # their blocks do not meet, so no list is read
    share = postings.skipped(table, F.when(F.col("term").isin("hot", "low"), F.col("term")), 2).first()
    assert 0 < share["read"] < share["lists"]


def test_a_lookup_reads_only_its_columns_and_terms(spark):
    table = postings.build(spark.createDataFrame(pairs_of(), PAIRS), ["term"], "p", 64)
    plan = table.where("term = 'low'").select("block", "n")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,low)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_the_text_index_is_contains(spark):
    r = random.Random(2)
    texts = [None, "", "a", "É", "ab", "İx", "The cat", "😀😀b", "straße STRASSE", "x" * 500, "tab\tand\nline"] + ["".join(r.choice("abAB é") for _ in range(r.randrange(30))) for _ in range(150)]
    rows = [("one", i, t) for i, t in enumerate(texts)] + [("two", i, "cat " + (t or "")) for i, t in enumerate(texts[:20])]
    df = spark.createDataFrame(rows, "field string, id long, text string")
    df = df.unionByName(spark.createDataFrame([("one", 5, "second text of five: aab"), ("one", 6, "aba"), ("one", 6, "aba")], df.schema))
    index = postings.TextIndex(df, 32, 64)
    low = [tuple(r) for r in df.select("field", "id", F.lower("text")).collect()]
    for field, needles in [("one", ["ab"]), ("one", ["AbA"]), ("one", ["é"]), ("one", ["aba", " b"]), ("two", ["cat "]), ("one", ["xxxx"]), ("one", ["straSSe"]), ("one", ["😀b"]), ("one", ["nowhere"]), ("one", ["bab", "aab"]), ("one", ["a"]), ("one", ["a", "b"]), ("one", ["e", "aab"])]:
        want = sorted({i for f, i, t in low if f == field and t is not None and all(n.lower() in t for n in needles)})
        assert sorted(x["id"] for x in index.search(field, *needles).collect()) == want, needles
    some = index.candidates("one", "aba").count()
    assert some < len(texts) / 2  # texts that the index leaves to be read
    empty = postings.TextIndex(df.limit(0))
    assert empty.search("one", "abc").count() == empty.search("one", "a").count() == 0


def test_facets_beside_filters(spark):
    r = random.Random(3)
    rows = [(f, f"{f}{r.randrange(4)}", i) for i in range(0, 120_000, 97) for f in "abc" for _ in range(r.randrange(3))] + [(None, "x", 1), ("a", None, 2), ("d", "d0", 5), ("a", "a9", None)]
    maps = facets.bitmaps(spark.createDataFrame([*rows, *rows[:100]], "facet string, value string, id long"))
    held = {}
    for f, v, i in rows:
        if None not in (f, v, i):
            held.setdefault((f, v), set()).add(i)
    for chosen in ({}, {"a": ["a1", "a2"]}, {"a": ["a0"], "b": ["b1", "b3"], "c": ["c2"]}, {"a": ["none"], "b": ["b1"]}):
        want = {}
        for (f, v), ids in held.items():
            for g, values in chosen.items():
                if g != f:
                    ids = ids & set().union(*(held.get((g, x), set()) for x in values))
            want[f, v] = len(ids)
        assert {(x["facet"], x["value"]): x["packs"] for x in facets.counts(maps, chosen).collect()} == want


def test_changes_over_gaps(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    days = {0: 5.0, 1: 1.0, 8: 2.0, 9: 4.0, 40: 1.5}
    df = spark.createDataFrame([(1, day(n), v) for n, v in days.items()] + [(2, day(3), 7.0)], "user_id long, ts timestamp, value double")
    got = {(r["user_id"], (r["day"] - datetime.date(2024, 1, 1)).days): (r["change_7"], r["change_30"]) for r in trend.changes(df, [7, 30]).collect()}
    total = lambda n: sum(v for d, v in days.items() if d <= n)
    want = {(1, n): tuple(total(n) - total(n - p) if n - p >= 0 else None for p in (7, 30)) for n in days} | {(2, 3): (None, None)}
    assert got == want


def test_positions_where_half_of_the_rows_tie(spark):
    r = random.Random(9)
    rows = [(i, 5.0 if i % 2 else r.choice([None, r.random() * 10, 3.0, -1.5])) for i in range(3000)]
    r.shuffle(rows)
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    want = {i: n for n, (i, _) in enumerate(order, 1)}
    df = spark.createDataFrame(rows, "k long, x double")
    for parts in (2, 16):
        assert {x["k"]: x["position"] for x in trend.ranked(df, "x", "k", parts).collect()} == want
    named = df.withColumn("k", F.format_string("%06d", "k"))
    assert {int(x["k"]): x["position"] for x in trend.ranked(named, "x", "k").collect()} == want
    assert trend.ranked(df.limit(0), "x", "k").count() == 0
    same = trend.ranked(df.withColumn("x", F.lit(1.0)), "x", "k", 8)
    assert {x["k"]: x["position"] for x in same.collect()} == {i: i + 1 for i in range(3000)}


def test_lists_go_over_batches():
    import pyarrow as pa

    from lodestack.functions import lists

    r = random.Random(4)
    rows = sorted({(r.choice("abc"), r.randrange(3), r.randrange(64)) for _ in range(300)} | {("hot", 0, i) for i in range(64)})
    rows = sorted([*rows, *rows[::5]])
    want = {}
    for term, block, i in rows:
        want.setdefault((term, block), []).append(i) if i not in want.get((term, block), []) else None
    table = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int32())], ["term", "block", "id"])
    for size in (1, 2, 7, 50, 1000):
        out = [x for b in lists.of_pairs([table.slice(i, size) for i in range(0, len(table), size)] + [table.slice(0, 0)]) for x in b.to_pylist()]
        assert [((x["term"], x["block"]), x["ids"]) for x in out] == list(want.items()), size
    assert list(lists.of_pairs([])) == []


def test_grams_of_many_texts_at_once():
    import numpy as np
    import pyarrow as pa

    from lodestack.functions import lists

    r = random.Random(5)
    many = "".join(map(chr, range(0xE000, 0x110000)))  # with others too many different characters for one key, so taken in halves
    texts = ["", "a", "ab", "abc", "a\0b", "\0", "😀é😀é", "abab" * 9, *("".join(r.choice("ab\0é") for _ in range(r.randrange(9))) for _ in range(60))]
    ids = [r.randrange(-20, 20) for _ in texts]
    want = {}
    for i, t in zip(ids, texts):
        for g in {t[k : k + 3] for k in range(len(t) - 2)} or {t}:
            want.setdefault((g, i // 8), set()).add(i % 8)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(ids)), pa.array(ids, pa.int64()), pa.array(texts)], ["field", "id", "text"])
    for batches in ([batch], [batch.slice(i, 3) for i in range(0, len(batch), 3)]):
        for together in (1, 50, 1 << 22):
            got = {}
            for b in lists.of_grams(batches, 8, together):
                for x in b.to_pylist():
                    assert x["field"] == "f" and x["ids"] == sorted(set(x["ids"]))
                    got.setdefault((x["gram"], x["block"]), set()).update(x["ids"])
            assert got == want
    assert len(list(lists.of_texts(np.array([1, 2]), ["abc", "abd"], 8))) == 1
    halves = list(lists.of_texts(np.array([1, 2]), [many, "abc" + many[:2]], 8))
    assert [len(b) for b in halves] == [len(many) - 2, 3]


def test_rows_are_dealt_once(spark):
    """Posting lists are made where their pairs were dealt to, with neither a second exchange nor Spark's sets, which took most of the time of an index."""
    import re

    held, plans = spark.createDataFrame(pairs_of(), PAIRS), []
    real = postings._written
    postings._written = lambda lists, *rest: plans.append(lists._jdf.queryExecution().executedPlan().toString()) or real(lists, *rest)
    try:
        postings.build(held, ["term"], "p", 64)
        postings.TextIndex(spark.createDataFrame([("f", 1, "abc"), ("f", 2, "xabc")], "field string, id long, text string"), 64)
    finally:
        postings._written = real
    assert len(plans) == 2
    for plan in plans:
        assert len(re.findall(r"Exchange rangepartitioning", plan)) == 1 == plan.count("Exchange ") and "Aggregate" not in plan
