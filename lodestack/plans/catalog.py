"""The registered catalog queries and their SQL.

Stand-ins: pack = orders, mod = part, bridge = distinct (l_orderkey, l_partkey), category = o_orderpriority, mod type = p_type,
mod tag = p_brand, description = documents.text, comments = conversations, trend = events. Parameters have
fixed defaults so that the SQL can repeat them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.web import number_or_zero
from lodestack.operators import comments, facets, feedback, postings, refresh, report, search, trend
from lodestack.sources import pages
from lodestack.sources.tables import append_history, compact_history, kept, read_history, read_jsonl, shared_path, write_snapshot
from lodestack.sources.tables import table as t
from lodestack.streaming.limits import LimitedRequests
from lodestack.streaming.refresh import DailyCounts, RefreshedSnapshot
from lodestack.streaming.runs import arrived

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF, ORDERS_AS_OF, DAYS = "2024-01-30", "2001-08-01", 7
TAGS = ["Brand#1", "Brand#2"]
URGENT = "1-URGENT"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: The pages' character references are these four, their links all begin at the host's root, and their comments and scripts end.
_SEEN = r"""regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(script|style)[^<>]*>.*?</(script|style)>', '<!>', 'g')"""
_LINK = r"""<a\s[^<>]*href="([^"]*)"[^<>]*>([^<>]*)"""


def _decoded(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query(
    "q01_page_extract",
    rf"""WITH seen AS (SELECT page_id, url, {_SEEN} AS h FROM pages),
    runs AS (SELECT page_id, sum(length(trim({_decoded("run")}, ' ' || chr(9) || chr(10) || chr(12) || chr(13)))) AS n
        FROM (SELECT page_id, unnest(regexp_split_to_array(regexp_replace(h, '(?is)<title>.*?</title>', '<!>', 'g'), '<[A-Za-z/!?][^<>]*>')) AS run FROM seen) GROUP BY page_id)
    SELECT page_id, url, nullif({_decoded("regexp_extract(h, '(?is)<title>(.*?)</title>', 1)")}, '') AS title, nullif({_decoded("trim(regexp_replace(regexp_extract(h, '(?is)<h1>(.*?)</h1>', 1), '<[A-Za-z/!?][^<>]*>', '', 'g'))")}, '') AS heading,
    nullif(regexp_extract(h, '<html lang="([a-z]+)"', 1), '') AS page_lang, CAST(len(regexp_extract_all(h, '{_LINK}')) AS INT) AS n_links, CAST(n AS INT) AS text_length FROM seen JOIN runs USING (page_id)""",
)
def q01(s: SparkSession, d: str) -> DataFrame:
    return pages.extract(t(s, d, "pages"), fields=("title", "heading", "page_lang", "n_links", "text_length"))


_LINKS = rf"""SELECT page_id, url, CAST(i - 1 AS INT) AS position, {_decoded(f"regexp_extract(a, '{_LINK}', 1)")} AS href, {_decoded(f"regexp_extract(a, '{_LINK}', 2)")} AS anchor
    FROM (SELECT page_id, url, unnest(found) AS a, generate_subscripts(found, 1) AS i FROM (SELECT page_id, url, regexp_extract_all({_SEEN}, '{_LINK}') AS found FROM pages))"""


@query("q01_page_links", f"SELECT page_id, url, position, href, nullif(trim(anchor), '') AS anchor, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS target FROM ({_LINKS})")
def q01_links(s, d):
    return pages.links(t(s, d, "pages"))


@query(
    "q01_page_frontier",
    f"""SELECT target, count(DISTINCT page_id) AS n_pages, min(page_id) AS first_page FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS target FROM ({_LINKS})) AS found
    WHERE NOT EXISTS (SELECT 1 FROM pages WHERE regexp_replace(pages.url, '#.*$', '') = found.target) GROUP BY target""",
)
def q01_frontier(s, d):
    return pages.frontier(t(s, d, "pages"), "page_id")


@query("q02_stale_items", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 365 DAY")
def q02(s, d):
    return refresh.stale(t(s, d, "orders"), "o_orderdate", ORDERS_AS_OF, 365).select("o_orderkey", "o_orderpriority")


@query("q02_full_refresh", "SELECT o_orderkey, o_orderpriority FROM orders")
def q02_full(s, d):
    return refresh.stale(t(s, d, "orders"), "o_orderdate", ORDERS_AS_OF, None).select("o_orderkey", "o_orderpriority")


@query("q03_snapshot_upsert", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q03(s, d):
    e = t(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    return refresh.upsert(e.where(F.col("ts") < middle), e.where(F.col("ts") >= middle), "user_id", ["ts", "event_id"]).drop("ts")


@query("q04_pack_detail", "SELECT doc_id, text, lang, source FROM documents WHERE doc_id = 42")
def q04(s, d):
    return t(s, d, "documents").where("doc_id = 42").select("doc_id", "text", "lang", "source")


@query("q05_search_name", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_name), 'small')")
def q05(s, d):
    return t(s, d, "part").where(search.matches(F.col("p_name"), "Ring", "small")).select("p_partkey", "p_name")


@query("q06_search_description", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'ention')")
def q06(s, d):
    return t(s, d, "documents").where(search.matches(F.col("text"), "ention")).select("doc_id", "lang")


@query("q07_search_comments", "SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'the')")
def q07(s, d):
    return t(s, d, "conversations").where(search.matches(F.col("text"), "the")).select("conv_id").distinct()


@query("q08_search_tags", "SELECT DISTINCT l_orderkey AS pack_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_brand), 'brand#1')")
def q08(s, d):
    return search.packs_with(t(s, d, "lineitem"), t(s, d, "part"), search.matches(F.col("p_brand"), "brand#1"))


@query("q09_search_mods", "SELECT DISTINCT l_orderkey AS pack_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'widget')")
def q09(s, d):
    return search.packs_with(t(s, d, "lineitem"), t(s, d, "part"), search.matches(F.col("p_name"), "widget"))


@query("q10_search_any_field", """
WITH hits AS (
  SELECT o_orderkey AS pack_id, 'category' AS field FROM orders WHERE contains(lower(o_orderpriority), 'medium')
  UNION SELECT l_orderkey, 'mods' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'medium')
  UNION SELECT l_orderkey, 'tags' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_brand), 'medium')
  UNION SELECT l_orderkey, 'types' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_type), 'medium'))
SELECT pack_id, string_agg(field, ',' ORDER BY field) AS fields FROM hits GROUP BY pack_id""")
def q10(s, d):
    l, p = t(s, d, "lineitem"), t(s, d, "part")
    category = t(s, d, "orders").where(search.matches(F.col("o_orderpriority"), "medium")).select(F.col("o_orderkey").alias("pack_id"))
    of_parts = {field: search.matches(F.col(c), "medium") for field, c in (("mods", "p_name"), ("tags", "p_brand"), ("types", "p_type"))}
    return search.any_field({"category": category}, search.packs_by_field(l, p, of_parts))


@query("q10_search_five_fields", """
WITH hits AS (
  SELECT o_orderkey AS pack_id, 'name' AS field FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '11')
  UNION SELECT doc_id, 'description' FROM documents WHERE contains(lower(text), '11')
  UNION SELECT conv_id, 'comments' FROM conversations WHERE contains(lower(text), '11')
  UNION SELECT l_orderkey, 'tags' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_brand), '11')
  UNION SELECT l_orderkey, 'mods' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), '11'))
SELECT pack_id, string_agg(field, ',' ORDER BY field) AS fields FROM hits GROUP BY pack_id""")
def q10_five(s, d):
    """A pack is named by its customer here; documents and conversations of its number are its description and comments."""
    l, p, has = t(s, d, "lineitem"), t(s, d, "part"), lambda c: search.matches(F.col(c), "11")
    named = t(s, d, "customer").where(has("c_name")).select(F.col("c_custkey").alias("o_custkey"))
    name = t(s, d, "orders").select(F.col("o_orderkey").alias("pack_id"), "o_custkey").join(named, "o_custkey", "left_semi")
    described = t(s, d, "documents").where(has("text")).select(F.col("doc_id").alias("pack_id"))
    comments = t(s, d, "conversations").where(has("text")).select(F.col("conv_id").alias("pack_id"))
    of_parts = search.packs_by_field(l, p, {"tags": has("p_brand"), "mods": has("p_name")})
    return search.any_field({"name": name, "description": described, "comments": comments}, of_parts)


@query("q11_filter_category", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q11(s, d):
    return t(s, d, "orders").where(F.col("o_orderpriority").isin(URGENT, "2-HIGH")).select("o_orderkey", "o_totalprice")


@query("q12_filter_tags_any", "SELECT DISTINCT l_orderkey AS pack_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2')")
def q12(s, d):
    return search.packs_with(t(s, d, "lineitem"), t(s, d, "part"), F.col("p_brand").isin(TAGS))


@query("q12_filter_tags_all", "SELECT l_orderkey AS pack_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY 1 HAVING count(DISTINCT p_brand) = 2")
def q12_all(s, d):
    return search.packs_with_all(t(s, d, "lineitem"), t(s, d, "part"), "p_brand", TAGS)


@query("q13_filter_mod_type", "SELECT DISTINCT l_orderkey AS pack_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO'")
def q13(s, d):
    return search.packs_with(t(s, d, "lineitem"), t(s, d, "part"), F.col("p_type") == "PROMO")


@query("q14_filter_mod_any", "SELECT DISTINCT l_orderkey AS pack_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey IN (1, 2, 3)")
def q14(s, d):
    return search.packs_with(t(s, d, "lineitem"), t(s, d, "part"), F.col("p_partkey").isin(1, 2, 3))


@query("q15_filter_mod_all", "SELECT l_orderkey AS pack_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name IN ('small ring', 'red widget') GROUP BY 1 HAVING count(DISTINCT p_name) = 2")
def q15(s, d):
    return search.packs_with_all(t(s, d, "lineitem"), t(s, d, "part"), "p_name", ["small ring", "red widget"])


@query("q16_filter_combined", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01'
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO')
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'ring'))
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5'))
  AND o_custkey IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1 HAVING sum(CAST(value AS DECIMAL(18,2))) > 10)""")
def q16(s, d):
    """All facets at once; that of the trend period is what a pack's customer gained in it."""
    l, p = t(s, d, "lineitem"), t(s, d, "part")
    o = t(s, d, "orders").where((F.col("o_orderpriority") == URGENT) & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")))
    gained = trend.period(t(s, d, "events"), "2024-01-10", "2024-01-20").where("gained > 10").select(F.col("user_id").alias("o_custkey"))
    o = o.join(gained, "o_custkey", "left_semi").select("o_orderkey", "o_orderpriority")
    for condition in (F.col("p_type") == "PROMO", search.matches(F.col("p_name"), "ring"), F.col("p_brand").isin([f"Brand#{i}" for i in range(1, 6)])):
        o = o.join(search.packs_with(l, p, condition).withColumnRenamed("pack_id", "o_orderkey"), "o_orderkey", "left_semi")
    return o


@query("q17_comment_digest", "SELECT conv_id, count(*) AS comments, count(DISTINCT role) AS authors, max(turn) AS latest, sum(length(text)) / count(*) AS mean_length FROM conversations GROUP BY conv_id")
def q17(s, d):
    length = F.sum(F.length("text")).cast("double") / F.count("*")
    return t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("comments"), F.count_distinct("role").alias("authors"), F.max("turn").alias("latest"), length.alias("mean_length"))


@query("q17_comments_in_order", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, role, text FROM conversations")
def q17_ordered(s, d):
    return t(s, d, "conversations").select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("seq"), "role", "text")


@query("q18_reverse_search", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 1)")
def q18(s, d):
    packs = t(s, d, "lineitem").where("l_partkey = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(s, d, "orders").select("o_orderkey", "o_orderpriority").join(packs, "o_orderkey", "left_semi")


@query("q19_mod_index", "SELECT p_partkey AS mod_id, p_name, count(DISTINCT l_orderkey) AS packs FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2")
def q19(s, d):
    counted = search.bridge(t(s, d, "lineitem")).groupBy("mod_id").agg(F.count("*").alias("packs"))
    return t(s, d, "part").select(F.col("p_partkey").alias("mod_id"), "p_name").join(counted, "mod_id", "left").withColumn("packs", F.coalesce("packs", F.lit(0).cast("long")))


_DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2"


@query("q20_trend_series", f"""
WITH d AS ({_DAILY})
SELECT user_id, day, CAST(v AS DOUBLE) AS value, CAST(lag(v) OVER w AS DOUBLE) AS previous, CAST(sum(v) OVER w AS DOUBLE) AS running
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def q20(s, d):
    return trend.series(t(s, d, "events"))


@query("q21_trend_leaderboard", f"""
WITH d AS ({_DAILY}), x AS (
  SELECT user_id, sum(v) AS now, sum(v) FILTER (day <= DATE '2024-01-23') AS base FROM d WHERE day <= DATE '2024-01-30' GROUP BY 1)
SELECT user_id, CAST(now AS DOUBLE) AS now, CAST(now - base AS DOUBLE) AS trend FROM x ORDER BY trend DESC NULLS LAST, user_id LIMIT 10""")
def q21(s, d):
    return trend.leaderboard(t(s, d, "events"), AS_OF, DAYS, 10)


@query("q21_trend_change", f"""
WITH d AS ({_DAILY}), x AS (
  SELECT user_id, sum(v) AS now, sum(v) FILTER (day <= DATE '2024-01-23') AS base FROM d WHERE day <= DATE '2024-01-30' GROUP BY 1)
SELECT user_id, CAST(now AS DOUBLE) AS now, CAST(now - base AS DOUBLE) AS trend FROM x""")
def q21_change(s, d):
    return trend.change(t(s, d, "events"), AS_OF, DAYS)


_MEASURES = "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type IN ('click', 'signup', 'purchase')) AS activity FROM events GROUP BY 1"


def measures(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(F.count_if(kind == "view").alias("views"), F.count_if(kind.isin("click", "signup", "purchase")).alias("activity"))


@query("q22_composite_rank", f"""
WITH m AS ({_MEASURES}), s AS (
  SELECT user_id, CAST(round(CAST(0.6 * coalesce(ln(1 + views) / nullif(max(ln(1 + views)) OVER (), 0), 0) + 0.4 * coalesce(ln(1 + activity) / nullif(max(ln(1 + activity)) OVER (), 0), 0) AS DECIMAL(20,10)), 6) AS DOUBLE) AS score FROM m)
SELECT user_id, score, row_number() OVER (ORDER BY score DESC, user_id) AS position FROM s""")
def q22(s, d):
    return trend.composite(measures(t(s, d, "events")), "user_id", {"views": 0.6, "activity": 0.4})


@query("q23_views_and_activity", _MEASURES)
def q23(s, d):
    return measures(t(s, d, "events"))


@query("q23_ranked_by_views", f"SELECT user_id, views, row_number() OVER (ORDER BY views DESC, user_id) AS position FROM ({_MEASURES})")
def q23_views(s, d):
    return trend.ranked(measures(t(s, d, "events")).select("user_id", "views"), "views", "user_id")


@query("q23_ranked_by_activity", f"SELECT user_id, activity, row_number() OVER (ORDER BY activity DESC, user_id) AS position FROM ({_MEASURES})")
def q23_activity(s, d):
    return trend.ranked(measures(t(s, d, "events")).select("user_id", "activity"), "activity", "user_id")


@query("q24_facet_counts", "SELECT o_orderpriority AS facet, count(*) AS packs FROM orders GROUP BY 1")
def q24(s, d):
    return t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("facet")).agg(F.count("*").alias("packs"))


@query("q25_packs_without_mod", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q25(s, d):
    return t(s, d, "orders").select("o_orderkey").join(t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("q26_compare_packs", """
SELECT event_type AS metric, count(*) FILTER (user_id = 1) AS pack_1, count(*) FILTER (user_id = 2) AS pack_2, count(*) FILTER (user_id = 3) AS pack_3
FROM events WHERE user_id IN (1, 2, 3) GROUP BY 1""")
def q26(s, d):
    chosen = t(s, d, "events").where(F.col("user_id").isin(1, 2, 3))
    wide = chosen.groupBy(F.col("event_type").alias("metric")).pivot("user_id", [1, 2, 3]).count().na.fill(0)
    return wide.select("metric", *[F.col(str(i)).alias(f"pack_{i}") for i in (1, 2, 3)])


@query("q27_dashboard_manifest", "SELECT 'data/bucket=' || (doc_id % 16) AS part, count(*) AS rows FROM documents GROUP BY 1")
def q27(s, d):
    return report.manifest(report.bucketed(t(s, d, "documents"), "doc_id", 16))


@query("q28_data_parts_by_bucket", "SELECT doc_id % 16 AS bucket, doc_id, lang, source FROM documents")
def q28(s, d):
    return report.bucketed(t(s, d, "documents"), "doc_id", 16).select("bucket", "doc_id", "lang", "source")


_REQUESTS = """SELECT event_id AS id, ts, 'ip' || (user_id % 10) AS client, CASE WHEN event_type = 'error' THEN 'GET' ELSE 'POST' END AS method,
  NOT (event_type = 'signup' AND value < 20) AS valid, event_type, value FROM events"""
_STATUS = f"""SELECT *, CASE WHEN method <> 'POST' THEN 405
    WHEN coalesce(sum(CASE WHEN method = 'POST' AND valid THEN 1 ELSE 0 END) OVER (PARTITION BY client, CAST(ts AS DATE) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 10 THEN 429
    WHEN NOT valid THEN 400 ELSE 200 END AS status FROM ({_REQUESTS})"""


@query("q29_snapshot_bundle", "SELECT 'data/bucket=' || (o_orderkey % 16) AS part, count(*) AS rows FROM orders GROUP BY 1")
def q29(s, d):
    """Orders as a written JSON snapshot, read back by its schema, and the page with its data parts made of it."""
    orders, path = t(s, d, "orders"), shared_path(s, "bundle")
    write_snapshot(orders, f"{path}/snapshot")
    snapshot = read_jsonl(s, f"{path}/snapshot", orders.schema).drop("_corrupt_record")
    return report.write_bundle(snapshot, f"{path}/page", "Packs", "o_orderkey", 16)


@query("q29_history", f"SELECT user_id, day, CAST(v AS DOUBLE) AS value FROM ({_DAILY})")
def q29_history(s, d):
    """The trend history through its written table: each day's values are appended, the newest version of a day counts."""
    path = shared_path(s, "history")
    days = trend.daily(t(s, d, "events")).select("user_id", "day", F.col("v").cast("double").alias("value"))
    append_history(days.select("*", F.lit(1).alias("version")).withColumn("value", F.lit(0.0)), path, "day")
    append_history(days.select("*", F.lit(2).alias("version")), path, "day")
    return read_history(s, path, "user_id", "day").select("user_id", "day", "value")


@query("q30_feedback_route", f"SELECT id, client, method, CASE WHEN method <> 'POST' THEN 405 END AS routed FROM ({_REQUESTS})")
def q30(s, d):
    return feedback.route(feedback.derived(t(s, d, "events"))).select("id", "client", "method", "routed")


@query("q31_feedback_rate_limit", f"SELECT id, client, status FROM ({_STATUS})")
def q31(s, d):
    return feedback.limited(feedback.derived(t(s, d, "events"))).select("id", "client", "status")


@query("q31_feedback_limit_key", f"SELECT id, 'feedback:' || client || ':' || CAST(ts AS DATE) AS key FROM ({_REQUESTS})")
def q31_key(s, d):
    return feedback.derived(t(s, d, "events")).select("id", feedback.limit_key(F.col("ip"), F.col("ts")).alias("key"))


@query("q31_feedback_state_value", "SELECT event_id, CASE event_type WHEN 'view' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS used FROM events")
def q31_state(s, d):
    """What a stored count reads as: its number, and 0 for a missing, an empty or a broken one."""
    stored = F.when(F.col("event_type") == "view", F.floor("value").cast("string")).when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "error", "")
    return t(s, d, "events").select("event_id", number_or_zero(stored).alias("used"))


@query("q32_feedback_validate", "SELECT event_id, CAST(CASE event_type WHEN 'error' THEN 400 WHEN 'purchase' THEN 500 WHEN 'signup' THEN 200 WHEN 'click' THEN 200 ELSE 200 END AS INTEGER) AS status FROM events")
def q32(s, d):
    """Bodies made of the events' props: without a content, a JSON null, an array, a repeated key, and a text as content."""
    kind, props = F.col("event_type"), F.col("props")
    body = (
        F.when(kind == "error", props).when(kind == "purchase", F.lit("\nnull")).when(kind == "signup", F.concat(F.lit('{"content":['), props, F.lit(",null,1.5]}")))
        .when(kind == "click", F.concat(F.lit('{"content":"","content":'), props, F.lit("}"))).otherwise(F.to_json(F.struct(props.alias("content"))))
    )
    return feedback.validated(t(s, d, "events").select("event_id", body.alias("body"))).select("event_id", "status")


@query("q32_feedback_received", "SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS k FROM events")
def q32_received(s, d):
    """The relayed body, here the events' props; an empty or a missing one is an empty object."""
    body = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "click", F.col("props"))
    return feedback.received(t(s, d, "events").select("event_id", body.alias("body"))).select("event_id", F.variant_get("data", "$.k", "bigint").alias("k"))


@query("q33_feedback_forward", f"""
SELECT id, '{{"content":"' || event_type || '","type":null,"secret":"s3","ip":"' || client || '"}}' AS forward,
  CASE WHEN event_type <> 'click' AND value >= 50 THEN 200 ELSE 502 END AS status
FROM ({_STATUS}) WHERE status = 200""")
def q33(s, d):
    """Upstream is taken to answer unless the event is a click, with ok from 50 on."""
    ok = feedback.limited(feedback.derived(t(s, d, "events"))).where("status = 200")
    sent = feedback.forwarded(ok, F.lit("s3"), {"content": F.col("event_type"), "type": F.lit(None).cast("string"), "secret": F.lit("client's"), "ip": F.lit("client's")})
    return sent.select("id", "forward", feedback.reply_status(F.col("event_type") != "click", F.col("value") >= 50).alias("status"))


@query("q33_feedback_replies", "SELECT event_id, CAST(CASE WHEN event_type IN ('view', 'signup') THEN 502 WHEN event_type = 'purchase' THEN 500 WHEN value >= 50 THEN 200 ELSE 502 END AS INTEGER) AS status FROM events")
def q33_replies(s, d):
    """Upstream replies made of the events: broken JSON, no ok, a JSON null, and an ok of the value's truth from 50 on."""
    kind = F.col("event_type")
    reply = F.when(kind == "view", "{").when(kind == "signup", F.col("props")).when(kind == "purchase", "null").otherwise(F.concat(F.lit('{"ok":'), F.when(F.col("value") >= 50, "[]").otherwise("0"), F.lit("}")))
    return feedback.answered(t(s, d, "events").select("event_id", F.lit(True).alias("up"), reply.alias("reply")), "up", "reply").select("event_id", "status")


@query("q34_feedback_mail_rows", f"""
SELECT id, event_type <> 'click' AS ok, CASE WHEN event_type <> 'click' THEN 'box' END AS "to",
  CASE WHEN event_type <> 'click' THEN '[整合包工具反馈] ' || CASE WHEN event_type = 'view' THEN '其他' ELSE event_type END END AS subject,
  CASE WHEN event_type <> 'click' THEN '版本: undefined' || chr(10) || '类型: ' || CASE WHEN event_type = 'view' THEN 'undefined' ELSE event_type END || chr(10)
    || '联系方式: 未提供' || chr(10) || 'IP: ' || client || chr(10) || chr(10) || event_type END AS body
FROM ({_STATUS}) WHERE status = 200""")
def q34(s, d):
    ok = feedback.limited(feedback.derived(t(s, d, "events"))).where("status = 200")
    payload = ok.select("id", F.when(F.col("event_type") != "click", "s3").alias("secret"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("type"),
        F.lit(None).cast("string").alias("version"), F.lit("").alias("contact"), F.col("client").alias("ip"), F.col("event_type").alias("content"))
    return feedback.mail_rows(payload, "s3", "box")


def in_two_deliveries(s: SparkSession, d: str, first: Column, files_per_batch: int):
    """The stream of a folder of events, twice: when the events of ``first`` were delivered, and when the others were too. A day's events of a delivery are in one file."""
    events, path = t(s, d, "events"), shared_path(s, "arrivals")
    for part in (first, ~F.coalesce(first, F.lit(False))):
        events.where(part).repartition(4, F.to_date("ts")).write.mode("append").parquet(path)
        yield arrived(s, path, events.schema, files_per_batch)


@query("q35_feedback_stream_daily", f"""
SELECT client, CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN method = 'POST' AND valid THEN 1 ELSE 0 END) AS BIGINT) AS valid,
  CAST(least(sum(CASE WHEN method = 'POST' AND valid THEN 1 ELSE 0 END), 10) AS BIGINT) AS accepted FROM ({_REQUESTS}) GROUP BY 1, 2""")
def q35(s, d):
    """The first half of the days in one run, the second in the next."""
    counts = DailyCounts(s, shared_path(s, "daily-counts"))
    for stream in in_two_deliveries(s, d, F.to_date("ts") < F.to_date(F.lit("2024-01-16")), 4):
        counts.run(feedback.derived(stream))
    return counts.read()


@query("q36_refresh_available_now", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q36(s, d):
    """Users' newest events in a kept snapshot, refreshed by a second run, which reads the second delivery alone."""
    events = t(s, d, "events")
    kept = RefreshedSnapshot(s, shared_path(s, "refreshed"), events.schema, "user_id", ["ts", "event_id"])
    for stream in in_two_deliveries(s, d, F.hour("ts") < 12, 2):
        kept.run(stream)
    return kept.snapshot.read().select("user_id", "event_id", "event_type")


@query("q37_feedback_stream_decisions", f"SELECT id, client, status FROM ({_STATUS})")
def q37(s, d):
    """The mornings of all days in one run, the afternoons in the next, which goes on with the counts of the first."""
    decided = LimitedRequests(s, shared_path(s, "decided"))
    for stream in in_two_deliveries(s, d, F.hour("ts") < 12, 2):
        decided.run(feedback.derived(stream))
    return decided.decisions.read().select("id", "client", "status")


@query("q38_postings_any", "SELECT DISTINCT l_orderkey AS pack_id FROM lineitem WHERE l_partkey IN (1, 2, 3)")
def q38_any(s, d):
    return postings.any_of(postings.by_mod(t(s, d, "lineitem")), F.col("mod_id").isin(1, 2, 3)).select(F.col("id").alias("pack_id"))


@query("q38_postings_all", "SELECT l_orderkey AS pack_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name IN ('small ring', 'red widget') GROUP BY 1 HAVING count(DISTINCT p_name) = 2")
def q38_all(s, d):
    """Packs with a mod of each of two names, by the mods' posting lists."""
    named = t(s, d, "part").where(F.col("p_name").isin("small ring", "red widget")).select(F.col("p_partkey").alias("mod_id"), "p_name")
    lists = postings.by_mod(t(s, d, "lineitem")).join(named, "mod_id")
    return postings.all_of(lists, F.col("p_name"), 2).select(F.col("id").alias("pack_id"))


@query("q38_postings_reverse", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 1)")
def q38_reverse(s, d):
    packs = postings.any_of(postings.by_mod(t(s, d, "lineitem")), F.col("mod_id") == 1)
    return t(s, d, "orders").select("o_orderkey", "o_orderpriority").join(packs.withColumnRenamed("id", "o_orderkey"), "o_orderkey", "left_semi")


@query("q38_postings_table", "SELECT l_partkey AS mod_id, l_orderkey // 4096 AS block, min(l_orderkey) AS first, max(l_orderkey) AS last, CAST(count(DISTINCT l_orderkey) AS INTEGER) AS n FROM lineitem GROUP BY 1, 2")
def q38_table(s, d):
    return postings.by_mod(t(s, d, "lineitem")).drop("ids")


@query("q39_indexed_search", """
SELECT 'name' AS search, p_partkey AS id FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_name), 'small')
UNION ALL SELECT 'description', doc_id FROM documents WHERE contains(lower(text), 'ention')
UNION ALL SELECT DISTINCT 'comments', conv_id FROM conversations WHERE contains(lower(text), 'the')
UNION ALL SELECT DISTINCT 'tags', l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_brand), 'brand#1')
UNION ALL SELECT DISTINCT 'mods', l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'widget')
UNION ALL SELECT 'short', doc_id FROM documents WHERE contains(lower(text), '11')""")
def q39(s, d):
    """The searches of q05 to q09, and one by two characters, by an index of all five fields; mods and tags lead to packs by the mods' posting lists."""
    part, said = t(s, d, "part"), t(s, d, "conversations")
    text = lambda df, field, key, column: df.select(F.lit(field).alias("field"), F.col(key).alias("id"), F.col(column).alias("text"))
    fields = [text(part, "name", "p_partkey", "p_name"), text(t(s, d, "documents"), "description", "doc_id", "text"), text(said, "comments", "conv_id", "text"), text(part, "tags", "p_partkey", "p_brand")]
    index = postings.TextIndex(reduce(DataFrame.unionByName, fields))
    packs = postings.by_mod(t(s, d, "lineitem"))
    of_mods = lambda mods: postings.ids(packs.join(mods.withColumnRenamed("id", "mod_id"), "mod_id", "left_semi").drop("mod_id")).distinct()
    found = {
        "name": index.search("name", "Ring", "small"), "description": index.search("description", "ention"),
        "comments": index.search("comments", "the"),
        "tags": of_mods(index.search("tags", "brand#1")), "mods": of_mods(index.search("name", "widget")), "short": index.search("description", "11"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("search"), "id") for k, df in found.items()])


_CHOSEN = {"category": [URGENT, "2-HIGH"], "tag": TAGS, "type": ["PROMO"], "year": ["1996", "1997"]}


@query("q40_facet_counts_beside_filters", f"""
WITH v AS (SELECT o_orderkey AS pack, 'category' AS facet, o_orderpriority AS value FROM orders
  UNION SELECT o_orderkey, 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders
  UNION SELECT l_orderkey, 'tag', p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT l_orderkey, 'type', p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
ok AS (SELECT pack, count(DISTINCT facet) AS n, bool_or(facet = 'category') AS category, bool_or(facet = 'tag') AS tag, bool_or(facet = 'type') AS type, bool_or(facet = 'year') AS year
  FROM v WHERE {' OR '.join(f"facet = '{f}' AND value IN ({', '.join(repr(x) for x in xs)})" for f, xs in _CHOSEN.items())} GROUP BY 1)
SELECT facet, value, count(*) FILTER (coalesce(ok.n, 0) - CASE WHEN coalesce(CASE facet WHEN 'category' THEN category WHEN 'tag' THEN tag WHEN 'type' THEN type ELSE year END, false) THEN 1 ELSE 0 END = 3) AS packs
FROM v LEFT JOIN ok USING (pack) GROUP BY 1, 2""")
def q40(s, d):
    """Each of four facets counted under the filters of the other three."""
    orders, l, p = t(s, d, "orders"), t(s, d, "lineitem"), t(s, d, "part")
    mods = l.select("l_orderkey", "l_partkey").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    row = lambda df, facet, value, key: df.select(F.lit(facet).alias("facet"), value.cast("string").alias("value"), F.col(key).alias("id"))
    values = [row(orders, "category", F.col("o_orderpriority"), "o_orderkey"), row(orders, "year", F.year("o_orderdate"), "o_orderkey"), row(mods, "tag", F.col("p_brand"), "l_orderkey"), row(mods, "type", F.col("p_type"), "l_orderkey")]
    return facets.counts(kept(facets.bitmaps(reduce(DataFrame.unionByName, values)), "facets"), _CHOSEN)


@query("q41_trend_changes_daily", f"""
WITH d AS ({_DAILY}), c AS (SELECT user_id, day, v, sum(v) OVER (PARTITION BY user_id ORDER BY day) AS total FROM d)
SELECT user_id, day, CAST(v AS DOUBLE) AS value,
  CAST(total - last_value(total) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING) AS DOUBLE) AS change_7,
  CAST(total - last_value(total) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAY PRECEDING) AS DOUBLE) AS change_30
FROM c""")
def q41(s, d):
    return trend.changes(t(s, d, "events"), [7, 30])


@query("q42_board_parts", "SELECT doc_id, lang, source FROM documents")
def q42(s, d):
    """The rows of documents as a board's page loads them, read back from its parts."""
    path = shared_path(s, "board")
    docs = t(s, d, "documents").select("doc_id", "lang", "source")
    report.write_board(docs, path, "Documents", "doc_id", "lang")
    line = F.expr("substring(value, 5, length(value) - 6)")
    return s.read.text(f"{path}/data").select(F.from_json(line, docs.schema).alias("r")).select("r.*")


@query("q29_history_compacted", f"SELECT user_id, day, CAST(v AS DOUBLE) AS value FROM ({_DAILY})")
def q29_compacted(s, d):
    """The history of q29_history, folded after each append."""
    path = shared_path(s, "history")
    days = trend.daily(t(s, d, "events")).select("user_id", "day", F.col("v").cast("double").alias("value"))
    append_history(days.select("*", F.lit(1).alias("version")).withColumn("value", F.lit(0.0)), path, "day")
    append_history(days.select("*", F.lit(2).alias("version")), path, "day")
    compact_history(s, path, "user_id", "day")
    return s.read.parquet(path).select("user_id", "day", "value")


@query("q43_distinguishing_terms", """
WITH w AS (SELECT conv_id AS pack_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM conversations),
n AS (SELECT pack_id, term, CAST(count(*) AS DOUBLE) AS a FROM w GROUP BY 1, 2),
x AS (SELECT pack_id, term, a, sum(a) OVER (PARTITION BY pack_id) AS c, sum(a) OVER (PARTITION BY term) AS t, sum(a) OVER () AS total FROM n),
s AS (SELECT pack_id, term, CAST(a AS BIGINT) AS n,
  round(2 * (a * ln(a * total / (c * t)) + CASE WHEN t > a THEN (t - a) * ln((t - a) * total / ((total - c) * t)) ELSE 0 END), 6) AS score FROM x WHERE a * total > c * t)
SELECT pack_id, term, n, score, row_number() OVER (PARTITION BY pack_id ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 5""")
def q43(s, d):
    return comments.distinguishing_terms(t(s, d, "conversations"), "conv_id", "text", 5)
