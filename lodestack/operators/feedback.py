"""Feedback requests: routing, validation, daily limits, forwarding and mail rows.

Order of checks: OPTIONS, other methods, the daily limit, the JSON, the content. Only valid requests count towards the limit, so a request is
limited exactly if as many valid ones as the limit stand before it in its (ip, UTC day) bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import web
from lodestack.functions.web import or_default

#: Requests per day, longest content, defaults of the mail text.
DAILY, LONGEST = 10, 4000
NO_TYPE, NO_CONTACT, NO_IP = "其他", "未提供", "未知"
SUBJECT, VERSION, TYPE, CONTACT, IP = "[整合包工具反馈] ", "版本: ", "\n类型: ", "\n联系方式: ", "\nIP: "


def derived(events: DataFrame) -> DataFrame:
    """Requests made from events: errors are GET, sign-ups under 20 have an invalid content."""
    bad = (F.col("event_type") == "signup") & (F.col("value") < 20)
    return events.select(
        F.col("event_id").alias("id"), "ts", F.concat(F.lit("ip"), (F.col("user_id") % 10).cast("string")).alias("ip"),
        F.when(F.col("event_type") == "error", "GET").otherwise("POST").alias("method"), (~bad).alias("valid"), "event_type", "value",
    )


def route(requests: DataFrame) -> DataFrame:
    """Adds ``client`` and ``routed`` (status by method, null: go on)."""
    status = F.when(F.col("method") == "OPTIONS", 200).when(F.col("method") != "POST", 405)
    return requests.withColumns({"client": or_default(F.col("ip"), "unknown"), "routed": status})


def limited(requests: DataFrame, daily: int = DAILY) -> DataFrame:
    """Adds ``status``: 405, 429, 400 or 200.

    What stands behind the last request that a client's day accepts is limited. That request is one row per client and day, found by a rank that tasks cut at
    ``daily`` before the shuffle, so a client with a third of all requests is no large group; the requests themselves only look it up."""
    routed = route(requests)
    day, moment = F.to_date("ts"), F.struct("ts", "id")
    counted = routed.where(F.col("routed").isNull() & F.col("valid")).select("client", day.alias("_day"), "ts", "id")
    rank = F.row_number().over(Window.partitionBy("client", "_day").orderBy("ts", "id"))
    last = counted.withColumn("_rank", rank).where(F.col("_rank") == daily).select(F.col("client").alias("_client"), "_day", moment.alias("_last"))
    met = routed.join(last, (F.col("client") == F.col("_client")) & day.eqNullSafe(F.col("_day")), "left")
    full = F.coalesce(moment > F.col("_last"), F.lit(False)) if daily > 0 else F.lit(True)
    return met.withColumn("status", F.coalesce("routed", F.when(full, 429).when(~F.col("valid"), 400).otherwise(200))).drop("_client", "_day", "_last")


def validated(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``status``: 400 for a body that is no JSON or has no content or too long a one, 500 for a JSON null, else 200.

    Told by Spark's JSON reader, within its limits: numbers of over 1,000 digits and values nested over 1,000 deep count as no JSON, a content with
    repeated keys inside as none. Arrays in the content's array count with their JSON text. No body fails the job."""
    read = web.read_object(F.col(body).cast("string"), "content variant")
    content = F.get(read, F.lit(0))["content"]
    length = F.coalesce(web.utf16_length(web.trimmed(web.shown(content))), F.lit(0))
    good = web.truthy(content) & (length <= LONGEST)
    return bodies.withColumn("status", F.when(read.isNull(), 400).when(F.get(read, F.lit(0)).isNull(), 500).when(good, 200).otherwise(400))


def limit_key(client: Column, ts: Column) -> Column:
    """The key under which a client's requests of a UTC day are counted."""
    return F.format_string("feedback:%s:%s", or_default(client, "unknown"), F.to_date(ts).cast("string"))


def received(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``data``, the relayed body as a variant: an empty one is an empty object; bad JSON raises, and so does anything behind a value.

    Repeated keys raise too, unless ``spark.sql.variant.allowDuplicateKeys`` is set, as it should be to keep the last of them as the relay does."""
    text = F.coalesce(F.nullif(F.col(body), F.lit("")), F.lit("{}"))
    values = F.parse_json(F.concat(F.lit("["), text, F.lit(",0]")))  # read with a 0 behind it, so that anything else behind its value shows
    alone = F.coalesce(F.try_variant_get(values, "$[1]", "int") == 0, F.lit(False)) & F.try_variant_get(values, "$[2]", "variant").isNull()
    return bodies.withColumn("data", F.when(alone, F.variant_get(values, "$[0]", "variant")).otherwise(F.raise_error(F.lit("not one JSON value")).cast("variant")))


def answered(rows: DataFrame, upstream_ok: str, reply: str) -> DataFrame:
    """Adds ``status`` from the upstream's own status and the text of its reply: 200 if both are well, 500 for a JSON null, else 502. Bad JSON counts as not ok."""
    read = web.read_object(F.col(reply), "ok variant")
    good = F.coalesce(F.col(upstream_ok), F.lit(False)) & web.truthy(F.get(read, F.lit(0))["ok"])
    return rows.withColumn("status", F.when(read.isNull(), 502).when(F.get(read, F.lit(0)).isNull(), 500).when(good, 200).otherwise(502))


def forwarded(accepted: DataFrame, secret: Column, payload: dict[str, Column]) -> DataFrame:
    """Adds ``forward``: the payload as JSON, with our secret and ip in place of the client's."""
    fields = {k: v for k, v in payload.items() if k not in ("secret", "ip")} | {"secret": secret, "ip": F.col("client")}
    return accepted.withColumn("forward", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}))


def reply_status(upstream_ok: Column, result_ok: Column) -> Column:
    return F.when(F.coalesce(upstream_ok & result_ok, F.lit(False)), 200).otherwise(502)


def mail_rows(payloads: DataFrame, secret: str, to: str) -> DataFrame:
    """(id, ok, to, subject, body): mail of the payloads that hold the secret; ``type``, ``version``, ``contact``, ``ip``, ``content`` are columns."""
    ok = F.coalesce((F.lit(secret) != "") & (F.col("secret") == secret), F.lit(False))
    shown = lambda c: F.coalesce(F.col(c), F.lit("undefined"))
    subject = F.concat(F.lit(SUBJECT), or_default(F.col("type"), NO_TYPE))
    body = F.concat(
        F.lit(VERSION), shown("version"), F.lit(TYPE), shown("type"), F.lit(CONTACT), or_default(F.col("contact"), NO_CONTACT),
        F.lit(IP), or_default(F.col("ip"), NO_IP), F.lit("\n\n"), shown("content"),
    )
    return payloads.select("id", ok.alias("ok"), F.when(ok, F.lit(to)).alias("to"), F.when(ok, subject).alias("subject"), F.when(ok, body).alias("body"))
