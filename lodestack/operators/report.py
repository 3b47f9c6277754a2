"""The offline report: one HTML page, and data parts beside it that it links and loads on demand.

Parts hold ranges of keys and are cut by a number of rows. A zone index, which is in the page, says for each part its file, rows, smallest and largest key and which terms
(values of one column with few of them) it holds, so the page opens only the parts that a key or a term may be in. A part is a script with a call per row, since pages
opened from a folder may load scripts but not read files. All links are relative: the folder can be moved as a whole.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a part at most.
PART_ROWS = 5000
#: Terms that the index keeps of a part at most; a part with more counts as holding any.
MOST_TERMS = 200

_SCRIPT = """
const seen = new Set(), rows = [];
function row(r) { rows.push(r); }
function load(file) {
  if (seen.has(file)) return Promise.resolve();
  seen.add(file);
  return new Promise((done, failed) => {
    const s = document.createElement("script");
    s.src = file; s.onload = done; s.onerror = failed;
    document.head.append(s);
  });
}
async function find() {
  const key = document.getElementById("key").value, term = document.getElementById("term").value;
  const asked = zones.filter(z => (key === "" || (z.first <= +key && +key <= z.last)) && (term === "" || z.terms === null || z.terms.includes(term)));
  for (const z of asked) await load(z.file);
  const hits = rows.filter(r => (key === "" || r[keyName] == key) && (term === "" || r[termName] == term)).slice(0, 200);
  document.getElementById("hits").textContent = hits.map(r => JSON.stringify(r)).join("\\n");
}
"""


def bucketed(items: DataFrame, key: str, buckets: int) -> DataFrame:
    return items.withColumn("bucket", F.pmod(F.col(key), F.lit(buckets)))


def write_parts(items: DataFrame, path: str) -> None:
    """A folder per bucket under ``path``; a large bucket is several files, by Spark's advisory size of a partition."""
    items.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def manifest(items: DataFrame) -> DataFrame:
    """(part, rows): relative paths only, so the folder can be moved as a whole."""
    return items.groupBy("bucket").agg(F.count("*").alias("rows")).select(F.concat(F.lit("data/bucket="), F.col("bucket").cast("string")).alias("part"), "rows")


def _put(spark: SparkSession, path: str, text: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_bundle(items: DataFrame, path: str, title: str, key: str, buckets: int) -> DataFrame:
    """Writes data parts by bucket under ``path``/data and, behind them, ``path``/index.html, which links their files by relative paths; returns the manifest.

    The page is bounded by the number of files; no row passes the driver."""
    spark = items.sparkSession
    write_parts(bucketed(items, key, buckets), f"{path}/data")
    back = spark.read.schema(StructType(list(items.schema)).add("bucket", "long")).json(f"{path}/data")
    part = F.concat(F.lit("data/bucket="), F.col("bucket").cast("string")).alias("part")
    files = back.groupBy("bucket", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows")).select(part, "file", "rows").cache()
    linked = files.select("part", "rows", F.concat_ws("/", "part", "file").alias("link")).orderBy("part", "link")
    _put(spark, f"{path}/index.html", page(title, linked, max(buckets, files.count()), link="link"))
    return files.groupBy("part").agg(F.sum("rows").alias("rows"))


def write_board(items: DataFrame, path: str, title: str, key: str, term: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Writes ``path``/data, parts by ranges of ``key`` of at most ``part_rows`` rows, and ``path``/index.html with their zone index, which finds rows by key or by ``term``.

    Returns the index: (file, rows, first, last, terms). Rows go to their parts by ranges sampled by Spark, so a part is a task's output or a piece of it; rows without a key come first."""
    spark = items.sparkSession
    lines = items.select(key, *([term] if term and term != key else []), F.concat(F.lit("row("), F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"}), F.lit(");")).alias("value"))
    ordered = lines.repartitionByRange(F.asc_nulls_first(key), F.xxhash64("value")).sortWithinPartitions(F.asc_nulls_first(key))
    ordered.select("value").write.mode("overwrite").option("maxRecordsPerFile", part_rows).text(f"{path}/data")
    inside = F.expr("substring(value, 5, length(value) - 6)")
    wanted = StructType([f for f in items.schema if f.name in (key, term)])
    back = spark.read.text(f"{path}/data").select("_metadata.file_name", F.from_json(inside, wanted).alias("r"))
    terms = F.collect_set(F.col(f"r.{term}").cast("string")) if term else F.array().cast("array<string>")
    zones = back.groupBy("file_name").agg(F.count("*").alias("rows"), F.min(f"r.{key}").alias("first"), F.max(f"r.{key}").alias("last"), terms.alias("terms"))
    zones = zones.select(F.concat(F.lit("data/"), "file_name").alias("file"), "rows", "first", "last", F.when(F.size("terms") <= MOST_TERMS, F.array_sort("terms")).alias("terms")).orderBy("first", "file").cache()
    index = [r.asDict() for r in zones.collect()]  # a row per part
    links = "".join(f'<li><a href="{html.escape(z["file"])}">{html.escape(str(z["first"]))} to {html.escape(str(z["last"]))}</a>, {z["rows"]} rows</li>' for z in index)
    known = json.dumps({"zones": index, "key": key, "term": term}, default=str, ensure_ascii=False).replace("<", "\\u003c")
    form = f'<p>{html.escape(key)} <input id=key> {html.escape(term or "")} <input id=term{"" if term else " hidden"}> <button onclick="find()">Find</button></p><pre id=hits></pre>'
    script = f"<script>const board = {known}, zones = board.zones, keyName = board.key, termName = board.term;{_SCRIPT}</script>"
    _put(spark, f"{path}/index.html", f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{form}<ul>{links}</ul>{script}")
    return zones


def page(title: str, rows: DataFrame, most: int = 1000, link: str | None = None) -> str:
    """A page with a table of the first ``most`` rows (a top list); it says so if there are more. ``link``: a column with the target of the row's first cell."""
    shown = [c for c in rows.columns if c != link]
    head = "".join(f"<th>{html.escape(c)}</th>" for c in shown)
    first = rows.limit(most + 1).collect()

    def cell(r, c):
        text = html.escape(str(r[c]))
        return f'<td><a href="{html.escape(r[link])}">{text}</a></td>' if link and c == shown[0] else f"<td>{text}</td>"

    body = "".join("<tr>" + "".join(cell(r, c) for c in shown) + "</tr>" for r in first[:most])
    more = f"<p>The first {most} rows.</p>" if len(first) > most else ""
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>{more}"
