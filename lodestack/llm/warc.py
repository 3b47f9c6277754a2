"""Operator 9: WARC archives with an index written first, read back by coalesced byte ranges.

Each task writes one archive, every record a gzip member of its own, and returns the index rows: file, offset, length, URL, digest. Spark
writes those rows as a table; only files that the table names are ever read, so what a lost executor left is not. Readers select from
the index, sort by file and offset, join neighbouring ranges to one read, and parse the records.

Of records with equal payloads the one with the largest id is the response and the others are revisits of it. The payloads
are grouped by SHA-1, SHA-256 prefix and length; rows are counted before the shuffle, so one very common payload is one row per task.

Cases: a null payload counts as empty; null URLs are left out of the record; control characters in URLs are percent-encoded in the archive; a null id
gives a record without a number in its id, and it is a revisit wherever an equal payload has an id; rows that
share the response's id are responses too; payloads under ``least`` bytes are all responses; an empty table writes no archive; other columns are not
written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import located, opened_for_reading, opened_for_writing
from .shared import parallelism, scratch, ship, written

INDEX = "path string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Fixed values of the format.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: A reader joins ranges with at most GAP bytes between them into reads of at most READ bytes; a task's share of a file is CHUNK bytes.
GAP, READ, CHUNK = 64 << 10, 8 << 20, 32 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One gzip member that holds one record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none-' + uuid.uuid4().hex if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    name = (urn or "")[10:-1]
    return int(name) if re.fullmatch(r"-?\d+", name) else None


def classified(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """(page_id, url, html, response_id): ``response_id`` is the id of the record with the same payload that is the response."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = rows.withColumns({"_d": F.concat(F.sha1("html"), F.substring(F.sha2("html", 256), 1, 16)), "_n": F.octet_length("html")})
    # which record is the response is told by ids and digests alone, however many pages share a payload; pages then meet their verdict by id
    narrow = written(keyed.select("page_id", "_d", "_n"), "warc-digests")
    best = narrow.groupBy("_d", "_n").agg(F.max("page_id").alias("_best"))
    verdict = narrow.distinct().join(best, ["_d", "_n"]).select(F.col("page_id").alias("_p"), F.col("_d").alias("_e"), F.when(F.col("_n") >= least, F.col("_best")).otherwise(F.col("page_id")).alias("response_id"))
    out = keyed.join(verdict, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("_d") == F.col("_e")))
    return out.select("page_id", "url", "html", "response_id")


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the archives and returns their index as a written table."""
    spark = pages.sparkSession
    ship(spark)
    folder = located(spark, folder or scratch(spark, "warc"))

    def run(batches):
        out, at, path = None, 0, None
        for b in batches:
            rows = []
            for page, target, text, response in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out = opened_for_writing(path)
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    at = len(info)
                payload = text.encode()
                digest, kind = digest_of(payload), "response" if page == response else "revisit"
                shown = None if target is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", target)
                headers = [("WARC-Record-ID", record_id(page)), ("WARC-Target-URI", shown), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
                if kind == "revisit":
                    headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(response))]
                headers.append(("Content-Type", "application/http; msgtype=response"))
                head = HTTP % len(payload)
                member = record(kind, headers, head + payload if kind == "response" else head)
                out.write(member)
                rows.append((path, at, len(member), target, digest, kind))
                at += len(member)
            if rows:
                yield _batch(rows, _INDEX)
        if out is not None:
            out.close()

    return written(classified(pages, page_id, url, html, least).mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` (any selection of the written index) names, from the archives; payloads are checked against their digests."""
    spark = index.sparkSession
    ship(spark)

    def run(batches):
        path, f = None, None
        for b in batches:
            for name, members in _ranges(zip(*(c.to_pylist() for c in b.columns))):
                if name != path:
                    path, f = name, opened_for_reading(name)[0]
                begin = members[0][0]
                f.seek(begin)
                data = f.read(members[-1][0] + members[-1][1] - begin)
                yield _batch([_row(data[o - begin : o - begin + n], payloads) for o, n in members], _RECORD)

    chunk = F.floor(F.col("offset") / CHUNK)
    selected = index.select("path", "offset", "length").repartition(parallelism(spark), "path", chunk).sortWithinPartitions("path", "offset")
    return selected.mapInArrow(run, RECORD)


def _ranges(rows):
    """(path, [(offset, length)]) of each read."""
    path, members, size = None, [], 0
    for p, o, n in rows:
        if members and (p != path or o - (members[-1][0] + members[-1][1]) > GAP or o + n - members[0][0] > READ):
            yield path, members
            members = []
        path = p
        members.append((o, n))
    if members:
        yield path, members


def _row(member: bytes, payloads: bool) -> tuple:
    headers, block = parsed(member)
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    n, payload = int(headers["X-Payload-Length"]), None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest_of(payload) != digest or len(payload) != n:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    return page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, page_of(headers.get("WARC-Refers-To")), digest, n, payload if payloads else None


_INDEX = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())]
_RECORD = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_warc."""
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
