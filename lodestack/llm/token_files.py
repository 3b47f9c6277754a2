"""Operator 7: token ids in Simple-8b files.

Documents are dealt by ranges of their id, each task sorts its range and writes files of at most about ``FILE_IDS`` ids or ``FILE_DOCS`` documents, named for
that attempt alone; a table written by Spark lists the files of the attempts that count, so a lost executor or a repeated task
leaves nothing behind that is read. A file holds Simple-8b blocks of 1024 ids, then each block's first word, then the documents' ids and lengths, then a
fixed trailer, which tells how many of the documents, the first ones, have a null id. Readers take a run of blocks at a time; the bound on a file bounds its footer.

Cases: a null or empty text is its end id alone; null ids come first; rows that share an id stand in the order of their
texts' hashes, and rows alike in both in any order; very long documents span blocks and reads; an empty table writes no files and
reads as no rows; other columns are not written.
"""

from __future__ import annotations

import struct
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks, simple8b
from .files import located, opened_for_reading, opened_for_writing
from .shared import parallelism, scratch, ship, written

#: Fixed values of the file format: magic at both ends; trailer of ids, blocks, documents, those of them with a null id, block size and the footer's place.
MAGIC = b"S8BTOK02"
TRAILER = struct.Struct("<QQQQQQ8s")

FLUSH = 512 * simple8b.BLOCK
#: A file ends behind the document with which it has so many ids or documents.
FILE_IDS, FILE_DOCS = 64 << 20, 1 << 20
MANIFEST = "part int, file int, path string, n_docs long, n_ids long"


class TokenFileWriter:
    def __init__(self, out, file_ids: int | None = None, file_docs: int | None = None):
        self._most = file_ids or FILE_IDS, file_docs or FILE_DOCS
        self._out, self._rest, self._words, self.n_ids = out, [], 0, 0
        self._waiting = 0
        self._offsets: list[np.ndarray] = []
        self.doc_ids, self._lengths, self._without_id = array("q"), array("q"), 0
        out.write(MAGIC)

    @property
    def full(self) -> bool:
        return self.n_ids + self._waiting >= self._most[0] or len(self.doc_ids) >= self._most[1]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Documents with a null id come before all others."""
        if doc_id is None and self._without_id < len(self.doc_ids):
            raise ValueError("a null id behind others")
        self._without_id += doc_id is None
        self.doc_ids.append(doc_id or 0)
        self._lengths.append(len(ids) // 4)
        self._rest.append(ids)
        self._waiting += len(ids) // 4
        if self._waiting >= FLUSH:
            self._flush(self._waiting // simple8b.BLOCK * simple8b.BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self._rest), "<u4")
        for i in range(0, n, FLUSH):
            words, offsets = simple8b.encode(ids[i : min(i + FLUSH, n)])
            self._out.write(words.astype("<u8").tobytes())
            self._offsets.append(offsets[:-1] + self._words)
            self._words += len(words)
        self.n_ids += n
        self._rest, self._waiting = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        self._flush(self._waiting)
        offsets = np.concatenate([*self._offsets, [self._words]])
        for a in (offsets, self.doc_ids, self._lengths):
            self._out.write(np.asarray(a, "<i8").tobytes())
        self._out.write(TRAILER.pack(self.n_ids, len(offsets) - 1, len(self.doc_ids), self._without_id, simple8b.BLOCK, len(MAGIC) + 8 * self._words, MAGIC))


def read_documents(f, size: int):
    """(doc_id, ids) of each document of a token file, in order; ``f`` is open for random reads."""
    f.seek(size - TRAILER.size)
    n_ids, n_blocks, n_docs, without_id, block, footer, magic = TRAILER.unpack(f.read(TRAILER.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    f.seek(footer)
    index = np.frombuffer(f.read(8 * (n_blocks + 1 + 2 * n_docs)), "<i8")
    offsets, doc_ids, lengths = np.split(index, [n_blocks + 1, n_blocks + 1 + n_docs])
    block_at, have, held = 0, 0, []
    for i, (doc_id, length) in enumerate(zip(doc_ids, lengths)):
        while have < length:
            to = min(block_at + FLUSH // block, n_blocks)
            f.seek(len(MAGIC) + 8 * int(offsets[block_at]))
            words = np.frombuffer(f.read(8 * int(offsets[to] - offsets[block_at])), "<u8")
            n = min(to * block, n_ids) - block_at * block
            held.append(simple8b.decode(words, offsets[block_at : to + 1] - offsets[block_at], n, block).astype("<u4"))
            have, block_at = have + n, to
        if len(held) > 1:
            held = [np.concatenate(held)]
        yield None if i < without_id else int(doc_id), held[0][:length].tobytes() if held else b""
        if held:
            held, have = [held[0][length:]], have - length


def write(docs: DataFrame, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes the files and returns their table (part, file, path, n_docs, n_ids); ``path`` a byte-level vocabulary. A task begins another file behind the document with which one
    has ``file_ids`` ids or ``file_docs`` documents."""
    spark = docs.sparkSession
    ship(spark)
    folder = located(spark, folder or scratch(spark, "token-files"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, writer, out, name, file = chunks.byte_level(path), None, None, None, 0

        def closed():
            writer.close()
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([name]), pa.array([len(writer.doc_ids)]), pa.array([writer.n_ids])], ["part", "file", "path", "n_docs", "n_ids"]
            )

        for b in chunks.parts(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in chunks.slices(texts):
                for d, x in zip(ids[i:j], encoder.encode(texts[i:j])):
                    if writer is None:
                        part = TaskContext.get().partitionId()
                        name = f"{folder}/part-{part:06d}-{file:06d}-{uuid.uuid4().hex}.s8b"
                        out = opened_for_writing(name)
                        writer = TokenFileWriter(out, file_ids, file_docs)
                    writer.add(d, x + end)
                    if writer.full:
                        yield closed()
                        writer, file = None, file + 1
        if writer is not None:
            yield closed()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # without a number the parts follow the data's size; joined ones stay in order
    ordered = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    return written(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) from the files; ``start`` counts the ids of all documents before."""
    ship(manifest.sparkSession)
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "start")

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f, size = opened_for_reading(path)
                rows, held = [], 0
                for doc_id, ids in read_documents(f, size):
                    rows.append((doc_id, start, ids))
                    start += len(ids) // 4
                    held += len(ids)
                    if held >= 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                f.close()
                if rows:
                    yield _batch(rows)

    spread = files.repartition(parallelism(manifest.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    d, s, i = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.binary())], ["doc_id", "start", "ids"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_token_files."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, P.path("byte_bpe_50k.json"))).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
