"""Operator 3: best-fit packing of token sequences.

Best-fit decreasing over the whole corpus. Items of one length are alike, so the packing is decided on the counts
of each length, at most ``capacity`` numbers however large the corpus: longest first, each item goes to the open bin
with the least room that suffices, which a segment tree over the remaining capacities finds in logarithmic time; bins
with the same room are taken together. The outcome is a short table of steps ("items k0 to k1 of length l go q to a
bin, from bin b on, at this offset"). Items then get their number within their length and read their
place off the steps. Numbers come from counts per (length, salt) and a window inside each of those, so a length that a third of
all items have is dealt to many tasks. Only the table of counts and the steps, both bounded by the capacity, pass the driver.

Cases: a null or empty text still has its end id; longer documents are cut at the capacity, other ones never;
repeated rows are packed as often as they come (rows alike in every key may trade places); an empty table packs to an empty table;
a null ``doc_id`` is packed like any other; ``token_pieces`` carries no other columns along, ``pack`` carries all but those named
as the ones it adds.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .shared import parallelism, ship, written

STEP = "length long, k0 long, k1 long, bin0 long, per_bin long, at long"


class TightestRoom:
    """A segment tree over rooms 0 to ``most``: which of them some open bin has."""

    def __init__(self, most: int):
        self._n = 1 << most.bit_length()
        self._has = bytearray(2 * self._n)

    def put(self, room: int, there: bool) -> None:
        i = room + self._n
        self._has[i] = there
        while i > 1:
            i //= 2
            self._has[i] = self._has[2 * i] | self._has[2 * i + 1]

    def least(self, room: int) -> int | None:
        """The least room, of at least ``room``, that an open bin has."""
        i = room + self._n
        if self._has[i]:
            return room
        while i > 1:
            if not i & 1 and self._has[i + 1]:
                i += 1
                while i < self._n:
                    i = 2 * i if self._has[2 * i] else 2 * i + 1
                return i - self._n
            i //= 2
        return None


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, k0, k1, bin0, per_bin, at): item k of that length, k0 <= k < k1, goes to bin
    bin0 + (k - k0) // per_bin, at + (k - k0) % per_bin * length ids from its begin."""
    tree, open_bins, steps, bins = TightestRoom(capacity), defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        k, n = 0, counts[length]
        while k < n:
            room = tree.least(length)
            if room is None:
                room, first, many = capacity, bins, -(-(n - k) // (capacity // length))
                bins += many
            else:
                first, many = open_bins[room].pop()
                if not open_bins[room]:
                    tree.put(room, False)
            each = room // length
            full, rest = divmod(min(n - k, many * each), each)
            used = full + (rest > 0)
            steps.append((length, k, k + full * each + rest, first, each, capacity - room))
            k += full * each + rest
            for b, c, left in ((first, full, room - each * length), (first + full, int(rest > 0), room - rest * length), (first + used, many - used, room)):
                if c and left:
                    open_bins[left].append((b, c))
                    tree.put(left, True)
    return steps


def pack(items: DataFrame, capacity: int, length: str = "length", keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``items``, whose ``length`` is from 1 to ``capacity``; columns of these names are replaced.

    ``items`` is read twice: give a written table. ``keys`` order items of one length.
    """
    spark = items.sparkSession
    if taken := [c for c in (length, *keys) if c.lower() in ("sequence_id", "offset")]:
        raise ValueError(f"{taken} would be replaced")
    items = items.drop(*[c for c in items.columns if c.lower() in ("sequence_id", "offset")])
    salts = 4 * parallelism(spark)
    salted = items.withColumn("__pack_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")).withColumn("__pack_l", F.col(length).cast("long"))
    per_salt = salted.groupBy("__pack_l", "__pack_salt").agg(F.count("*").alias("__pack_n"))
    counts = {r[0]: r[1] for r in per_salt.groupBy("__pack_l").agg(F.sum("__pack_n").alias("__pack_n")).collect()}  # one row per length
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    steps = spark.createDataFrame(pack_counts(counts, capacity), STEP)
    begins = per_salt.withColumn(
        "__pack_first", F.sum("__pack_n").over(Window.partitionBy("__pack_l").orderBy("__pack_salt").rowsBetween(Window.unboundedPreceding, -1))
    ).select("__pack_l", "__pack_salt", F.coalesce("__pack_first", F.lit(0)).alias("__pack_first"))
    within = Window.partitionBy("__pack_l", "__pack_salt").orderBy(*keys)
    numbered = salted.withColumn("__pack_r", F.row_number().over(within) - 1).join(begins, ["__pack_l", "__pack_salt"]).withColumn("__pack_k", F.col("__pack_first") + F.col("__pack_r"))
    # the steps of a length are few, and all of them together bounded by the capacity
    by_length = steps.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("k0", "k1", "bin0", "per_bin", "at"))).alias("__pack_steps"))
    placed = numbered.join(F.broadcast(by_length.withColumnRenamed("length", "__pack_l")), "__pack_l").withColumn(
        "__pack_s", F.filter("__pack_steps", lambda s: (s["k0"] <= F.col("__pack_k")) & (F.col("__pack_k") < s["k1"]))[0]
    )
    k = F.col("__pack_k") - F.col("__pack_s.k0")
    return placed.withColumns({
        "sequence_id": F.col("__pack_s.bin0") + F.floor(k / F.col("__pack_s.per_bin")).cast("long"),
        "offset": F.col("__pack_s.at") + k % F.col("__pack_s.per_bin") * F.col("__pack_l"),
    }).select(*items.columns, "sequence_id", "offset")


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the end id, in pieces of at most ``capacity``.

    ``ids`` is binary, little-endian unsigned 32-bit; ``path`` a vocabulary with word ends.
    """
    spark = docs.sparkSession
    ship(spark)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encoder = chunks.word_end(path)
        for b in chunks.parts(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in chunks.slices(texts):
                rows = [
                    (d, k // capacity, k, min(capacity, len(x) // 4 - k), x[4 * k : 4 * (k + capacity)])
                    for d, x in zip(ids[i:j], (e + end for e in encoder.encode(texts[i:j])))
                    for k in range(0, len(x) // 4, capacity)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_best_fit_packing."""
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = 2048) -> DataFrame:
    import public_tokenizers as P

    pieces = token_pieces(docs, P.path("word_bpe_49k.json"), capacity)
    pieces = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(pieces, capacity, keys=("doc_id", "piece", "ids_crc32"))
