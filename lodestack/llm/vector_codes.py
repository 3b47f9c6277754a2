"""Operator 11: vectors as short codes, by a codebook for each part of a vector (product quantisation), in whole numbers.

Each component x becomes floor(``scale`` * x), and a vector is cut into equal consecutive parts. The codebook of a part begins as that part of
the vectors of the smallest ids. Each round broadcasts a kd-tree per codebook; tasks assign every part to its nearest entry and add up
components and counts, one row for each part and entry; Spark sums these rows, and each entry becomes the floor of its mean. Entries that got nothing stay.
All is exact, so results do not depend on how rows are dealt.

A kd-tree keeps the box of each node's entries. A batch of parts goes down together: first into the nearer child, then into the other one wherever
its box is not farther than the best so far. Boxes at an equal distance are visited too, so the lower index wins a tie.

What is sent to tasks or the driver is bounded by entries x dimensions. The table is read once per round, once for the first entries and once for the codes.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, and so do those of another length than that of the smallest id;
a length that the parts do not divide is filled up with zeros; fewer vectors than entries: as many entries; null ids come last; rows alike in id are told apart by
their vectors for the first entries; repeated rows count each; components beyond 2 ** 20 (at a scale of 256) raise, since sums would not fit; an empty table gives an empty
result; other columns stay and ``code`` and ``error`` of the input are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .shared import ship, written

LEAF, LARGEST = 4, 2**28
NONE = np.iinfo(np.int64).max


class KdTree:
    """The entries of a codebook. Nodes are (low, high, left, right, members); inner ones have no members, leaves no children."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        at, low, high = len(self.nodes), self.entries[members].min(0), self.entries[members].max(0)
        self.nodes.append(())
        if len(members) <= LEAF:
            self.nodes[at] = (low, high, None, None, np.sort(members))
        else:
            ordered = members[np.argsort(self.entries[members, np.argmax(high - low)], kind="stable")]
            half = len(members) // 2
            self.nodes[at] = (low, high, self._grow(ordered[:half]), self._grow(ordered[half:]), None)
        return at

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        low, high = self.nodes[node][:2]
        return ((x - np.clip(x, low, high)) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each row's nearest entry, the lowest of equally near ones, and the squared distance."""
        index, best = np.zeros(len(x), np.int64), np.full(len(x), NONE)
        self._visit(0, x, np.arange(len(x)), index, best)
        return index, best

    def _visit(self, node: int, x: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        _, _, left, right, members = self.nodes[node]
        if members is not None:
            d = ((x[rows, None, :] - self.entries[members]) ** 2).sum(2)
            first = d.argmin(1)
            d, at = d[np.arange(len(rows)), first], members[first]
            take = (d < best[rows]) | ((d == best[rows]) & (at < index[rows]))
            index[rows[take]], best[rows[take]] = at[take], d[take]
            return
        to_left, to_right = self._bound(left, x[rows]), self._bound(right, x[rows])
        near = to_left <= to_right
        self._visit(left, x, rows[near], index, best)
        self._visit(right, x, rows[~near], index, best)
        self._visit(right, x, rows[near & (to_right <= best[rows])], index, best)
        self._visit(left, x, rows[~near & (to_left <= best[rows])], index, best)


class Codebooks:
    """``entries``: whole numbers [part, entry, component]; ``length``: of the vectors."""

    def __init__(self, entries: np.ndarray, length: int, scale: int):
        self.entries, self.length, self.scale = entries, length, scale

    def sha256(self) -> str:
        """Of all components as decimal numbers, by part, entry and place, joined by commas; lowercase hex."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(v: Column) -> Column:
    """Whether a vector takes part; never null."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good, F.lit(False))


def whole_parts(vectors: pa.Array, length: int, parts: int, scale: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, [row, part, component]."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    x = np.floor(scale * x)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST // scale}")
    return np.pad(x.astype(np.int64), ((0, 0), (0, -length % parts))).reshape(len(x), parts, -(-length // parts))


def _kept(df: DataFrame, embedding: str, length: int) -> DataFrame:
    return df.where(usable(F.col(embedding)) & (F.size(embedding) == length))


def train(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> Codebooks | None:
    """The codebooks after ``rounds`` rounds; None without a usable vector. ``entries``: 256 at most."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    by_id = [F.asc_nulls_last("id"), "v"]
    shortest = rows.where(usable(F.col("v"))).select("id", "v").orderBy(*by_id).limit(1).collect()
    if not shortest:
        return None
    length = len(shortest[0]["v"])
    rows = _kept(rows, "v", length)
    first = rows.orderBy(*by_id).limit(entries).select("v").toArrow().column(0).combine_chunks()  # at most ``entries`` rows
    books = np.ascontiguousarray(whole_parts(first, length, parts, scale).transpose(1, 0, 2))
    width = books.shape[2]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast([KdTree(b) for b in books])

        def sums(batches):
            total, count = np.zeros(books_shape, np.int64), np.zeros(books_shape[:2], np.int64)
            for b in batches:
                x = whole_parts(b.column(0), length, parts, scale)
                for p, tree in enumerate(sent.value):
                    at, _ = tree.nearest(x[:, p])
                    np.add.at(total[p], at, x[:, p])
                    count[p] += np.bincount(at, minlength=books_shape[1])
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["p", "e", "n", "s"])

        books_shape = books.shape
        got = rows.select("v").mapInArrow(sums, "p int, e int, n long, s array<long>").groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
        for r in got.collect():  # at most parts x entries rows
            books[r["p"], r["e"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        sent.unpersist()
    return Codebooks(books, length, scale)


def encode(df: DataFrame, books: Codebooks, embedding: str = "embedding") -> DataFrame:
    """The rows of ``df`` that take part, with ``code`` (the entry of each part, two hex digits each) and ``error`` (squared distances summed)."""
    ship(df.sparkSession)
    df = _kept(df.drop(*[c for c in df.columns if c.lower() in ("code", "error") and c != embedding]), embedding, books.length)
    at, names = df.columns.index(embedding), [*df.columns, "code", "error"]
    sent = df.sparkSession.sparkContext.broadcast([KdTree(b) for b in books.entries])
    length, parts, scale = books.length, len(books.entries), books.scale

    def run(batches):
        for b in batches:
            x = whole_parts(b.column(at), length, parts, scale)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, tree in enumerate(sent.value):
                code[:, p], d = tree.nearest(x[:, p])
                error += d
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names)

    return df.mapInArrow(run, StructType(list(df.schema)).add("code", "string").add("error", "long"))


def decode(df: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """Adds ``decoded`` (array<double>): the entries of a code over the scale, a half added for what the floors took; null for a null code."""
    ship(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() == "decoded" and c != code])
    at, names = df.columns.index(code), [*df.columns, "decoded"]
    sent = df.sparkSession.sparkContext.broadcast(books.entries)
    length, scale = books.length, books.scale

    def run(batches):
        entries = sent.value
        for b in batches:
            out = [None if c is None else ((entries[np.arange(len(entries)), list(bytes.fromhex(c))].ravel()[:length] + 0.5) / scale).tolist() for c in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names)

    return df.mapInArrow(run, StructType(list(df.schema)).add("decoded", ArrayType(DoubleType())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_vector_codes."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = train(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(encode(vectors, books).drop("embedding"), "codes")
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """Assignments to the codebooks c{n}, and, of the means, the codebooks c{n + 1}."""
    d = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 5))
    means = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
    return f"""
a{n} AS MATERIALIZED (SELECT vec_id, label, part, any_value(x) AS x, min(({d}) * 64 + entry) AS best FROM p JOIN c{n} USING (part) GROUP BY vec_id, label, part),
c{n + 1} AS MATERIALIZED (SELECT c{n}.part, c{n}.entry, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN
  (SELECT part, best % 64 AS entry, [{means}] AS c FROM a{n} GROUP BY 1, 2) m ON m.part = c{n}.part AND m.entry = c{n}.entry)"""


#: For unique ids and vectors of 64 components.
SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(v, part * 4 + 1, part * 4 + 4) AS x FROM kept, range(16) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_round(0)},{_round(1)},{_round(2)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, books"""
