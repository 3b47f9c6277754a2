"""Operator 10: approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample (``sample_rows``): each node parts its sample at the median of a projection on the difference of
two of its vectors. Their depth follows the number of rows, so that a leaf holds about ``LEAF`` of them, up to ``DEEPEST`` levels (beyond, leaves grow). Every
row is indexed: it goes down every tree to one leaf. A query searches all trees through one priority queue: a side of a node costs the
negative logarithm of the chance that a neighbour is there, given the query's projection, and leaves are taken, the likeliest first, until they hold the query's
budget of rows (a row counts once per tree that it is met in).

The budget is measured, not set: up to ``TRIALS`` of the queries are compared with all rows, and it becomes the least that meets a share ``recall`` of their true
neighbours. So it is small where vectors cluster and large where they lie without structure, at every size of the table. The same trial gives the
neighbours' distribution that the costs need.

Leaves are searched in blocks of about ``BLOCK`` rows with a common ancestor: a row is sent once per tree, a query once per block with the list of its leaves. Blocks with
too many rows or queries are dealt into parts. A query carries a floor, the ``k + 1``-th of its scores with those rows of the sample (a share ``FLOOR_SHARE`` of all rows at most) that its leaves hold; what lies below it
cannot be an answer and is not sent on. Scores are summed in double precision, component by component, on the original vectors.

For nearness by inner product the rows are lifted by one component that makes all norms equal, so that the trees, which part by direction, fit it.
Copies of a vector are one class; each class keeps its ``k + 1`` smallest ids, enough for any answer, so a vector that a third of all
rows share costs no more than others; queries with one vector share one search.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, and so do those of another length than most have; null ids
take no part; ties go to the smaller id; fewer than ``k`` candidates: all of them, if the search met them; rows alike in id and vector
count once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .shared import parallelism, ship, written

SAMPLE_ROWS, FLOOR_SHARE, TRIALS = 20_000, 0.2, 64
LEAF, DEEPEST = 256, 11
BLOCK, QUERY_CHUNK = 4096, 4096


class Forest:
    """Trees of one depth, as arrays: node i of a tree has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        nodes = 2**depth - 1
        self.trees, self.depth = trees, depth
        self.normal = np.zeros((trees, nodes, sample.shape[1]))
        self.middle = np.zeros((trees, nodes))
        for t in range(trees):
            parts = {0: np.arange(len(sample))}
            for i in range(nodes):
                mine = parts.pop(i)
                if len(mine) > 1:
                    a, b = rng.choice(mine, 2, replace=False)
                    w = sample[a] - sample[b]
                    if not w.any():
                        w = rng.normal(size=sample.shape[1])
                    self.normal[t, i] = w / np.linalg.norm(w)
                    at = sample[mine] @ self.normal[t, i]
                    self.middle[t, i] = np.median(at)
                    right = at > self.middle[t, i]
                else:
                    self.normal[t, i] = rng.normal(size=sample.shape[1])
                    right = np.zeros(len(mine), bool)
                if 2 * i + 2 < nodes:
                    parts[2 * i + 1], parts[2 * i + 2] = mine[~right], mine[right]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            side = x @ self.normal[t].T > self.middle[t]
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (side[np.arange(len(x)), at] if side.shape[1] else 0)
            out[:, t] = at - (2**self.depth - 1)
        return out

    def costs(self, queries: np.ndarray, near: Neighbours) -> tuple[np.ndarray, np.ndarray]:
        """What the left and the right side of each node cost each query, [query, tree, node]."""
        at = np.einsum("qd,tnd->qtn", queries, self.normal, optimize=True)
        z = (near.share * at + self.normal @ near.drift - self.middle) / near.spread
        right = np.clip((1 + np.tanh(np.sqrt(2 / np.pi) * (z + 0.044715 * z**3))) / 2, 1e-9, 1 - 1e-9)  # the normal distribution function, nearly
        return -np.log1p(-right), -np.log(right)

    def leaf_costs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each leaf costs one query, [tree, leaf]; ``left`` and ``right`` as from ``costs``."""
        cost = np.zeros((self.trees, 1))
        for level in range(self.depth):
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            cost = np.stack([cost + left[:, nodes], cost + right[:, nodes]], -1).reshape(self.trees, -1)
        return cost

    def search(self, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees, until they hold ``enough`` rows; for one query."""
        queue, taken, rows, first = [(0.0, t, 0) for t in range(self.trees)], [], 0, 2**self.depth - 1
        while queue and rows < enough:
            cost, t, i = heapq.heappop(queue)
            if i < first:
                heapq.heappush(queue, (cost + left[t, i], t, 2 * i + 1))
                heapq.heappush(queue, (cost + right[t, i], t, 2 * i + 2))
            elif sizes[t, i - first]:
                taken.append((t, i - first))
                rows += int(sizes[t, i - first])
        return taken


class Neighbours:
    """Where neighbours lie: a neighbour is ``share`` times the query plus ``drift``, with a deviation of ``spread`` along any direction."""

    def __init__(self, queries: np.ndarray, found: np.ndarray):
        """``found``: a neighbour of the query in each row of ``queries``, lifted."""
        self.share = float(((queries * found).sum(1) / (queries * queries).sum(1)).mean())
        rest = found - self.share * queries
        self.drift = rest.mean(0)
        self.spread = max(float(np.sqrt(((rest - self.drift) ** 2).mean())), 1e-6 * float(np.abs(found).max()))


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def search(
    df: DataFrame, k: int, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding",
    trees: int = 8, recall: float = 0.95, least: int = 256, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found with the largest inner product for each row where ``is_query``."""
    spark = df.sparkSession
    ship(spark)
    dtype = np.float32 if df.schema[embedding].dataType.elementType == FloatType() else np.float64
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("v"))).withColumns({"n": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    dims = [r[0] for r in rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()]
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.col("n") == dims[0])
    # the smallest ids of each vector, and the vectors asked for
    alike = Window.partitionBy("h1", "h2").orderBy("id")
    index = rows.dropDuplicates(["id", "h1", "h2"]).withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k + 1).select("id", "v")
    index = written(index, "vectors")
    n, longest = index.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    sample = _matrix(index.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow().column(0))  # at most sample_rows rows
    depth = min(max(0, int(np.ceil(np.log2(n / LEAF)))), DEEPEST)
    forest = Forest(_lifted(sample, longest), trees, depth)
    some = sample[: max(1, int(FLOOR_SHARE * n))]
    sent = spark.sparkContext.broadcast((forest, some, forest.leaves(_lifted(some, longest))))

    def assign(batches):
        for b in batches:
            x = _matrix(b.column(1))
            leaves = sent.value[0].leaves(_lifted(x, longest))
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(x.astype(dtype)), pa.array(list(leaves), pa.list_(pa.int32()))], ["id", "x", "leaves"])

    placed = written(index.mapInArrow(assign, "id long, x binary, leaves array<int>"), "leaves")
    by_leaf = placed.select("id", "x", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, 2**depth), np.int64)
    for t, l, c in by_leaf.groupBy("tree", "leaf").count().collect():  # at most trees x 2 ** DEEPEST rows
        sizes[t, l] = c
    asked = written(rows.where("asked").groupBy("h1", "h2").agg(F.min("id").alias("q"), F.first("v").alias("v")), "queries")
    near, enough = _trial(asked, placed, forest, sizes, k, recall, longest, dtype)
    enough = max(enough, trees * least)
    shift = min(depth, max(0, int(np.log2(BLOCK * 2**depth / n))))  # so many levels above its leaves a block begins
    held = sizes.reshape(trees, -1, 2**shift).sum(-1)
    chunks = np.maximum(-(-held // BLOCK // 2), 1)  # of the rows of each block

    def probe(batches):
        forest, some, leaves_of = sent.value
        for b in batches:
            for s in range(0, len(b), 128):
                x = _matrix(b.column(1).slice(s, 128))
                scores = x @ some.T
                left, right = forest.costs(_lifted(x, None), near)
                out = []
                for i, q in enumerate(b.column(0).slice(s, 128).to_pylist()):
                    blocks: dict[tuple[int, int], list[int]] = {}
                    met = np.zeros(sizes.shape, bool)
                    for t, l in forest.search(left[i], right[i], sizes, enough):
                        blocks.setdefault((t, l >> shift), []).append(l)
                        met[t, l] = True
                    known = scores[i, met[np.arange(forest.trees), leaves_of].any(1)]
                    floor = float(np.partition(known, -(k + 1))[-(k + 1)]) if len(known) > k else -np.inf
                    floor -= 1e-9 * max(1, abs(floor)) if np.isfinite(floor) else 0
                    out += [(q, floor, t, g, c, leaves) for (t, g), leaves in blocks.items() for c in range(chunks[t, g])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _PROBE)], [n for n, _ in _PROBE])

    # the search takes far longer than its rows' size tells, so these are dealt to all tasks
    probes = written(asked.select("q", "v").repartition(parallelism(spark), "q").mapInArrow(probe, "q long, floor double, tree int, block int, chunk int, leaves array<int>"), "probes")
    # blocks are at most trees x 2 ** DEEPEST; those that many queries take are dealt by query too
    parts = {(t, g): -(-c // QUERY_CHUNK) for t, g, c in probes.where("chunk = 0").groupBy("tree", "block").count().collect()}
    many = spark.createDataFrame([(t, g, int(chunks[t, g]), int(p)) for (t, g), p in parts.items()], "tree int, block int, chunks int, parts int")

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(_matrix(b.column(1)).astype(dtype))], ["q", "x"])

    block = F.shiftright("leaf", shift).alias("block")
    part = F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part")
    asking = probes.join(F.broadcast(many), ["tree", "block"]).select("q", "floor", "tree", "block", "chunk", "leaves", part)
    asking = asking.join(asked.select("q", "v").mapInArrow(packed, "q long, x binary"), "q")
    dealt = by_leaf.select("id", "x", "tree", "leaf", block).join(F.broadcast(many), ["tree", "block"]).select(
        "id", "x", "tree", "leaf", "block", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    keys = ["tree", "block", "chunk", "part"]

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        return _best(queries, rows, k + 1, dtype)

    hits = asking.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(best, "q long, id long, score double")
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = hits.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k + 1)
    each = rows.where("asked").select("id", "h1", "h2").distinct().join(asked.select("h1", "h2", "q"), ["h1", "h2"]).select(F.col("id").alias("query_id"), "q")
    own = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id")
    answers = each.join(top.select("q", "id", "score"), "q").where(F.col("id") != F.col("query_id"))
    return answers.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


_PROBE = [("q", pa.int64()), ("floor", pa.float64()), ("tree", pa.int32()), ("block", pa.int32()), ("chunk", pa.int32()), ("leaves", pa.list_(pa.int32()))]


def _trial(asked: DataFrame, placed: DataFrame, forest: Forest, sizes: np.ndarray, k: int, recall: float, longest: float, dtype) -> tuple[Neighbours, int]:
    """How neighbours lie, and the rows to meet for a share ``recall`` of them, from ``TRIALS`` queries against all rows."""
    tried = asked.orderBy(F.xxhash64("q"), "q").limit(TRIALS).select("q", "v").toArrow()
    if not len(tried):
        return Neighbours(np.ones((1, 1)), np.ones((1, 1))), 0
    own, q = tried["q"].to_numpy(), _matrix(tried["v"])

    def nearest(batches):
        held: list[list[tuple]] = [[] for _ in own]  # the nearest so far, by query
        for b in batches:
            if not len(b):
                continue
            scores = q @ _rows(b.column(1), dtype).T
            for i, s in enumerate(scores):
                for j in np.argpartition(-s, min(k, len(s) - 1))[: k + 1].tolist():
                    held[i].append((float(s[j]), b.column(0)[j].as_py(), b.column(1)[j].as_py(), b.column(2)[j].as_py()))
                held[i] = heapq.nlargest(k + 1, held[i], key=lambda h: h[0])
        rows = [(i, *h) for i, some in enumerate(held) for h in some]
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[i : i + 1000]), _TRIED)], [n for n, _ in _TRIED])

    tops = placed.mapInArrow(nearest, "i int, score double, id long, x binary, leaves array<int>")
    first = Window.partitionBy("i").orderBy(F.desc("score"), "id")
    truth = tops.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r").toArrow()  # TRIALS x (k + 1) rows
    i, ids = truth["i"].to_numpy(), truth["id"].to_numpy()
    others = ids != own[i]
    if not others.any():
        return Neighbours(q, q), int(sizes.sum())
    i, x = i[others], _lifted(_rows(truth["x"].combine_chunks(), dtype)[others], longest)
    leaves = np.array(truth["leaves"].to_pylist())[others]
    lifted = _lifted(q, None)
    near, needed = Neighbours(lifted[i], x), []
    for a in np.unique(i):
        left, right = forest.costs(lifted[a : a + 1], near)
        cost = forest.leaf_costs(left[0], right[0])
        order = np.argsort(cost, axis=None, kind="stable")
        met = np.empty(cost.size, np.int64)
        met[order] = np.cumsum(sizes.ravel()[order])
        needed.append(met.reshape(cost.shape)[np.arange(forest.trees), leaves[i == a]].min(1))
    return near, int(np.ceil(np.quantile(np.concatenate(needed), recall)))


_TRIED = [("i", pa.int32()), ("score", pa.float64()), ("id", pa.int64()), ("x", pa.binary()), ("leaves", pa.list_(pa.int32()))]


def _matrix(column) -> np.ndarray:
    """Rows of a column of number lists of one length."""
    n = len(column)
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _rows(column, dtype) -> np.ndarray:
    """The vectors of a binary column, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).astype(np.float64).reshape(len(column), -1)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _lifted(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Rows with a last component that makes their norms equal; for queries (None) it is 0."""
    last = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
    return np.column_stack([x, last])


def _best(queries: pa.Table, rows: pa.Table, k: int, dtype) -> pa.Table:
    """The best ``k`` rows of a block for each query, not below its floor, from the leaves that it took."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(queries) and len(rows):
        leaf = rows["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        leaf, ids, x = leaf[order], rows["id"].to_numpy()[order], _rows(rows["x"], dtype)[order]
        qs, floor, y = queries["q"].to_numpy(), queries["floor"].to_numpy(), _rows(queries["x"], dtype)
        taken = queries["leaves"].combine_chunks()
        wanted, who = taken.flatten().to_numpy(), np.repeat(np.arange(len(qs)), taken.value_lengths().to_numpy())
        order = np.argsort(wanted, kind="stable")
        wanted, who = wanted[order], who[order]
        for l in np.unique(wanted):
            r0, r1 = np.searchsorted(leaf, [l, l + 1])
            mine = who[slice(*np.searchsorted(wanted, [l, l + 1]))]
            for i in range(0, len(mine) if r1 > r0 else 0, 256):
                some = mine[i : i + 256]
                near = y[some] @ x[r0:r1].T
                bar = floor[some]
                if r1 - r0 > k:
                    kth = np.partition(near, r1 - r0 - k, axis=1)[:, r1 - r0 - k]
                    bar = np.maximum(bar, kth - 1e-12 * np.maximum(1, np.abs(kth)))
                a, b = np.nonzero(near >= bar[:, None])
                exact = np.zeros(len(a))
                for d in range(x.shape[1]):  # the same order of sums in every block
                    exact += y[some[a], d] * x[r0 + b, d]
                out.append((some[a], ids[r0 + b], exact))
    if not out:
        return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    a, i, s = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((i, -s, a))
    a, i, s = a[order], i[order], s[order]
    few = np.arange(len(a)) - np.searchsorted(a, a) < k
    return pa.table({"q": qs[a[few]], "id": i[few], "score": s[few]})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_ann: the 20 nearest of every row whose vec_id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20, F.col("vec_id") % 20 == 0)
