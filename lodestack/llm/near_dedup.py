"""Operator 5: near-duplicate documents by HyperMinHash.

A document's set is its distinct word shingles, as 64-bit hashes. A sketch deals them into 128 buckets by seven bits of
the hash and keeps, of the least rest in each bucket, the number of leading zeros and ten mantissa bits: 16 bits a bucket. Since
sets are sorted, a bucket's least rest is the first hash behind the bucket's begin. Bands of four registers, taken as
keys, bring documents together; bands of empty buckets alone bring nothing. A register agrees with probability J at least, so two sets at J = 0.8 share none of 32 bands with
probability below (1 - 0.8 ** 4) ** 32 = 5e-8.

Documents of one set are one class from the start (128-bit fingerprint of the set), so exact copies meet nobody. Within a key, classes do not meet in all pairs:

1. Each class meets one centre of its key: at first the class with the smallest id, then, in a second round, one
   chosen by hash, if it is not yet connected with it. Candidates' set sizes must allow the similarity, they pass a test of how many registers
   of their sketches agree, and are then confirmed on full sets. Links give components. A centre has then met all its key and leaves it, so
   a key of two classes ends with the first round, one of three with the second.
2. In keys whose other classes still lie in several components, those outside the largest component meet all others, in blocks of
   bounded size. In a block, a pair counts in its first common key only; it must pass the sketches' test; what remains is confirmed
   on full sets, and each class reports one link per component. A key's classes are sent once per block of askers, and askers once per block
   of listeners.

No link between different sets is lost except by the bands' chance above (for tiny sets up to about 1e-6: of four shingles against five, all
must lie in the fifth's band) and the sketches' test, which drops a pair at the threshold with probability of at most ``LOSS``, by the exact binomial tail.

Cases: null, empty and blank texts have an empty set and are linked with nothing; texts of fewer words than a shingle are one shingle of all
words; rows that share an id are one node; rows with a null id are linked with nothing, their component is null and they stay;
an empty table gives an empty table; other columns are kept by ``dedup``.
"""

from __future__ import annotations

import functools
import hashlib
import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .components import components
from .shared import discard, ship, written

BUCKETS, ROWS, MANTISSA = 128, 4, 10
BANDS = BUCKETS // ROWS
EMPTY = np.uint16(0xFFFF)
#: Greatest chance that the sketches' test drops a pair at the threshold.
LOSS = 1e-8
BLOCK = 512
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))
_LIMIT = 800_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MULTIPLIERS[2]
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct shingle hashes of a text: A-Z in lower case, words between ASCII white space."""

    def __init__(self, words: int):
        import xxhash

        self._k, self._hash, self._known = words, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        known = self._known
        try:
            h = np.array(array("Q", map(known.__getitem__, words)))
        except KeyError:
            if len(known) > _LIMIT:
                known.clear()
            known.update((w, self._hash(w)) for w in set(words).difference(known))
            h = np.array(array("Q", map(known.__getitem__, words)))
        if not len(h):
            return np.zeros(0, np.uint64)
        n = max(len(h) - self._k + 1, 1)
        out = np.full(n, min(len(h), self._k), np.uint64)  # shingles of fewer words are of their own kind
        for i in range(min(len(h), self._k)):
            out = _mixed(out * _MULTIPLIERS[0] + h[i : i + n] * _MULTIPLIERS[1])
        return np.unique(out)


_BEGINS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a sorted set."""
    at = np.searchsorted(hashes, np.append(_BEGINS, np.uint64(2**64 - 1)))
    out = np.full(BUCKETS, EMPTY)
    full = at[:-1] < at[1:]
    rest = (hashes[at[:-1][full]] << np.uint64(7)) >> np.uint64(11)  # 53 bits, exact as a double
    fraction, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.where(rest == 0, 53, 53 - exponent)
    mantissa = np.where(rest == 0, 0, (fraction * 2 - 1) * 2**MANTISSA)
    out[full] = zeros.astype(np.uint16) << np.uint16(MANTISSA) | mantissa.astype(np.uint16)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch (rows); 0 where all its buckets are empty."""
    bands = np.ascontiguousarray(registers).view(np.uint64)  # four registers of 16 bits
    with np.errstate(over="ignore"):
        keys = _mixed(bands * _MULTIPLIERS[0] + np.arange(1, BANDS + 1, dtype=np.uint64) * _MULTIPLIERS[1])
    return np.where(bands == np.uint64(2**64 - 1), np.uint64(0), np.where(keys == 0, np.uint64(1), keys))


#: Chance that two buckets with different least rests agree: half the zeros are 0, a quarter 1, ...: sum of 4 ** -i, times 2 ** -MANTISSA.
CHANCE = 2.0**-MANTISSA / 3


def estimated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of the sketches in the rows of ``a`` and ``b``, and how many registers each rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(-1)
    same = ((a == b) & used).sum(-1) / np.maximum(n, 1)
    return (same - CHANCE) / (1 - CHANCE), n


def plausible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    used = (a != EMPTY) | (b != EMPTY)
    return ((a == b) & used).sum(-1) >= least_agreeing(percent)[used.sum(-1)]


@functools.cache
def least_agreeing(percent: int) -> np.ndarray:
    """By registers in use: how many agree at least, but for a chance of ``LOSS``, at the threshold; chance agreement only adds to them."""
    p, out = percent / 100, []
    for n in range(BUCKETS + 1):
        k = tail = 0
        while k < n and (tail := tail + math.comb(n, k) * p**k * (1 - p) ** (n - k)) <= LOSS:
            k += 1
        out.append(k)
    return np.array(out)


def confirmed(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def sketches(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sketch): set size, fingerprint of the set, registers; the last three null for empty sets."""
    ship(docs.sparkSession)

    def run(batches):
        shingles = chunks.once(("shingles", words), lambda: Shingler(words))
        for b in chunks.parts(batches):
            texts = b.column(1).to_pylist()
            n, f1, f2, s = [], [], [], []
            for t in texts:
                h = shingles(t)
                n.append(len(h))
                f = hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None
                f1.append(f and int.from_bytes(f[:8], "little", signed=True))
                f2.append(f and int.from_bytes(f[8:], "little", signed=True))
                s.append(sketch(h).tobytes() if f else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(s, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary"
    )


def _bands(classes: DataFrame) -> DataFrame:
    """(u, key) of each band of each class that is not empty."""

    def run(batches):
        for b in batches:
            keys = band_keys(_registers(b.column(1))) if len(b) else np.zeros((0, BANDS), np.uint64)
            i, j = np.nonzero(keys)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(keys[i, j].view(np.int64))], ["u", "key"])

    return classes.select("u", "sketch").mapInArrow(run, "u long, key long")


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose set sizes and sketches allow the similarity."""
    sizes = classes.select("u", "size")
    sized = pairs.join(sizes, "u").join(sizes.withColumnsRenamed({"u": "v", "size": "other"}), "v")
    pairs = sized.where(F.least("size", "other") * 100 >= F.greatest("size", "other") * percent).select("u", "v")
    side = classes.select("u", "sketch")
    rows = pairs.join(side, "u").join(side.select(F.col("u").alias("v"), F.col("sketch").alias("other")), "v")

    def run(batches):
        for b in batches:
            if len(b):
                yield b.filter(pa.array(plausible(_registers(b.column(2)), _registers(b.column(3)), percent))).select(["u", "v"])

    return rows.select("u", "v", "sketch", "other").mapInArrow(run, "u long, v long")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    # only the texts that some pair needs are dealt; where the pairs are few, Spark sends them to the texts
    one = texts.join(pairs.select("u").distinct(), "u", "left_semi")
    two = texts.withColumnsRenamed({"u": "v", "text": "other"}).join(pairs.select("v").distinct(), "v", "left_semi")
    rows = pairs.join(one, "u").join(two, "v")

    def run(batches):
        shingles = chunks.once(("shingles", words), lambda: Shingler(words))
        held = (None, None)
        for b in chunks.parts(batches):
            keep = []
            for t, o in zip(*(b.column(i).to_pylist() for i in (2, 3))):
                if held[0] != o:
                    held = (o, shingles(o))
                keep.append(confirmed(shingles(t), held[1], percent))
            yield b.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return rows.select("u", "v", "text", "other").mapInArrow(run, "u long, v long")


def _split_keys(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, u, c, other, rows, others): the bands whose classes lie in several components; ``other`` is true outside the key's largest one,
    ``rows`` and ``others`` count the key's classes and those outside."""
    labelled = bands.join(labels.withColumnRenamed("node", "u"), "u", "left").withColumn("c", F.coalesce("component", "u")).drop("component")
    per = labelled.groupBy("key", "c").agg(F.count("*").alias("n"))
    split = per.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("rows"), F.max("n").alias("most")).where("parts > 1")
    split = split.select("key", "main", "rows", (F.col("rows") - F.col("most")).alias("others"))
    return labelled.join(split, "key").select("key", "u", "c", "rows", "others", (F.col("c") != F.col("main")).alias("other"))


def _rest(split: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components in keys that still hold several, each class of a smaller component against all others, in blocks.

    Those that ask are dealt into i, all classes as listeners into j: a key whose classes are nearly all of one component is sent about once."""
    asking, hearing = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("others", "rows"))
    place = lambda parts: F.pmod(F.xxhash64("u"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    asked = split.where("other").select("key", "u", "c", place(asking).alias("i"), every(hearing).alias("j"), F.lit(True).alias("asks"))
    heard = split.select("key", "u", "c", every(asking).alias("i"), place(hearing).alias("j"), F.lit(False).alias("asks"))
    blocks = asked.unionByName(heard)
    with_sketch = blocks.join(classes.select("u", "size", "sketch"), "u")

    def meet(t: pa.Table) -> pa.Table:
        asks = t["asks"].to_numpy(zero_copy_only=False)
        u, c, n, s = t["u"].to_numpy(), t["c"].to_numpy(), t["size"].to_numpy(), _registers(t["sketch"].combine_chunks())
        keys, key = band_keys(s), np.int64(t["key"][0].as_py()).astype(np.uint64)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        seen = np.zeros(len(u), bool)
        for x in a:
            y = b[(c[b] != c[x]) & (np.minimum(n[b], n[x]) * 100 >= np.maximum(n[b], n[x]) * percent)]
            same = keys[y] == keys[x]
            same &= keys[x] != 0
            y = y[keys[x][np.argmax(same, axis=1)] == key] if len(y) else y
            y = y[plausible(s[x], s[y], percent)] if len(y) else y
            if len(y):
                seen[x] = True
                seen[y] = True
        return pa.table({n: t[n].filter(pa.array(seen)) for n in ("key", "i", "j", "u", "c", "asks")})

    shape = "key long, i int, j int, u long, c long, asks boolean"
    met = written(with_sketch.groupBy("key", "i", "j").applyInArrow(meet, shape), "met")

    def link(t: pa.Table) -> pa.Table:
        shingles = chunks.once(("shingles", words), lambda: Shingler(words))
        asks, u, c = t["asks"].to_numpy(zero_copy_only=False), t["u"].to_numpy(), t["c"].to_numpy()
        s = _registers(t["sketch"].combine_chunks())
        sets = [shingles(x) for x in t["text"].to_pylist()]
        out = []
        for x in np.flatnonzero(asks):
            y = np.flatnonzero(~asks & (c != c[x]))
            done = set()
            for z in y[plausible(s[x], s[y], percent)] if len(y) else ():
                if c[z] not in done and confirmed(sets[x], sets[z], percent):
                    done.add(c[z])
                    out.append((u[x], u[z]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})

    rows = met.join(texts.join(met.select("u").distinct(), "u", "left_semi"), "u").join(classes.select("u", "sketch"), "u")
    return rows.groupBy("key", "i", "j").applyInArrow(link, "u long, v long")


def classify(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; sets are linked where 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    rows = written(sketches(docs, words, doc_id, text), "sketches")
    usable = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(usable.groupBy("f1", "f2", "sketch").agg(F.min("doc_id").alias("u"), F.first("n_shingles").alias("size")), "classes")
    bands = _bands(classes)
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("u").alias("first")).where("n > 1")
    bands = written(bands.join(shared, "key"), "bands")
    texts = docs.select(F.col(doc_id).cast("long").alias("u"), F.col(text).alias("text")).join(bands.select("u").distinct(), "u", "left_semi")
    texts = written(texts, "texts")

    pairs = bands.where("u <> first").select("u", F.col("first").alias("v")).distinct()
    likely = written(_candidates(pairs, classes, percent), "pairs")
    links = written(_confirm(likely, texts, words, percent), "links")
    discard(likely)
    same = _several(usable)
    links = links.unionByName(same)
    labels = components(links)

    unmet = bands.where("n > 2 AND u <> first").select("key", "u")
    split = written(_split_keys(unmet, labels), "split")
    discard(bands)
    centre = split.groupBy("key").agg(F.min_by(F.struct("u", "c"), F.xxhash64("key", "u")).alias("m"))
    centred = split.join(centre, "key").where(F.col("u") != F.col("m.u"))
    pairs = centred.where("c <> m.c").select("u", F.col("m.u").alias("v")).distinct()
    likely = written(_candidates(pairs, classes, percent), "pairs")
    more = written(_confirm(likely, texts, words, percent), "links")
    discard(likely)
    links = links.unionByName(more)
    labels = components(links)

    last, split = split, written(_split_keys(centred.where("rows > 2").select("key", "u"), labels), "split")
    discard(last)
    rest = written(_rest(split, classes, texts, words, percent), "links")
    discard(split)
    discard(texts)
    labels = components(links.unionByName(rest)) if rest.limit(1).count() else labels

    named = classes.select("f1", "f2", "u").groupBy("f1", "f2").agg(F.min("u").alias("u"))
    known = named.join(labels.withColumnRenamed("node", "u"), "u", "left").select("f1", "f2", F.coalesce("component", "u").alias("component_id"))
    out = rows.drop("sketch").join(known, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(F.col("doc_id").alias(doc_id), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("component_id").isNull() | (F.col("component_id") == F.col(doc_id))
    )


def _several(usable: DataFrame) -> DataFrame:
    """Links (u, v) between the classes that rows of one id are in."""
    per = usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("v"))
    ids = usable.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = usable.join(ids, "doc_id").join(per, ["f1", "f2"])
    return several.where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct()


def dedup(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: those with the smallest id of each component."""
    stay = classify(docs, words, percent, doc_id, text).where("NOT kept").select(F.col(doc_id).alias("__gone")).distinct()
    return docs.join(stay, docs[doc_id].cast("long") == stay["__gone"], "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_near_dedup: two words, four fifths."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, percent=80)
