"""Operator 13: spelling variants, by generating the full neighbourhood of each word.

Words are counted by Spark. Each word then emits all its distinct deletions, replacements and insertions over the observed alphabet; those that are
words are exactly the words one edit away, so a hash join with the vocabulary finds them and no distance is worked out. Being near is mutual: a
word's near words are those that emitted it. So the emitted rows are aggregated by the word that they name, and the join needs no further shuffle.

Nearly all of a neighbourhood is no word. Before it is sent anywhere, each candidate is looked up in a bit table of the vocabulary (two bits a word, of at most
2 ** ``MOST_BITS`` bits, that is 64 MB), by rolling hashes worked out for whole batches of words of equal length. The table lets through what is a word for certain, and little
else; the join on the strings themselves decides. With more words than the table is made for, it lets more through, and the result stays the same.

A word has at most some 2 x length x alphabet near words, so no key can be hot. The alphabet is the fixed class of the runs at most.

Forms lead to words ten times as frequent each time, so following them ends after as many steps as the largest count has digits; rounds of following the followed
double the steps.

Cases: null and empty texts have no words; a null id counts as an empty one in the hash; very long texts and runs are read whole; repeated rows count each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, parallelism, ship, written

#: The class of the runs, how often a code point is deleted, the shortest word.
RUN, EVERY, SHORTEST = "[A-Za-z\\u00C0-\\u00FF]", 31, 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BITS_PER_WORD, LEAST_BITS, MOST_BITS = 64, 20, 29
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
BUCKET = 32768  # bits of one bitmap of Spark's bitmap functions
AT_ONCE = 400_000  # candidates looked up together


def occurrences(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, every: int = EVERY) -> DataFrame:
    """(word): a row per run that has ``shortest`` code points or more after the deletion."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))
    spelt = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run")).select("d", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return spelt.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 2, **cut) -> DataFrame:
    """(word, n): the words of at least ``least`` occurrences."""
    return occurrences(df, doc_id, text, **cut).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _codes(words: list[str]):
    """(positions, matrix of code points) for each length among the words."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for length, at in groupby(order, key=lambda i: len(words[i])):
        at = list(at)
        raw = "".join([words[i] for i in at]).encode("utf-32-le")
        yield at, np.frombuffer(raw, np.uint32).reshape(len(at), length).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.array([pow(int(BASE), i, 2**64) for i in range(n)], np.uint64)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Of each row: the sum of code point times BASE ** (length - 1 - place), modulo 2 ** 64."""
    return (codes * _powers(codes.shape[1])[::-1]).sum(1, dtype=np.uint64)


def _bits(hashes: np.ndarray, which: int, size: int) -> np.ndarray:
    """The bit of each hash, of 2 ** ``size``."""
    return ((hashes ^ (hashes >> np.uint64(29))) * MIX[which]) >> np.uint64(64 - size)


def bit_table(words: DataFrame, size: int) -> np.ndarray:
    """The bits of all words as bytes: made by tasks as bitmaps of ``BUCKET`` bits, at most 2 ** ``size`` / 8 bytes in all."""

    def places(batches):
        for b in batches:
            for _, codes in _codes(b.column(0).to_pylist()):
                h = _hashes(codes)
                for which in range(2):
                    yield pa.RecordBatch.from_arrays([pa.array(_bits(h, which, size).astype(np.int64))], ["bit"])

    parts = words.select("word").mapInArrow(places, "bit long").groupBy(F.floor(F.col("bit") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % BUCKET).alias("map"))
    table = np.zeros(2**size // 8, np.uint8)
    for bucket, bits in parts.collect():
        table[bucket * (BUCKET // 8) : bucket * (BUCKET // 8) + len(bits)] = np.frombuffer(bits, np.uint8)
    return table


def _in_table(hashes: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """The places in ``hashes`` (flat) of those that may be words."""
    found = None
    for which in range(2):
        bit = _bits(hashes if found is None else hashes[found], which, size)
        hit = np.flatnonzero((table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
        found = hit if found is None else found[hit]
    return found


def neighbours(codes: np.ndarray, alphabet: np.ndarray):
    """(hashes [word, place, letter], which are left out, kind, first place) of the deletions, replacements and insertions of words of one length, by
    ranges of places, so that very long words need no more memory.

    Deleting any of a run of equal letters gives the same word, and so does inserting a letter before or behind its like: only the
    first of the run is deleted, and nothing is inserted behind its like. Replacing a letter by itself gives no other word."""
    n, length = codes.shape
    power = _powers(length + 2)
    whole = codes * power[:length][::-1]

    def before(shares):  # the share in the hash of what stands before each place
        out = np.zeros((n, shares.shape[1] + 1), np.uint64)
        np.cumsum(shares, 1, dtype=np.uint64, out=out[:, 1:])
        return out

    behind = before(whole)
    h = behind[:, -1:]
    behind = h - behind  # from each place on
    like = np.zeros((n, length), bool)
    like[:, 1:] = codes[:, 1:] == codes[:, :-1]
    # what stands before a deleted letter goes down by one power, before an inserted one up
    yield (before(codes[:, :-1] * power[: length - 1][::-1]) + behind[:, 1:])[:, :, None], like[:, :, None], "delete", 0
    longer = before(codes * power[1 : length + 1][::-1]) + behind
    step = max(1, AT_ONCE // (n * len(alphabet)))
    for s in range(0, length, step):
        at = slice(s, min(s + step, length))
        letters = power[:length][::-1][at][None, :, None] * alphabet
        yield (h - whole[:, at])[:, :, None] + letters, codes[:, at, None] == alphabet, "replace", s
    for s in range(0, length + 1, step):
        at = slice(s, min(s + step, length + 1))
        same = np.zeros((n, at.stop - s, len(alphabet)), bool)
        same[:, s == 0 :] = codes[:, max(s - 1, 0) : at.stop - 1, None] == alphabet
        yield longer[:, at, None] + power[: length + 1][::-1][at][None, :, None] * alphabet, same, "insert", s


def candidates(words: DataFrame, alphabet: list[str], table: np.ndarray, size: int) -> DataFrame:
    """(word, n, near): the neighbours of each word that the bit table lets through, each once."""
    spark = words.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(table)

    def emit(batches):
        letters = np.array([ord(c) for c in alphabet], np.uint64)
        for b in batches:
            words, counts = b.column(0).to_pylist(), b.column(1).to_numpy()
            for at, codes in _codes(words):
                step = max(1, AT_ONCE // (len(letters) * (codes.shape[1] + 1)))
                for s in range(0, len(at), step):
                    whose, near = [], []
                    for hashes, out, kind, first in neighbours(codes[s : s + step], letters):
                        found = _in_table(hashes.ravel(), sent.value, size)
                        found = found[~out.ravel()[found]]
                        row, place, letter = np.unravel_index(found, hashes.shape)
                        for r, p, c in zip(row.tolist(), (place + first).tolist(), letter.tolist()):
                            w = words[i := at[s + r]]
                            whose.append(i)
                            near.append(w[:p] + w[p + 1 :] if kind == "delete" else w[:p] + alphabet[c] + w[p + (kind == "replace") :])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(whose, pa.int64())), pa.array(counts[whose] if whose else [], pa.int64()), pa.array(near, pa.string())], ["word", "n", "near"])

    # a word's neighbours take far longer than its size tells, so words are dealt to all tasks
    return words.select("word", "n").repartition(parallelism(spark)).mapInArrow(emit, "word string, n long, near string")


def forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n) of a written table (word, n): the most frequent near word, if it occurs ``ratio`` times as often."""
    ship(words.sparkSession)
    n = words.count()
    size = min(max(LEAST_BITS, int(np.ceil(np.log2(max(n, 1) * BITS_PER_WORD)))), MOST_BITS)
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = sorted(r[0] for r in letters.collect())  # at most the characters of the class of the runs
    found = candidates(words, alphabet, bit_table(words, size), size)
    # of the largest n, the smallest word: strings compare by code points
    best = found.groupBy("near").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("w"))).alias("best"))
    top = -F.col("best.less")
    far = F.coalesce(top >= F.col("n") * ratio, F.lit(False))
    joined = words.join(best, words["word"] == best["near"], "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("best.w")).alias("form"), F.when(far, top).alias("form_n"))


def rooted(formed: DataFrame) -> DataFrame:
    """Adds ``root`` to a written table of ``forms``: the last of the words that forms lead to, the word itself without a form."""
    links = written(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        moved = longer.where("moved").limit(1).count()
        discard(links)
        links = longer
        if not moved:
            break
    return formed.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 2, ratio: int = 10, **cut) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of the texts."""
    words = written(vocabulary(df, doc_id, text, least, **cut), "words")
    return rooted(written(forms(words, ratio), "forms"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_spelling_variants."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
