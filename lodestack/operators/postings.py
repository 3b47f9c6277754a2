"""Reverse lookup from a term to the ids that have it, as a table of posting lists.

A term's ids are kept in blocks of ``WIDTH`` consecutive ids: sorted, each as its distance from the block's first possible id, with the smallest, the largest and their number beside them.
So a hot term is many rows, not one, no list is longer than ``WIDTH``, and the blocks of all terms begin at the same ids. The table is ordered by term, so a lookup of a few terms
reads the row groups that hold them; Parquet codes the distances as differences.

A query for all of several groups of terms looks at the blocks' bounds first, and leaves out a block that some group has nothing in, or in which the groups' ranges do not
meet, before any list is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import lists as made
from lodestack.sources.shipping import ship
from lodestack.sources.tables import kept, shared_path

WIDTH, FOLDER = 4096, 1 << 20


def build(pairs: DataFrame, terms: list[str], name: str, width: int = WIDTH) -> DataFrame:
    """The written postings (*terms, block, first, last, n, ids) of rows (*terms, id); repeated pairs count once, null ids and terms are left out."""
    ship(pairs.sparkSession)
    held = pairs.dropna(subset=[*terms, "id"])
    block = F.floor(F.col("id") / width)
    # dealt once, by ranges: a task has all pairs of its lists, and writes them in order
    pair = held.select(*terms, block.alias("block"), (F.col("id") - block * width).cast("int").alias("id"))
    lists = pair.select(*terms, "block", F.array("id").alias("ids")).schema
    return _written(_dealt(pair, terms, "id").mapInArrow(made.of_pairs, lists), terms, name, width)


def _dealt(rows: DataFrame, terms: list[str], *more: str) -> DataFrame:
    return rows.repartitionByRange(*terms, "block").sortWithinPartitions(*terms, "block", *more)


def _written(lists: DataFrame, terms: list[str], name: str, width: int) -> DataFrame:
    """The table of sorted lists (*terms, block, ids)."""
    at = F.col("block") * width
    table = lists.select(*terms, "block", (at + F.get("ids", F.lit(0))).alias("first"), (at + F.get("ids", F.size("ids") - 1)).alias("last"), F.size("ids").alias("n"), "ids")
    path = shared_path(lists.sparkSession, name)
    table.write.option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    return lists.sparkSession.read.schema(table.schema).parquet(path)


def ids(lists: DataFrame, width: int = WIDTH) -> DataFrame:
    """The ids of posting lists, one row for each list that has it, with the lists' other columns."""
    rest = [c for c in lists.columns if c not in ("block", "first", "last", "n", "ids")]
    return lists.select(*rest, "block", F.explode("ids").alias("id")).select(*rest, (F.col("block") * width + F.col("id")).alias("id"))


def any_of(postings: DataFrame, condition: Column, width: int = WIDTH) -> DataFrame:
    """(id): ids with a term that meets the condition, each once."""
    return ids(postings.where(condition), width).select("id").distinct()


def _meeting(marked: DataFrame, groups: int) -> DataFrame:
    """(block): blocks in which all groups have ids, and their ranges meet."""
    each = marked.groupBy("block", "group").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    both = each.groupBy("block").agg(F.count("*").alias("groups"), F.max("first").alias("first"), F.min("last").alias("last"))
    return both.where((F.col("groups") == groups) & (F.col("first") <= F.col("last"))).select("block")


def all_of(postings: DataFrame, group: Column, groups: int, width: int = WIDTH) -> DataFrame:
    """(id): ids with at least one term of each group; ``group``: a term's group, or null for terms that are not asked for."""
    marked = postings.withColumn("group", group).where("group IS NOT NULL")
    lists = marked.join(_meeting(marked, groups), "block", "left_semi").select("group", "block", "ids")
    return ids(lists, width).groupBy("id").agg(F.count_distinct("group").alias("_n")).where(F.col("_n") == groups).select("id")


def skipped(postings: DataFrame, group: Column, groups: int) -> DataFrame:
    """(lists, read): how many of the lists asked for are read by ``all_of``."""
    marked = postings.withColumn("group", group).where("group IS NOT NULL")
    read = marked.join(_meeting(marked, groups).withColumn("_read", F.lit(1)), "block", "left")
    return read.agg(F.count("*").alias("lists"), F.count("_read").alias("read"))


def by_mod(lineitem: DataFrame, width: int = WIDTH) -> DataFrame:
    """Postings from mods to the packs that contain them."""
    return build(lineitem.select(F.col("l_partkey").alias("mod_id"), F.col("l_orderkey").alias("id")), ["mod_id"], "postings-mods", width)


class TextIndex:
    """Substring search, case ignored, by posting lists of three characters in a row.

    A text's grams are all its runs of three characters in lower case; a shorter text is a gram itself. A needle of three characters or more is in a text only if all the needle's
    grams are: these ids are candidates, which the text itself confirms. For a shorter needle the grams that hold it are looked up, and their ids are the answer.

    Tasks make the lists of the texts that they read, so a gram may have several lists of a block, as many as tasks or runs of texts that share the block."""

    def __init__(self, texts: DataFrame, width: int = WIDTH, folder: int = FOLDER):
        """``texts``: (field, id, text), an id may have several; null texts are found by no needle. ``folder``: how many ids share a folder of the kept texts."""
        self._width, self._folder = width, folder
        ship(texts.sparkSession)
        low = texts.dropna().select("field", "id", F.lower("text").alias("text"))
        path = shared_path(texts.sparkSession, "indexed-texts")
        held = low.withColumn("folder", F.floor(F.col("id") / folder))
        # by the text too, so that the texts of one id may be dealt over several tasks; in order of their ids, so that a task's grams meet in few blocks
        dealt = held.repartitionByRange("field", "folder", "id", F.xxhash64("text")).sortWithinPartitions("field", "folder", "id")
        dealt.write.partitionBy("field", "folder").parquet(path)
        schema = held.select("id", "text", "field", "folder").schema
        self.texts = texts.sparkSession.read.schema(schema).parquet(path)
        grams = self.texts.select("field", F.col("id").cast("long"), "text").mapInArrow(lambda batches: made.of_grams(batches, width), made.GRAM_LISTS)
        # kept, since ranges are told by a first look at the rows
        self.postings = _written(_dealt(kept(grams, "grams"), ["field", "gram"]), ["field", "gram"], "postings-grams", width)

    def candidates(self, field: str, needle: str) -> DataFrame:
        """(id): the ids that may have the needle; for needles under three characters, those that do."""
        needle = needle.lower()
        mine = self.postings.where(F.col("field") == field)
        if len(needle) < 3:
            return any_of(mine, F.contains("gram", F.lit(needle)), self._width)
        grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
        return all_of(mine.where(F.col("gram").isin(grams)), F.col("gram"), len(grams), self._width)

    def search(self, field: str, *needles: str) -> DataFrame:
        """(id): ids with a text of the field that holds all needles. Only the folders of candidates are read."""
        found = None
        for needle in needles:
            mine = self.candidates(field, needle)
            found = mine if found is None else found.join(mine, "id", "left_semi")
        if len(needles) == 1 and len(needles[0]) < 3:
            return found
        asked = found.withColumn("folder", F.floor(F.col("id") / self._folder))
        kept = self.texts.where(F.col("field") == field).join(asked, ["folder", "id"], "left_semi")
        for needle in needles:
            kept = kept.where(F.contains("text", F.lit(needle.lower())))
        return kept.select("id").distinct()

