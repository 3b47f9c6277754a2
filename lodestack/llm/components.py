"""Connected components of a link table, for near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v): the smallest node that it reaches.

    Rounds of taking the smallest label among neighbours and then following labels (label of the label), until nothing changes; each
    round's labels are a written table. Rounds grow with the logarithm of the longest path.
    """
    both = written(
        links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "links"
    )
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("heard"))
        near = labels.join(heard, labels["node"] == heard["u"]).select("node", F.col("component").alias("was"), F.least("component", "heard").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("component").alias("above"))
        # what a label's own node was told before is never larger than the label
        new = written(near.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("above", "label")).alias("component")), "labels")
        changed = new.where("was <> component").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels.select("node", "component")
