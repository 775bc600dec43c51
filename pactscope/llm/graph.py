"""Connected components of similar texts, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactscope.llm.common import freeze


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of the links (``a``, ``b``).

    Every node points at a smaller or equal one. Each round hooks the roots of linked nodes together and then halves
    all paths; rounds end when nothing moves. Each round is a frozen table.
    """
    links = freeze(links.where("a <> b").select("a", "b").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = freeze(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root")),
        "labels",
    )
    while True:
        lower = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        seen = both.join(lower, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        offered = labels.join(seen, "node", "left").withColumn("near", F.least("root", "near"))
        # what a node has seen also goes to the root it points at
        hooked = offered.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        moved = offered.join(hooked, "node", "left")
        moved = moved.select("node", F.col("root").alias("old"), F.least("near", "hook").alias("root"))
        above = moved.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = freeze(moved.join(above, "root", "left").select("node", "old", F.least("root", "above").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("root <> old").isEmpty():
            return labels
