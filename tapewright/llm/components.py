"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.session import stage


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (p, q); root is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then its label's label, so rounds grow with the
    logarithm of a component's width. Rounds are written tables; the driver sees one count.
    """
    both = stage(links.select(F.col("p").alias("node"), F.col("q").alias("other")).unionByName(links.select(F.col("q").alias("node"), F.col("p").alias("other"))), "links")
    labels = stage(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("low"))
        near = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        near = stage(near, "labels")
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = stage(near.join(jump, "root").select("node", "was", F.least("root", "next").alias("root")), "labels")
        if after.filter("root <> was").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
