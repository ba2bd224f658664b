"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmap.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): every node that has an edge, with the least node that
    it can reach.  Loops and repeated edges are allowed.

    Every round takes the least label among neighbours (combined before the
    shuffle, so a hub is a handful of partial minima) and then the label of
    that label, which halves the remaining distance; rounds are stored, so
    the lineage stays short.  The driver sees one count for each round.
    """
    both = stored(edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
                  .union(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"))), "edges")
    labels = stored(both.groupBy(F.col("src").alias("node"))
                    .agg(F.least("src", F.min("dst")).alias("comp")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "dst"), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("near")))
        low = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("jump"))
        after = stored(low.join(jump, "low").select(
            "node", F.least("low", "jump").alias("comp"), (F.least("low", "jump") != F.col("comp")).alias("moved")), "labels")
        labels = after.select("node", "comp")
        if after.filter("moved").isEmpty():
            return labels
