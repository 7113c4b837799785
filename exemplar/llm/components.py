"""Connected components of a link table by contraction, all in Spark.

Each round points every node at its smallest neighbour (pointers strictly fall, so they form
trees), shortens the pointers twice, relabels the links and drops those inside one label.
A round at least halves the nodes that still have links; its tables are written to the
shared folder, so lineage stays short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the smallest node of the component.

    Null ends and links of a node with itself are ignored; repeated links count once.
    """
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        point = written(point.select("node", F.least("node", "low").alias("to")), "pointers")
        for _ in range(2):
            further = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
            point = point.join(further, "to").select("node", F.col("far").alias("to"))
        point = written(point, "pointers")
        ends = lambda c: point.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        labels = labels.join(ends("label"), "label", "left").select("node", F.coalesce("label_to", "label").alias("label"))
        labels = written(labels, "labels")
        links = links.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        links = written(links.where("a <> b").distinct(), "links")
    return labels
