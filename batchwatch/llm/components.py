"""Connected components of an edge table by min-label propagation with pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwatch.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches. Every round is a written table; only the
    number of changed labels comes to the driver. Neighbours' labels are combined before they are shuffled."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        after = lower.join(jump, "label", "left").select("node", "old", F.least("label", "beyond").alias("label"))
        labels = written(after, "labels")
        if not labels.filter("label <> old").limit(1).count():
            return labels.select("node", "label")
