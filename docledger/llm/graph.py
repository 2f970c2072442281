"""Connected components and bounded broadcasts for the pair operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.session import keep

#: Rows of one or two numbers that may be broadcast, some 30 MB; beyond that the same join is shuffled.
BROADCAST_ROWS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """Rows marked for broadcast when they are counted to be few; they have to be cheap to read twice, such as kept ones."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of edges (a, b): label is the least node that links reach.

    Each turn takes the least label among neighbours and then the label of that label, so chains halve. Nodes, labels and
    links stay distributed; turns end when no label changes.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = keep(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = keep(least.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        if labels.filter(F.col("label") != F.col("old")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
