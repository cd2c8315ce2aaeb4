"""Connected components by smallest label, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (``a, b``, longs); the smallest node reachable.

    In each round every node takes the smallest label among its neighbours' and then the label of
    its label, which halves the way to the smallest. Minima are combined before the shuffle, so the
    neighbours of a hub arrive as one row a task. It ends when a round changes nothing.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = materialize(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component"))
    labels = materialize(labels, "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("component").alias("before"), F.least("component", "heard").alias("component"))
        near = materialize(near, "labels-near")
        of = near.select(F.col("node").alias("component"), F.col("component").alias("farther"))
        far = near.join(of, "component").select("node", "before", F.col("farther").alias("component"))
        far = materialize(far, "labels")
        labels = far.select("node", "component")
        if far.where("component != before").isEmpty():
            return labels
