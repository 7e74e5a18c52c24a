"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges ``a, b``; the root is the least node of its component.

    Every round maps a node to the least of itself and its neighbours and
    replaces the edges by those between different images, so stars vanish at
    once and chains shrink geometrically.  The maps are written, one per round,
    and composed at the end by joins whose right side has one row per node.
    """
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    labels = materialize(nodes, "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        step = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "step")
        left, right = step.select("a", F.col("to").alias("x")), step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = materialize(edges.join(left, "a").join(right, "b").filter("x <> y")
                            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        labels = materialize(labels.join(step.withColumnRenamed("a", "root"), "root", "left")
                             .select("node", F.coalesce("to", "root").alias("root")), "labels")
    return labels
