"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import materialize, release


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    Only an input of fewer partitions (one small file) is shuffled, so that Python work does not run
    in one task; a large input keeps its scan partitions and costs no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its least node.

    Contraction: each node joins the least of itself and its neighbours, edges are renamed accordingly and
    become fewer, until none is left. Each round is written to the shared folder, so lineage stays short,
    and nothing but the number of edges left reaches the driver.
    """
    left = materialize(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b AND a IS NOT NULL AND b IS NOT NULL").distinct()
    )
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    roots = materialize(nodes.withColumn("component", F.col("node")))
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("from"), F.least("a", "least").alias("to"))
        # One shortcut: the root of my root.
        up = hook.select(F.col("from").alias("to"), F.col("to").alias("top"))
        hook = materialize(hook.join(up, "to", "left").select("from", F.coalesce("top", "to").alias("to")))
        old = (left, roots, hook)
        roots = materialize(
            roots.join(hook, roots["component"] == hook["from"], "left").select("node", F.coalesce("to", "component").alias("component"))
        )
        renamed = left.join(hook.select(F.col("from").alias("a"), F.col("to").alias("x")), "a").join(
            hook.select(F.col("from").alias("b"), F.col("to").alias("y")), "b"
        )
        left = materialize(
            renamed.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        release(*old)  # written anew, nothing reads them any more
    return roots
