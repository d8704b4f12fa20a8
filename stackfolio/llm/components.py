"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the smallest node reachable.

    Each round, a node takes its smallest neighbour's name if that is smaller, and the edges are
    renamed; edges inside one name go. Minima are summed before the exchange, so a node with very many
    links is no hot key, and only written tables are carried from round to round. Null ends are
    ignored; an empty table gives no rows.
    """
    left = written(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(),
        "edges",
    )
    nodes = left.select(F.col("u").alias("node")).union(left.select("v")).distinct()
    labels = written(nodes.withColumn("label", F.col("node")), "labels")
    while not left.isEmpty():
        # u < v in every edge: v has a smaller neighbour, the smallest u of its edges
        parent = written(left.groupBy("v").agg(F.min("u").alias("p")), "parents")
        up = lambda name: F.coalesce(F.col(f"{name}_p"), F.col(name))
        of = lambda name: parent.select(F.col("v").alias(f"{name}_v"), F.col("p").alias(f"{name}_p"))
        named = left.join(of("u"), F.col("u") == F.col("u_v"), "left").join(of("v"), F.col("v") == F.col("v_v"), "left")
        named = named.select(up("u").alias("a"), up("v").alias("b")).where("a <> b")
        left = written(named.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        moved = labels.join(of("label"), F.col("label") == F.col("label_v"), "left")
        labels = written(moved.select("node", up("label").alias("label")), "labels")
    return labels
