"""Union, routing, removal of deleted records, tree overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def route_collections(df: DataFrame, routes: dict[str, Column], column: str = "collection") -> DataFrame:
    """One row per collection that a record belongs to; a record may go to several.

    Write the result partitioned by ``column``: the input is read once.
    """
    targets = F.array(*[F.when(test, F.lit(name)) for name, test in routes.items()])
    return df.withColumn(column, F.explode(F.filter(targets, lambda v: v.isNotNull())))


def minus_deleted(df: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    gone = deletes.select(F.col(key).alias("_gone"))
    return df.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def overlay_children(base: DataFrame, extra: DataFrame, parent: str = "parent", child: str = "id") -> DataFrame:
    """Add edges that the base does not have; the base entry stays where both have one."""
    known = base.select(F.col(parent).alias("_p"), F.col(child).alias("_c"))
    new = extra.join(known, F.col(parent).eqNullSafe(F.col("_p")) & (F.col(child) == F.col("_c")), "left_anti")
    return base.unionByName(new, allowMissingColumns=True)


def dedupe_across_parents(edges: DataFrame, parent: str, child: str, parent_number: Column) -> DataFrame:
    """Of several parents of a child, only the numerically last one stays."""
    rest = [c for c in edges.columns if c != child]
    best = edges.groupBy(child).agg(F.max_by(F.struct(*rest), F.struct(parent_number, F.col(parent))).alias("_e"))
    return best.select(child, "_e.*").select(*edges.columns)
