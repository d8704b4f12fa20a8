"""Sorted lists and pages. A global sort is range-partitioned, so no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sortkeys


def sort_hits(df: DataFrame, order: str, year: str = "year", id_col: str = "id", score: str | None = None) -> DataFrame:
    """``newest``, ``oldest``, or by relevance; ties by id."""
    keys: list[Column] = []
    if order == "newest":
        keys = [F.desc_nulls_last(year)]
    elif order == "oldest":
        keys = [F.asc_nulls_last(year)]
    elif score:
        keys = [F.desc(score)]
    return df.orderBy(*keys, id_col)


def sort_german(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(sortkeys.german(F.col(column)), column, *ties)


def sort_district(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(sortkeys.district(F.col(column)), column, *ties)


def sort_no_article(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(sortkeys.no_article(F.col(column)), column, *ties)


def sort_isil(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(sortkeys.isil(F.col(column)), *ties)


def page(df: DataFrame, keys: list[Column], start: int, size: int) -> DataFrame:
    """Offset paging: each task keeps its first ``start + size`` rows only."""
    return df.orderBy(*keys).offset(start).limit(size)


def sibling_key(first_id: Column, node: Column, label: Column) -> Column:
    """Children sort by id when the first child has a two-digit or double id, else by label.

    Both kinds in one struct, so that the whole tree sorts in one pass.
    """
    by_id = first_id.rlike(r"^n\d{2}$|^n\d+n\d+$")
    return F.struct(
        sortkeys.german(F.when(by_id, node).otherwise(label)).alias("text"), node.alias("node")
    )


def sort_siblings(nodes: DataFrame, parent: str = "parent", id_col: str = "id", label: str = "label") -> DataFrame:
    """Tree nodes in display order: top level by id, children of each parent by their rule.

    One global sort by (parent, key) spreads even a parent with very many children over many tasks.
    """
    keyed = with_sibling_key(nodes, parent, id_col, label)
    return keyed.orderBy(F.asc_nulls_first(parent), "_key", id_col).select(*nodes.columns)


def with_sibling_key(nodes: DataFrame, parent: str = "parent", id_col: str = "id", label: str = "label") -> DataFrame:
    """``_key``: place of a node among its siblings. The rule of a parent comes from a partial-combining minimum."""
    named = nodes.withColumn("_node", sortkeys.node_id(F.col(id_col)))
    first = named.groupBy(F.col(parent).alias("_p")).agg(F.min("_node").alias("_first"))
    joined = named.join(first, F.col(parent).eqNullSafe(F.col("_p")), "left")
    key = sibling_key(F.col("_first"), F.col("_node"), F.col(label))
    top = F.struct(sortkeys.german(F.col("_node")).alias("text"), F.col("_node").alias("node"))
    return joined.withColumn("_key", F.when(F.col(parent).isNull(), top).otherwise(key)).select(*nodes.columns, "_key")
