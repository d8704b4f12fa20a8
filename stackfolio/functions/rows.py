"""List items as rows, with the list computed once.

A plain ``explode`` makes the optimizer add a filter "list not empty" and push it to the scan, where the
expression behind the list is computed a second time. The outer form has no such filter; empty lists are
dropped after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, keep: list[str], items: Column | str, value: str, pos: str | None = None) -> DataFrame:
    """One row per list item: the kept columns, (position,) item. Without ``pos``, NULL items are dropped."""
    if pos is None:
        return df.select(*keep, F.explode_outer(items).alias(value)).where(F.col(value).isNotNull())
    return df.select(*keep, F.posexplode_outer(items).alias(pos, value)).where(F.col(pos).isNotNull())
