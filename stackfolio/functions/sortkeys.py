"""Sort keys for library lists. Each gives a column (or struct) that orders as plain values do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]


def german(value: Column) -> Column:
    return F.collate(value, "de")


def district(label: Column) -> Column:
    """District labels by number, Arabic or Roman; other labels alphabetically."""
    numeral = F.regexp_extract(label, r"^(.*Stadtbezirk)\s+(\d+|[IVX]+)\b(.*)$", 2)
    number = F.when(numeral.rlike(r"^\d+$"), numeral.try_cast("int"))
    for place, roman in enumerate(ROMAN, start=1):
        number = number.when(numeral == roman, place)
    head = F.when(
        number.isNotNull(), F.regexp_extract(label, r"^(.*Stadtbezirk)", 1)
    ).otherwise(label)
    tail = F.when(
        number.isNotNull(), F.regexp_extract(label, r"Stadtbezirk\s+(?:\d+|[IVX]+)\b(.*)$", 1)
    ).otherwise("")
    return F.struct(
        german(head).alias("head"), F.coalesce(number, F.lit(0)).alias("number"), german(tail).alias("tail")
    )


def no_article(label: Column) -> Column:
    return german(F.regexp_replace(label, r"^(Der|Die|Das|De|Dä)\s", ""))


def _numeric(part: Column) -> Column:
    """Non-digits count as nine, so that plain numbers come first."""
    return F.regexp_replace(part, r"\D", "9").try_cast("decimal(38,0)")


def isil(value: Column) -> Column:
    parts = F.split(value, "-")
    return F.struct(
        _numeric(F.get(parts, F.lit(1))).alias("main"),
        F.get(parts, F.lit(1)).alias("text"),
        F.size(parts).alias("size"),
        F.coalesce(_numeric(F.get(parts, F.lit(2))), F.lit(-1)).alias("sub"),
        value.alias("whole"),
    )


def node_id(uri: Column) -> Column:
    """Id part of a tree node; the node ``n6`` comes first."""
    part = F.element_at(F.split(uri, "#"), -1)
    return F.when(part == "n6", "n0").otherwise(part)
