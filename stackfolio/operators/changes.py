"""Change log applied to a record set (batch side; see ``streaming.changes`` for streams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def final_versions(log: DataFrame, key: str, version: str, op: str = "op", delete: str = "delete") -> DataFrame:
    """The last entry per id, deletions included; entries without id are dropped."""
    rest = [c for c in log.columns if c != key]
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col(version)).alias("_row")
    )
    return last.select(key, "_row.*").withColumn("_gone", F.col(op) == delete)


def apply_changes(
    base: DataFrame | None, log: DataFrame, key: str, version: str, op: str = "op", delete: str = "delete"
) -> DataFrame:
    """Newest data version per id, deleted ids removed; base records that the log does not name stay."""
    last = final_versions(log, key, version, op, delete)
    live = last.where(~F.col("_gone")).drop("_gone", op)
    if base is None:
        return live
    named = last.select(F.col(key).alias("_named"))
    untouched = base.join(named, F.col(key) == F.col("_named"), "left_anti")
    return untouched.unionByName(live, allowMissingColumns=True)


def changed_only(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` in a compared column, or are not there."""
    before = old.select(F.col(key).alias("_id"), *[F.col(c).alias(f"_o_{c}") for c in compare])
    joined = new.join(before, F.col(key) == F.col("_id"), "left")
    differs: Column = F.col("_id").isNull()
    for name in compare:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"_o_{name}"))
    return joined.where(differs).select(*new.columns)
