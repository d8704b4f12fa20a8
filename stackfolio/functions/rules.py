"""Rule tables: ordered (test, output) rows turned into CASE expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    test: Column
    output: str
    name: str = ""


def first_output(rules: Iterable[Rule], default: str | None = None) -> Column:
    """Output of the first rule that holds."""
    chain = None
    for rule in rules:
        chain = (
            F.when(rule.test, rule.output) if chain is None else chain.when(rule.test, rule.output)
        )
    if chain is None:
        return F.lit(default)
    return chain if default is None else chain.otherwise(default)


def all_outputs(blocks: Iterable[Iterable[Rule]]) -> Column:
    """One output per block (first rule of the block), as a list without repetition."""
    found = F.array(*[first_output(block) for block in blocks])
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull()))


def apply_rules(df: DataFrame, column: str, rules: list, mode: str = "first", default=None):
    """``first``: one output per row; ``all``: a list, where ``rules`` is a list of blocks."""
    if mode == "first":
        return df.withColumn(column, first_output(rules, default))
    if mode == "all":
        return df.withColumn(column, all_outputs(rules))
    raise ValueError(f"unknown mode: {mode}")


def rule_coverage(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """How many rows each rule holds for, in one pass."""
    rules = list(rules)
    counted = df.agg(
        *[F.count_if(r.test).alias(r.name or r.output) for r in rules]
    )
    return counted.unpivot([], counted.columns, "rule", "rows")
