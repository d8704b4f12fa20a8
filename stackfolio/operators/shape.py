"""Restructuring of records: selection, cleaning, repeated values, unpivot."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wildcard_to_regex(pattern: str) -> str:
    """Field name pattern (``?`` one character, ``*`` any run, ``[…]`` a class, ``|``) to a regex."""
    out = []
    for char in pattern:
        out.append({"?": ".", "*": ".*", ".": r"\."}.get(char, char))
    return "^(?:" + "".join(out) + ")$"


def select_tags(fields: DataFrame, pattern: str, columns: Sequence[str] = ("tag",)) -> DataFrame:
    """Rows of a long field table whose name matches. A fixed prefix also prunes row groups."""
    name = F.concat(*columns) if len(columns) > 1 else F.col(columns[0])
    kept = fields.where(name.rlike(wildcard_to_regex(pattern)))
    prefix = _fixed_prefix(pattern)
    return kept.where(F.col(columns[0]).startswith(prefix[:3] if len(columns) > 1 else prefix)) if prefix else kept


def _fixed_prefix(pattern: str) -> str:
    if "|" in pattern:
        return ""
    out = ""
    for char in pattern:
        if char in "?*[":
            break
        out += char
    return out


def retain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the listed columns that exist."""
    return df.select(*[c for c in columns if c in df.columns])


def keep_where(df: DataFrame, test: Column) -> DataFrame:
    return df.where(F.coalesce(test, F.lit(False)))


def reject_where(df: DataFrame, test: Column) -> DataFrame:
    return df.where(~F.coalesce(test, F.lit(False)))


def vacuum(df: DataFrame) -> DataFrame:
    """Empty text, lists and objects become NULL at every depth; NULL list items are dropped."""
    return df.select(
        *[vacuumed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def vacuumed(value: Column, kind: T.DataType) -> Column:
    """Each value is worked out once: what is tested and then kept is an item of a list, never said twice."""
    if isinstance(kind, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(kind, T.ArrayType):
        return _if_kept(_vacuumed_items(value, kind.elementType), lambda items: F.size(items) > 0)
    if isinstance(kind, T.StructType):
        return _if_kept(_vacuumed_parts(value, kind), _has_part(kind))
    return value


def _if_kept(value: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(F.array(value), test), F.lit(0))


def _vacuumed_items(value: Column, inner: T.DataType) -> Column:
    if isinstance(inner, T.StringType):
        return F.filter(value, lambda v: v != "")
    if isinstance(inner, T.ArrayType):
        return F.filter(F.transform(value, lambda v: _vacuumed_items(v, inner.elementType)), lambda v: F.size(v) > 0)
    if isinstance(inner, T.StructType):
        return F.filter(F.transform(value, lambda v: _vacuumed_parts(v, inner)), _has_part(inner))
    return F.filter(value, lambda v: v.isNotNull())


def _vacuumed_parts(value: Column, kind: T.StructType) -> Column:
    return F.struct(*[vacuumed(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])


def _has_part(kind: T.StructType) -> Callable[[Column], Column]:
    return lambda v: reduce(lambda a, b: a | b, [v.getField(f.name).isNotNull() for f in kind.fields])


def map_values(values: Column, edit: Callable[[Column], Column]) -> Column:
    return F.transform(values, edit)


def map_field(items: Column, field: str, edit: Callable[[Column], Column]) -> Column:
    """Edit one field of every object in a list."""
    return F.transform(items, lambda x: x.withField(field, edit(x[field])))


def zip_lists(**lists: Column) -> Column:
    """Parallel lists → list of objects; shorter lists are padded with NULL."""
    longest = F.greatest(*[F.size(v) for v in lists.values()], F.lit(0))
    places = F.filter(F.sequence(F.lit(0), longest), lambda i: i < longest)
    return F.transform(
        places, lambda i: F.struct(*[F.get(v, i).alias(k) for k, v in lists.items()])
    )


def split_values(value: Column, delimiter: str) -> Column:
    return F.split(value, F.lit(_quoted(delimiter)))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def join_values(values: Column, delimiter: str) -> Column:
    return F.array_join(values, delimiter)


def uniq(values: Column) -> Column:
    """First occurrences; objects are compared whole."""
    return F.array_distinct(values)


def filter_values(values: Column, pattern: str, invert: bool = False) -> Column:
    return F.filter(values, lambda v: ~v.rlike(pattern) if invert else v.rlike(pattern))


def appended(values: Column, value: Column) -> Column:
    return F.when(value.isNull(), values).otherwise(
        F.array_append(F.coalesce(values, F.array().cast("array<string>")), value)
    )


def prepended(values: Column, value: Column) -> Column:
    return F.when(value.isNull(), values).otherwise(
        F.array_prepend(F.coalesce(values, F.array().cast("array<string>")), value)
    )


def flag(value: Column) -> Column:
    return value.isNotNull()


def fill_cascade(*sources: Column, default: str | None = None) -> Column:
    """First source that exists (empty text counts as missing)."""
    filled = [F.nullif(s, F.lit("")) for s in sources]
    return F.coalesce(*filled, F.lit(default)) if default is not None else F.coalesce(*filled)


def flatten_lists(value: Column) -> Column:
    return F.flatten(value)


Count = Callable[[Column], Column]


def record_paths(schema: T.StructType) -> list[tuple[str, Column]]:
    """(dotted path, number of non-empty values) per leaf; list levels are written ``name[]``."""
    return [
        (path, count(F.col(f"`{field.name}`")))
        for field in schema.fields
        for path, count in _leaf_counts(field.name, field.dataType)
    ]


def _leaf_counts(path: str, kind: T.DataType) -> list[tuple[str, Count]]:
    if isinstance(kind, T.StructType):
        return [
            (leaf, _inside(count, field.name))
            for field in kind.fields
            for leaf, count in _leaf_counts(f"{path}.{field.name}", field.dataType)
        ]
    if isinstance(kind, T.ArrayType):
        return [(leaf, _summed(count)) for leaf, count in _leaf_counts(f"{path}[]", kind.elementType)]
    present = (lambda v: v != "") if isinstance(kind, T.StringType) else (lambda v: v.isNotNull())
    return [(path, lambda v: F.when(present(v), 1).otherwise(0).cast("bigint"))]


def _inside(count: Count, name: str) -> Count:
    return lambda v: count(v.getField(name))


def _summed(count: Count) -> Count:
    zero = F.lit(0).cast("bigint")
    return lambda v: F.coalesce(F.aggregate(F.transform(v, count), zero, lambda a, b: a + b), zero)


def unpivot_record(df: DataFrame, id_col: str) -> DataFrame:
    """Flat record → triples (s, p, o); list columns give one triple per item. Missing values: none."""
    columns = [c for c in df.columns if c != id_col]
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def as_list(name: str) -> Column:
        value = F.col(f"`{name}`")
        if isinstance(kinds[name], T.ArrayType):
            return F.transform(value, lambda v: v.cast("string"))
        return F.when(value.isNotNull(), F.array(value.cast("string")))

    entries = F.array(
        *[F.struct(F.lit(c).alias("p"), as_list(c).alias("o")) for c in columns]
    )
    return (
        df.select(F.col(id_col).cast("string").alias("s"), F.explode(entries).alias("e"))
        .select("s", "e.p", F.explode("e.o").alias("o"))
    )


def rebuild(triples: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """Triples → one row per subject; each named predicate has the sorted list of all its values."""
    return triples.groupBy("s").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("p") == p, F.col("o")))).alias(p) for p in predicates]
    )
