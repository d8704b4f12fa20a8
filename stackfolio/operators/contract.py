"""Contracts written as JSON Schema, compiled to one column expression over nested rows.

A row is read as the JSON that it would be written as: a NULL value is absent. The expression gives all
violations of a row with the place of each (``contribution/0/agent/type/1``), in one pass without a
shuffle. Known keywords: ``$ref`` (other files and ``#/…``), ``type``, ``properties``, ``required``,
``additionalProperties`` (false), ``items``, ``minItems``, ``maxItems``, ``uniqueItems``, ``minLength``, ``maxLength``,
``minimum``, ``maximum``, ``pattern``, ``format`` (``uri``, ``date-time``, ``date``), ``const``, ``enum``, ``allOf``, ``anyOf``,
``oneOf`` and ``not``. Others that restrict anything are refused.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Schema = Mapping | bool
SILENT = {"$id", "$schema", "$comment", "title", "description", "default", "examples", "definitions", "$defs"}
FORMATS = {
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
}
VIOLATIONS = "array<struct<path:string,rule:string>>"


def json_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    return "number" if isinstance(kind, T.NumericType) else "string"


class Contract:
    """A schema with the files that it refers to by name."""

    def __init__(self, schema: Schema, files: Mapping[str, Schema] | None = None):
        self.schema, self.files = schema, files or {}

    def _target(self, ref: str, root: Schema) -> tuple[Schema, Schema]:
        """Schema that a reference names, and the file that it is in."""
        name, _, inside = ref.partition("#")
        if name and name not in self.files:
            raise ValueError(f"no schema {name!r}: there are {sorted(self.files)}")
        root = self.files[name] if name else root
        found = root
        for step in filter(None, inside.split("/")):
            found = found[step]
        return found, root

    def violations(self, value: Column, kind: T.DataType, path: Column) -> Column:
        return self._of(self.schema, self.schema, value, kind, path)

    def _of(self, schema: Schema, root: Schema, value: Column, kind: T.DataType, path: Column) -> Column:
        """Violations of a value that may be NULL."""
        none = F.array().cast(VIOLATIONS)
        if isinstance(schema, bool):
            return none if schema else F.when(value.isNotNull(), self._one(path, "false")).otherwise(none)
        if "$ref" in schema:
            target, file = self._target(schema["$ref"], root)
            return self._of(target, file, value, kind, path)
        alone: list[tuple[str, Column]] = []  # (keyword, whether it holds)
        nested: list[Column] = []
        for word, asked in schema.items():
            if word in SILENT:
                continue
            method = getattr(self, f"_{word}", None)
            if method is None:
                raise ValueError(f"keyword {word!r} is not supported")
            found = method(asked, schema, root, value, kind, path)
            if isinstance(found, list):
                nested += found
            elif found is not None:
                alone.append((word, found))
        parts = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(path.alias("path"), F.lit(word).alias("rule"))) for word, ok in alone]
        own = F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else none
        return F.when(value.isNotNull(), F.concat(own, *nested)).otherwise(none) if parts or nested else none

    @staticmethod
    def _one(path: Column, rule: str) -> Column:
        return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))

    # keywords: a column that must hold, a list of further violations, or None where the keyword says nothing

    def _type(self, asked, schema, root, value, kind, path):
        names = [asked] if isinstance(asked, str) else list(asked)
        is_a = json_type(kind)
        if is_a in names or is_a == "integer" and "number" in names:
            return None
        return value == F.floor(value) if is_a == "number" and "integer" in names else F.lit(False)

    def _properties(self, asked, schema, root, value, kind, path):
        if not isinstance(kind, T.StructType):
            return None
        known = {f.name: f.dataType for f in kind.fields}
        return [self._of(part, root, value[name], known[name], _inside(path, name)) for name, part in asked.items() if name in known]

    def _required(self, asked, schema, root, value, kind, path):
        if not isinstance(kind, T.StructType):
            return None
        names = {f.name for f in kind.fields}
        missing = [F.when(value[n].isNull() if n in names else F.lit(True), F.struct(_inside(path, n).alias("path"), F.lit("required").alias("rule"))) for n in asked]
        return [F.filter(F.array(*missing), lambda x: x.isNotNull())] if missing else None

    def _additionalProperties(self, asked, schema, root, value, kind, path):  # noqa: N802
        if asked is not False or not isinstance(kind, T.StructType):
            if isinstance(asked, bool):
                return None
            raise ValueError("additionalProperties must be true or false")
        more = [f.name for f in kind.fields if f.name not in schema.get("properties", {})]
        return [F.when(value[n].isNotNull(), self._one(_inside(path, n), "additionalProperties")).otherwise(F.array().cast(VIOLATIONS)) for n in more] or None

    def _items(self, asked, schema, root, value, kind, path):
        if not isinstance(kind, T.ArrayType):
            return None
        if isinstance(asked, list):
            raise ValueError("a list of item schemas is not supported")
        each = lambda v, i: self._of(asked, root, v, kind.elementType, F.concat(path, F.lit("/"), i.cast("string")))
        return [F.flatten(F.transform(value, each))]

    def _minItems(self, asked, schema, root, value, kind, path):  # noqa: N802
        return F.size(value) >= asked if isinstance(kind, T.ArrayType) else None

    def _maxItems(self, asked, schema, root, value, kind, path):  # noqa: N802
        return F.size(value) <= asked if isinstance(kind, T.ArrayType) else None

    def _uniqueItems(self, asked, schema, root, value, kind, path):  # noqa: N802
        return F.size(F.array_distinct(value)) == F.size(value) if asked and isinstance(kind, T.ArrayType) else None

    def _minLength(self, asked, schema, root, value, kind, path):  # noqa: N802
        return F.length(value) >= asked if json_type(kind) == "string" else None

    def _maxLength(self, asked, schema, root, value, kind, path):  # noqa: N802
        return F.length(value) <= asked if json_type(kind) == "string" else None

    def _minimum(self, asked, schema, root, value, kind, path):
        return value >= asked if isinstance(kind, T.NumericType) else None

    def _maximum(self, asked, schema, root, value, kind, path):
        return value <= asked if isinstance(kind, T.NumericType) else None

    def _pattern(self, asked, schema, root, value, kind, path):
        return value.rlike(asked) if json_type(kind) == "string" else None

    def _format(self, asked, schema, root, value, kind, path):
        return value.cast("string").rlike(FORMATS[asked]) if asked in FORMATS and isinstance(kind, T.StringType) else None

    def _const(self, asked, schema, root, value, kind, path):
        return self._enum([asked], schema, root, value, kind, path)

    def _enum(self, asked, schema, root, value, kind, path):
        fits = {"string": str, "boolean": bool, "integer": (int, float), "number": (int, float)}
        if any(isinstance(a, (list, dict)) for a in asked):
            raise ValueError("only single values can be compared")
        usable = [a for a in asked if isinstance(a, fits.get(json_type(kind), ())) and (json_type(kind) == "boolean") == isinstance(a, bool)]
        return value.isin(*usable) if usable else F.lit(False)

    def _holds(self, part, root, value, kind, path) -> Column:
        return F.size(self._of(part, root, value, kind, path)) == 0

    def _allOf(self, asked, schema, root, value, kind, path):  # noqa: N802
        return [self._of(part, root, value, kind, path) for part in asked]

    def _anyOf(self, asked, schema, root, value, kind, path):  # noqa: N802
        return reduce(lambda a, b: a | b, [self._holds(part, root, value, kind, path) for part in asked])

    def _oneOf(self, asked, schema, root, value, kind, path):  # noqa: N802
        return sum((self._holds(part, root, value, kind, path).cast("int") for part in asked), F.lit(0)) == 1

    def _not(self, asked, schema, root, value, kind, path):
        return ~self._holds(asked, root, value, kind, path)


def _inside(path: Column, name: str) -> Column:
    return F.concat(path, F.when(path == "", "").otherwise("/"), F.lit(name))


def contract_violations(df: DataFrame, id_col: str, schema: Schema, files: Mapping[str, Schema] | None = None) -> DataFrame:
    """(id, path, rule) of each violation of the schema by a row; the columns are the properties."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found = Contract(schema, files).violations(row, df.schema, F.lit(""))
    return df.select(F.col(id_col).cast("string").alias("id"), F.explode_outer(found).alias("v")).where("v IS NOT NULL").select("id", "v.path", "v.rule")
