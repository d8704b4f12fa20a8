"""JSON lines, change logs and mixed exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.rows import rows_of


def read_ndjson(
    spark: SparkSession, path: str, schema: StructType | str, record_path: str | None = None
) -> DataFrame:
    """JSON lines with a declared schema of the record; ``record_path`` as in ``unwrap``."""
    lines = spark.read.text(path)
    return parse_ndjson(lines, F.col("value"), schema, record_path)


def parse_ndjson(lines: DataFrame, json: Column, schema, record_path: str | None = None) -> DataFrame:
    """Parse a JSON column; ``data`` steps into an object, ``member[]`` gives one row per element.

    Steps combine, e.g. ``data[].attributes``. Only the declared fields are parsed.
    """
    text = schema if isinstance(schema, str) else schema.toDDL()
    kind = f"struct<{text}>" if not text.lower().startswith("struct<") else text
    steps = [s for s in (record_path or "").split(".") if s]
    for step in reversed(steps):
        name = step.removesuffix("[]")
        kind = f"struct<`{name}`:{'array<' + kind + '>' if step.endswith('[]') else kind}>"
    rows = lines.select(F.from_json(json, kind).alias("r"))
    for step in steps:
        name = step.removesuffix("[]")
        value = F.col("r").getField(name)
        rows = rows.select((F.explode(value) if step.endswith("[]") else value).alias("r"))
    return rows.where("r IS NOT NULL").select("r.*")


def select_entity(export: DataFrame, entity: str, type_column: str = "type") -> DataFrame:
    """One entity type of a mixed export; keep exports partitioned by type to prune files."""
    return export.where(F.col(type_column) == entity)


def mine_ids(texts: DataFrame, column: str, pattern: str) -> DataFrame:
    """All ids found in raw text, with ``-`` and with ``n``, each once."""
    found = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0)))
    ids = rows_of(texts, [], found, "id").distinct()
    spelled = F.array_distinct(F.array(F.col("id"), F.translate("id", "-", "n")))
    return ids.select(F.explode(spelled).alias("id")).distinct()
