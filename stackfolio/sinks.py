"""Outputs. Every sink writes from all tasks; only explicitly small results become one file."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table, write_whole


def bulk_lines(df: DataFrame, id_col: str, index: str, doc_type: str) -> DataFrame:
    """Action line and source line per record in one text value."""
    action = F.to_json(
        F.struct(
            F.struct(
                F.lit(index).alias("_index"), F.lit(doc_type).alias("_type"), F.col(id_col).cast("string").alias("_id")
            ).alias("index")
        )
    )
    return df.select(F.concat(action, F.lit("\n"), F.to_json(F.struct("*"))).alias("value"))


def write_bulk(df: DataFrame, path: str, id_col: str, index: str, doc_type: str, batch: int = 1000) -> None:
    bulk_lines(df, id_col, index, doc_type).write.option("maxRecordsPerFile", batch).text(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "true").json(path)


def tsv_lines(df: DataFrame, columns: Sequence[str], distinct: bool = False) -> DataFrame:
    """Lookup columns with line breaks replaced, so that one row is one line."""
    out = df.select(*[F.regexp_replace(F.col(c).cast("string"), r"\n", ";").alias(c) for c in columns])
    return out.distinct() if distinct else out


def write_lookup_tsv(df: DataFrame, path: str, columns: Sequence[str], distinct: bool = False, header: bool = True) -> None:
    tsv_lines(df, columns, distinct).write.options(
        sep="\t", header=str(header).lower(), quote="", emptyValue="", nullValue=""
    ).csv(path)


def json_array_lines(df: DataFrame, column: str) -> DataFrame:
    """All different values as the lines of one JSON list: (place, v, value), to be read in the order of place and v.

    The brackets are lines of their own, so an empty table gives an empty list, and every value but the
    first begins with its comma, so a list may have any length. No job runs before the lines are read.
    """
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v"))
    first = known.agg(F.min("v")).scalar()
    item = F.regexp_extract(F.to_json(F.array("v")), r"(?s)^\[(.*)\]$", 1)
    comma = F.when(F.col("v") == first, "").otherwise(",")
    values = known.distinct().select(F.lit(1).alias("place"), "v", F.concat(comma, item).alias("value"))
    ends = df.sparkSession.createDataFrame([(0, None, "["), (2, None, "]")], "place int, v string, value string")
    return values.unionByName(ends)


def write_json_array(df: DataFrame, path: str, column: str) -> None:
    """The list over part files, whose order is that of their names."""
    json_array_lines(df, column).orderBy("place", "v").select("value").write.text(path)


def build_updates(df: DataFrame, id_col: str, columns: Sequence[str], base_url: str, path: str) -> DataFrame:
    """Changed records as requests (id, method, url, body); sending them is left to the caller."""
    return df.select(
        F.col(id_col).alias("id"),
        F.lit("PUT").alias("method"),
        F.concat(F.lit(f"{base_url}/api/{path}/"), F.col(id_col).cast("string")).alias("url"),
        F.to_json(F.struct(F.struct(*columns).alias("data"))).alias("body"),
    )


def build_creates(df: DataFrame, pick: Column, base_url: str, path: str) -> DataFrame:
    return df.where(pick).select(
        F.lit("POST").alias("method"),
        F.lit(f"{base_url}/api/{path}").alias("url"),
        F.to_json(F.struct(F.struct("*").alias("data"))).alias("body"),
    )


# --- concept vocabularies ---------------------------------------------------------------------

PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "dct": "http://purl.org/dc/terms/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "vann": "http://purl.org/vocab/vann/",
    "foaf": "http://xmlns.com/foaf/0.1/",
}


def skos_blocks(tree: DataFrame, scheme: str, texts: DataFrame | None = None, lang: str = "de") -> DataFrame:
    """(id, value): one Turtle block per concept. ``tree``: (parent, id, label, notation);
    ``texts``: (id, text), the path texts for skos:definition."""
    rows = tree
    if texts is not None:
        rows = tree.join(texts.select(F.col("id").alias("_id"), F.col("text").alias("_text")), F.col("id") == F.col("_id"), "left")
    else:
        rows = tree.withColumn("_text", F.lit(None).cast("string"))

    def quoted(value: Column) -> Column:
        safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), safe, F.lit('"'))

    lines = F.concat_ws(
        " ;\n    ",
        F.lit("a skos:Concept"),
        F.concat(F.lit("skos:broader <"), "parent", F.lit(">")),
        F.concat(F.lit("skos:definition "), quoted(F.col("_text")), F.lit(f"@{lang}")),
        F.lit(f"skos:inScheme <{scheme}>"),
        F.concat(F.lit("skos:notation "), quoted(F.col("notation"))),
        F.concat(F.lit("skos:prefLabel "), quoted(F.col("label")), F.lit(f"@{lang}")),
    )
    block = F.concat(F.lit("<"), "id", F.lit(">\n    "), lines, F.lit(" .\n"))
    return rows.select("id", block.alias("value"))


def skos_header(spark: SparkSession, scheme: str, title: str, namespace: str, prefix: str, lang: str = "de") -> DataFrame:
    head = "\n".join(f"@prefix {k}: <{v}> ." for k, v in PREFIXES.items())
    text = (
        f"{head}\n\n<{scheme}>\n    a skos:ConceptScheme ;\n    dct:title \"{title}\"@{lang} ;\n"
        f"    vann:preferredNamespaceUri \"{namespace}\" ;\n    vann:preferredNamespacePrefix \"{prefix}\" .\n"
    )
    return spark.createDataFrame([("", text)], "id string, value string")


def write_skos(tree: DataFrame, path: str, scheme: str, title: str, namespace: str, prefix: str, texts: DataFrame | None = None) -> None:
    """Header, top concept list entries and concept blocks, sorted by id."""
    top = tree.where("parent IS NULL").select(
        F.lit("").alias("id"), F.concat(F.lit(f"<{scheme}> skos:hasTopConcept <"), "id", F.lit("> .\n")).alias("value")
    )
    header = skos_header(tree.sparkSession, scheme, title, namespace, prefix)
    blocks = header.withColumn("o", F.lit(0)).unionByName(top.withColumn("o", F.lit(1))).unionByName(
        skos_blocks(tree, scheme, texts).withColumn("o", F.lit(2))
    )
    blocks.orderBy("o", "id", "value").select("value").write.text(path)


# --- snapshots --------------------------------------------------------------------------------


def swap_snapshot(df: DataFrame, root: str, name: str, version: str | None = None) -> str:
    """Write a fresh version, then commit it. Readers see the old or the new one whole.

    Of two writers at the same time both commit, one after the other, and the later one is read; a
    writer that dies leaves the old version in place, and writing the same version again changes nothing.
    """
    return write_whole(df, root, name, version)


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The newest version, whether it was written whole or by upserts."""
    return read_table(spark, root, name)


def prune_snapshots(versions: DataFrame) -> DataFrame:
    """Versions that may go: of (name, version, created, aliased) all that are not in use, but the newest
    of them per name stays. Removing the files is left to the caller."""
    free = versions.where(~F.col("aliased"))
    newest = free.groupBy(F.col("name").alias("_name")).agg(F.max_by("version", F.struct("created", "version")).alias("_newest"))
    kept = (F.col("name") == F.col("_name")) & (F.col("version") == F.col("_newest"))
    return free.join(newest, kept, "left_anti").select("name", "version", "created")


def version_stamp(name: str) -> str | None:
    """Time stamp of a snapshot name like ``titles-20240131-0400``."""
    found = re.search(r"(\d{8}-\d{4})$", name)
    return found.group(1) if found else None
