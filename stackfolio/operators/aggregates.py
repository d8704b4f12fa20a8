"""Counts, facets, profiles. All counting is partial per task before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sortkeys import german
from .shape import record_paths


def count_by(triples: DataFrame, part: str) -> DataFrame:
    """Frequency of subjects, predicates or objects."""
    return triples.groupBy(F.col(part).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def profile_structure(df: DataFrame) -> DataFrame:
    """(path, n): non-empty values per flattened path, in one pass without exploding records."""
    leaves = record_paths(df.schema)
    totals = df.agg(*[F.sum(count).alias(path.replace(".", "/")) for path, count in leaves])
    entries = F.array(
        *[
            F.struct(F.lit(path).alias("path"), F.col(f"`{path.replace('.', '/')}`").alias("n"))
            for path, _ in leaves
        ]
    )
    return totals.select(F.explode(entries).alias("e")).select("e.path", "e.n").where("n > 0").orderBy("path")


def _values(df: DataFrame, field: str) -> Column:
    kind = df.select(F.col(field)).schema[0].dataType
    if isinstance(kind, T.ArrayType):
        return F.array_distinct(F.filter(F.col(field), lambda v: v.isNotNull()))
    return F.when(F.col(field).isNotNull(), F.array(F.col(field)))


def facet(df: DataFrame, field: str, size: int | None = None) -> DataFrame:
    """(key, doc_count): a record counts once per value. ``size``: the most frequent ones only."""
    values = df.select(F.explode(_values(df, field)).alias("key"))
    buckets = values.groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"))
    return top_k(buckets, size) if size else buckets


def top_k(buckets: DataFrame, k: int) -> DataFrame:
    return buckets.orderBy(F.desc("doc_count"), F.asc("key")).limit(k)


def facet_scoped(df: DataFrame, field: str, part: str, size: int | None = None) -> DataFrame:
    """Buckets of one vocabulary only, e.g. ids that contain ``subjects#``."""
    values = df.select(F.explode(_values(df, field)).alias("key")).where(F.col("key").contains(part))
    buckets = values.groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"))
    return top_k(buckets, size) if size else buckets


def facet_labelled(buckets: DataFrame, labels: DataFrame, selected: Sequence[str] = (), by_label: bool = False) -> DataFrame:
    """Labelled buckets: no label or a URI as label drops the bucket; selected ones come first."""
    named = buckets.join(labels.select(F.col("k").alias("_k"), F.col("v").alias("label")), F.col("key") == F.col("_k")).drop("_k")
    shown = named.where((F.col("label") != "") & ~F.col("label").contains("http") & ~F.col("label").contains("_:"))
    chosen = F.col("key").isin(*selected) if selected else F.lit(False)
    rest = [german(F.col("label"))] if by_label else [F.desc("doc_count"), F.asc("key")]
    return shown.withColumn("selected", chosen).orderBy(F.desc("selected"), *rest)


def facet_panel(df: DataFrame, fields: dict[str, str], size: int | None = None) -> DataFrame:
    """All facets in one pass over the records: (facet, key, doc_count).

    ``size`` keeps the most frequent values per facet. The counts are small by then: one row per
    different value.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("facet"),
                F.transform(_values(df, field), lambda v: v.cast("string")).alias("keys"),
            )
            for name, field in fields.items()
        ]
    )
    values = (
        df.select(F.explode(entries).alias("e")).select("e.facet", F.explode("e.keys").alias("key"))
    )
    counts = values.groupBy("facet", "key").agg(F.count(F.lit(1)).alias("doc_count"))
    if size is None:
        return counts
    # The row limit is applied in each task before the shuffle, so a facet with very many values sends
    # at most ``size`` rows per task.
    order = Window.partitionBy("facet").orderBy(F.desc("doc_count"), F.asc("key"))
    return counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_n")


def total_hits(df: DataFrame, field: str | None = None, value=None) -> DataFrame:
    hits = df if field is None else df.where(F.array_contains(_values(df, field), value))
    return hits.agg(F.count(F.lit(1)).alias("total"))


def node_hits(concepts: DataFrame, df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Records per concept, own id only, 0 where there is none. Several id fields are summed."""
    values = F.flatten(F.array(*[F.coalesce(_values(df, f), F.array().cast("array<string>")) for f in fields]))
    counts = df.select(F.explode(values).alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = concepts.join(counts, F.col("id") == F.col("_id"), "left")
    return joined.withColumn("hits", F.coalesce("_n", F.lit(0).cast("bigint"))).drop("_id", "_n")


def topics(df: DataFrame, field: str, query: str) -> DataFrame:
    """Subject labels with counts for a topic search, in German order.

    A trailing ``(12,34)`` is cut; kept are labels with any query word that do not start with ``:`` or
    ``.``. Labels that become equal show once (the most frequent one counts).
    """
    counts = facet(df, field)
    label = F.regexp_replace("key", r"\([\d,]+\)$", "")
    asked = [w.lower() for w in query.replace("-", " ").split(" ")]
    wanted = F.lit(False)
    for word in asked:
        wanted = wanted | F.lower(F.trim("label")).contains(word)
    kept = counts.select(label.alias("label"), "doc_count").where(
        wanted & ~F.col("label").startswith(":") & ~F.col("label").startswith(".")
    )
    return kept.groupBy("label").agg(F.max("doc_count").alias("doc_count")).orderBy(german(F.col("label")), "label")


def main_headings(authorities: DataFrame, df: DataFrame, field: str, query: str, more_than: int = 5, size: int = 3) -> DataFrame:
    """Authorities (id, label, variants) with the query as a variant, the most used ones."""
    asked = F.lower(F.lit(query))
    known = authorities.where(F.exists("variants", lambda v: F.lower(v) == asked)).select("id", "label")
    hits = facet(df, field).withColumnRenamed("key", "_id")
    found = known.join(hits, F.col("id") == F.col("_id")).where(F.col("doc_count") > more_than)
    return (
        found.where(F.lower("label") != asked)
        .select("id", "label", "doc_count")
        .orderBy(F.desc("doc_count"), F.asc("id"))
        .limit(size)
    )


def year_histogram(df: DataFrame, year: Column, lowest: int = 1400, highest: int | None = None) -> DataFrame:
    """(year, n) without gaps between the first and the last year found."""
    last = F.year(F.current_date()) if highest is None else F.lit(highest)
    counts = (
        df.select(year.cast("int").alias("year"))
        .where(F.col("year").between(F.lit(lowest), last))
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    span = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", "b")).alias("_y"))
    joined = every.join(counts, F.col("_y") == F.col("year"), "left")
    return joined.select(F.col("_y").alias("year"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def range_sum(histogram: DataFrame, first: int, last: int) -> DataFrame:
    return histogram.where(F.col("year").between(first, last)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def place_counts(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(lat, lon).agg(F.count(F.lit(1)).alias("n"))


def holdings_by_library(df: DataFrame, id_col: str, items: str) -> DataFrame:
    """Per record and library: number of items and their URIs; ISIL is the third part of the URI.

    The item list of a record is in its row, so libraries are split off there, without a shuffle.
    """
    def isil(uri: Column) -> Column:
        return F.get(F.split(uri, ":"), F.lit(2))

    usable = F.filter(items, lambda u: isil(u).isNotNull())
    rows = df.select(id_col, usable.alias("_items")).withColumn(
        "_libraries", F.array_distinct(F.transform("_items", isil))
    )
    return rows.select(
        id_col, F.size("_libraries").alias("libraries"), "_items", F.explode("_libraries").alias("isil")
    ).select(
        id_col, "isil", "libraries", F.expr("filter(_items, u -> split(u, ':')[2] = isil)").alias("items")
    ).withColumn("n_items", F.size("items"))


def chain_labels(components: Column, label: str = "label") -> Column:
    """Labels of a heading chain in order; empty labels are left out."""
    labels = F.transform(components, lambda c: c[label])
    return F.array_join(F.filter(labels, lambda v: v.isNotNull() & (v != "")), " | ")


def subject_labels(subjects: Column) -> Column:
    """Labels of uncoded concepts and of chain components, each once, in order.

    ``subjects``: list of (type, label, notation, component_labels).
    """
    per_subject = F.transform(
        subjects,
        lambda s: F.concat(
            F.when((s["type"] == "Concept") & s["notation"].isNull(), F.array(s["label"])).otherwise(
                F.array().cast("array<string>")
            ),
            F.coalesce(s["component_labels"], F.array().cast("array<string>")),
        ),
    )
    return F.array_distinct(F.filter(F.flatten(per_subject), lambda v: v.isNotNull()))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()
