"""Local headings, spelling variants, and lookup tables made from whole record sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_other_letters, strip_diacritics
from .legacy_titles import by_name, tag_value, tag_values
from .persons import clean_name

# Heading type by letter.
HEADING_TYPES = {
    "G": "Geografikum", "K": "Körperschaft", "P": "Person", "S": "Sachschlagwort",
    "V": "Veranstaltung", "W": "Werk", "X": "N/A",
}


def heading_type(value: Column) -> Column:
    letter = F.substring(value, 1, 1)
    out = F.lit("N/A")
    for code, label in HEADING_TYPES.items():
        out = F.when(letter == code, label).otherwise(out)
    return out


def authorities(records: DataFrame) -> DataFrame:
    """(rec_id, segments) → local headings; records that have an authority id are left out."""
    local = records.where(~F.exists("segments", lambda s: s.startswith("#82b")))
    return by_name(local).select(
        F.col("rec_id").alias("local_id"),
        tag_value("#3na").alias("preferred_name"),
        tag_value("#3nz").alias("other_information"),
        tag_values("#3n[bcdefghijklmnopqrstuvwxy]").alias("variant_name"),
        tag_values("#3r?").alias("related_entity"),
        heading_type(tag_value("#99z")).alias("type"),
    )


def heading_table(headings: DataFrame) -> DataFrame:
    """(k, label, variants) for lookups and for ``sinks.write_lookup_tsv``."""
    return headings.select(
        F.col("local_id").alias("k"),
        F.regexp_replace("preferred_name", "\n", ";").alias("label"),
        F.regexp_replace(F.array_join("variant_name", "; "), "\n", ";").alias("variants"),
    )


def ascii_variants(headings: DataFrame, id_col: str, name: str, variants: str) -> DataFrame:
    """Records that need a variant without accents: (id, variant list with the new one at its end).

    The new name is computed once, by a generator, for names that are not all ASCII: the optimizer
    moves only the cheap test towards the scan.
    """
    none = F.array().cast("array<string>")
    plain = F.explode(F.array(strip_diacritics(F.col(name)))).alias("_plain")
    found = headings.where(has_other_letters(F.col(name))).select("*", plain).where(F.col("_plain") != F.col(name))
    return found.select(F.col(id_col), F.array_append(F.coalesce(F.col(variants), none), F.col("_plain")).alias(variants))


def build_label_map(
    records: DataFrame, key: str, columns: Sequence[str], used: DataFrame | None = None, list_sep: str = "; "
) -> DataFrame:
    """Lookup table from full records: list columns joined; rows without key, and without any value, out.

    ``used`` (id) restricts a large table to the ids in use.
    """
    kinds = {f.name: f.dataType.typeName() for f in records.schema.fields}
    values = [
        (F.array_join(c, list_sep) if kinds[c] == "array" else F.col(c)).alias(c) for c in columns
    ]
    table = records.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *values)
    some = F.coalesce(*[F.col(c) for c in columns])
    table = table.where(some.isNotNull())
    if used is None:
        return table
    return table.join(used.select(F.col("id").alias("_used")), F.col("k") == F.col("_used"), "left_semi")


def own_person_labels(persons: DataFrame) -> DataFrame:
    """(k, v): cleaned names of persons that no authority file has."""
    return persons.where(F.col("authority_id").contains("Keine")).select(
        F.col("local_id").alias("k"), clean_name(F.col("preferred_name")).alias("v")
    )


def depictions(records: DataFrame) -> DataFrame:
    """(k, thumbnail, id, url) of records with an image (first image of each)."""
    image = F.get("depiction", F.lit(0))
    return records.where(F.size("depiction") > 0).select(
        F.col("authority_id").alias("k"), image["thumbnail"].alias("thumbnail"), image["id"].alias("id"), image["url"].alias("url")
    )
