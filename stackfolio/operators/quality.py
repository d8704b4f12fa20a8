"""Contracts, test subsets, coverage of source paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """``ok`` must hold; NULL counts as failed only for required fields."""

    path: str
    rule: str
    ok: Column


def required(path: str) -> Check:
    return Check(path, "required", F.col(path).isNotNull())


def one_of(path: str, values: Sequence[str], items: Column | None = None) -> Check:
    values = list(values)
    if items is not None:
        return Check(path, "enum", F.forall(items, lambda v: v.isin(*values)))
    return Check(path, "enum", F.col(path).isin(*values))


def constant(path: str, value: str) -> Check:
    return Check(path, "const", F.col(path) == value)


def pattern(path: str, regex: str, items: Column | None = None) -> Check:
    if items is not None:
        return Check(path, "pattern", F.forall(items, lambda v: v.rlike(regex)))
    return Check(path, "pattern", F.col(path).cast("string").rlike(regex))


def uri(path: str) -> Check:
    return Check(path, "uri", F.col(path).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"))


def min_items(path: str, size: int) -> Check:
    return Check(path, "minItems", F.size(path) >= size)


def validate(df: DataFrame, id_col: str, checks: Sequence[Check]) -> DataFrame:
    """Violations (id, path, rule), all checks in one pass."""
    failed = F.array(
        *[
            F.when(
                ~F.coalesce(c.ok, F.lit(c.rule != "required")),
                F.struct(F.lit(c.path).alias("path"), F.lit(c.rule).alias("rule")),
            )
            for c in checks
        ]
    )
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        F.explode(F.filter(failed, lambda f: f.isNotNull())).alias("f"),
    ).select("id", "f.path", "f.rule")


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n"))


# Patterns and type names of the published title contract.
ZDB_ID = r"^\d{1,7}-[Xx\d]$"
OCLC_NUMBER = r"\d{1,14}"
AUTHORITY_ID = r"^(1[012]?\d{7}[0-9X]|[47]\d{6}-\d|[1-9]\d{0,7}-[0-9X]|3\d{7}[0-9X])$"
RESOURCE_TYPES = [
    "BibliographicResource", "ArchivalResource", "ArchivedWebPage", "Book", "Collection", "Periodical",
    "Series", "Newspaper", "Journal", "MultiVolumeBook", "PublicationIssue", "Article", "Miscellaneous",
    "Thesis", "EditedVolume", "Proceedings", "Festschrift", "Bibliography", "OfficialPublication",
    "ReferenceSource", "Statistics", "Legislation", "PublishedScore", "Schoolbook", "Game", "Biography",
    "Report", "Image", "Map", "Standard",
]
AGENT_TYPES = ["ConferenceOrEvent", "CorporateBody", "Person", "PlaceOrGeographicName"]
EVENT_TYPES = ["PublicationEvent", "SecondaryPublicationEvent"]


def title_contract(resource_base: str) -> list[Check]:
    """The checks of a finished title record (columns of ``plans.titles``)."""
    agents = F.transform("contribution", lambda c: c["agent"])
    roles = F.transform("contribution", lambda c: c["role"])
    return [
        required("context"), required("id"), required("type"),
        pattern("id", "^" + resource_base.replace(".", r"\.") + ".+"),
        uri("id"),
        min_items("type", 2),
        one_of("type", RESOURCE_TYPES, items=F.col("type")),
        pattern("zdb_id", ZDB_ID),
        Check("contribution.agent.label", "required", F.forall(agents, lambda a: a["label"].isNotNull())),
        Check("contribution.agent.type", "enum", F.forall(agents, lambda a: F.forall(a["type"], lambda t: t.isin(*AGENT_TYPES)))),
        Check("contribution.role.id", "required", F.forall(roles, lambda r: r["id"].isNotNull())),
        Check("publication.type", "enum", F.forall("publication", lambda p: F.forall(p["type"], lambda t: t.isin(*EVENT_TYPES)))),
        Check("in_collection.type", "const", F.forall("in_collection", lambda c: F.forall(c["type"], lambda t: t == "Collection"))),
    ]


def select_subset(fields: DataFrame, has: tuple[str, str], lacks: str | None = None) -> DataFrame:
    """Ids with a field value and without another field, from a long field table, in one aggregate."""
    tag, value = has
    hit = F.max(F.when((F.col("tag") == tag) & (F.col("value") == value), 1).otherwise(0))
    miss = F.max(F.when(F.col("tag") == lacks, 1).otherwise(0)) if lacks else F.lit(0)
    relevant = [tag] + ([lacks] if lacks else [])
    return (
        fields.where(F.col("tag").isin(*relevant))
        .groupBy("rec_id")
        .agg(hit.alias("_h"), miss.alias("_m"))
        .where("_h = 1 AND _m = 0")
        .select("rec_id")
    )


def coverage(source: DataFrame, target: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source paths, their counts, the target path they map to and its count; unmapped ones as well.

    ``source``/``target``: (path, n); ``mapping``: (source_path, target_path).
    """
    s = source.select(F.col("path").alias("_s"), F.col("n").alias("source_n"))
    t = target.select(F.col("path").alias("_t"), F.col("n").alias("target_n"))
    joined = mapping.join(s, F.col("source_path") == F.col("_s"), "full_outer").join(
        t, F.col("target_path") == F.col("_t"), "full_outer"
    )
    return joined.select(
        F.coalesce("source_path", "_s").alias("source_path"), "source_n",
        F.coalesce("target_path", "_t").alias("target_path"), "target_n",
    )
