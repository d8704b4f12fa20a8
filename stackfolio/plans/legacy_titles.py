"""Tagged title records to catalogue-entry records (the form in which editors keep them)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import agent_uri, heading_uri, spatial_uri, subject_uri
from ..functions.text import absent_if_empty, around, paste
from ..naming import Namespaces

# Role of a person or body by field, in field order.
PERSON_ROLES = {
    "#40?": "Verfasser/in",
    "#41?": "Herausgeber/in",
    "#42?": "Mitwirkung",
    "#43?": "Herausgeber/in",
    "#44?": "Begründer/in eines Werks",
    "#45?": "Sammler/in",
    "#46?": "Libretto",
    "#47?": "Übersetzer/in",
    "#50?": "Illustrator/in",
    "#51?": "Verfasser/in von ergänzendem Text",
    "#52?": "Komponist/in",
    "#56?": "Herausgeber/in",
    "#57?": "Sonstige",
    "#58?": "Performer/in",
    "#59?": "Gefeierte Person",
}
# (#60e holds a redundant older form of the name)
BODY_ROLES = {
    "#60[ 0123456789abcdfghijklmnopqrstuvwxyz]": "Geistiger Schöpfer",
    "#61?": "Herausgebendes Organ",
    "#69?": "Gefeierte Körperschaft",
}
# Titles kept, type names, item places, link types, filler texts.
TYPE_NAMES = {"s": "Monografie", "sm": "Mehrt. Mono (ÜO)", "sbd": "Band"}
ITEM_PLACES = {"#90a": "MZ", "#90b": "SP", "#90c": "TR", "#90d": "KO"}
URL_KINDS = {"#90e": "Volltext", "#90f": "Andere URL", "#90g": "Andere URL"}
URL_PATTERN = r"^(?:(https?|ftp)://(\S+\.)+\S+(/\S*)?)?$"
PAGES_PATTERN = r"^.*(S(?:\.|eiten?)\s+\d+(?:\s*-\s*\d+)?).*$"
SEE_NUMBERING = "s. Zählung in numbering"
SEE_PARTS = "s. spez. Felder (volume, issue, etc.)"
NOT_GIVEN = "N/A"
TYPED = "array<struct<value:string,type:string>>"


@dataclass(frozen=True)
class CollectionNames:
    """How editors mark the two collections of a title."""

    both: str = "beide"
    first: str = "nur erste"
    second: str = "nur zweite"


def by_name(records: DataFrame) -> DataFrame:
    """Add the names of the fields of a record (``names``) and their first three characters (``stems``).

    A rule looks up a name in these lists, and goes through the fields only when it is there. The lists
    come out of a generator, so that later filters stay above it; pushed below, they would decode again.
    """
    first = lambda n: F.expr(f"transform(segments, s -> substring(s, 1, {n}))")
    return records.select("*", F.inline_outer(F.array(F.struct(first(4).alias("names"), first(3).alias("stems")))))


def _places(pattern: str) -> list[str]:
    rest, places = pattern[1:], []
    while rest:
        end = rest.index("]") + 1 if rest[0] == "[" else 1
        places.append(rest[:end])
        rest = rest[end:]
    return [pattern[0], *places]


def _chosen(pattern: str) -> list[tuple[str, str]]:
    """SQL of each stem of the pattern: whether its fields can be there, and their values."""
    head, first, second, last = _places(pattern)
    out = []
    for a in first.strip("[]"):
        for b in second.strip("[]"):
            stem = f"{head}{a}{b}"
            letters = last.strip("[]")
            there, test = f"array_contains(stems, '{stem}')", f"startswith(s, '{stem}')"
            if last != "?" and len(letters) == 1:
                there, test = f"array_contains(names, '{stem}{letters}')", f"startswith(s, '{stem}{letters}')"
            elif last != "?":
                test = "substring(s, 1, 4) IN (" + ", ".join(f"'{stem}{x}'" for x in letters) + ")"
            out.append((there, f"transform(filter(segments, s -> {test}), s -> substring(s, 5))"))
    return out


def tag_values(pattern: str) -> Column:
    """Values of the fields whose name matches (``#40?``, ``#2[37]?``, ``#90e``), in document order."""
    parts = [f"IF({there}, {listed}, cast(array() as array<string>))" for there, listed in _chosen(pattern)]
    return F.expr(parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})")


def tag_value(tag: str) -> Column:
    """The first value; of a whole name without going through the fields."""
    if len(tag) == 4 and "?" not in tag:
        return F.expr(f"substring(get(segments, cast(array_position(names, '{tag}') AS int) - 1), 5)")
    return F.get(tag_values(tag), F.lit(0))


def each_value(pattern: str, make, kind: str) -> Column:
    """List of type ``kind`` made of each value; nothing is gone through where no field has the name."""
    none = F.array().cast(kind)
    parts = [F.when(F.expr(there), F.transform(F.expr(listed), make)).otherwise(none) for there, listed in _chosen(pattern)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def series_parts(value: Column) -> Column:
    """``title ; number`` → (value, numbering): first and last part."""
    parts = F.split(value, " ; ")
    split = value.contains(" ; ")
    return F.struct(
        F.when(split, F.get(parts, F.lit(0))).otherwise(value).alias("value"),
        F.when(split, F.element_at(parts, -1)).alias("numbering"),
    )


def by_role(roles: dict[str, str], ns: Namespaces) -> Column:
    def typed(pattern: str, role: str) -> Column:
        return each_value(pattern, lambda v: F.struct(agent_uri(v, ns).alias("value"), F.lit(role).alias("type")), TYPED)

    return F.concat(*[typed(pattern, role) for pattern, role in roles.items()])


def typed_values(kinds: dict[str, str]) -> Column:
    """All values of the given fields, each with the kind that its field stands for."""

    def typed(tag: str, kind: str) -> Column:
        return each_value(tag, lambda v: F.struct(v.alias("value"), F.lit(kind).alias("type")), TYPED)

    return F.concat(*[typed(tag, kind) for tag, kind in kinds.items()])


def citation_text(volume: Column, issue: Column, year: Column, pages: Column, extra: Column) -> Column:
    """Source statement of an article from its parts."""
    k, t = absent_if_empty(F.col("host_author")), F.col("host_title")
    text = paste("In: ", k, ": ", t, ". - ", volume, " (", year, "), ", issue, extra, ", Seite ", pages, ". -", sep="")
    text = F.regexp_replace(text, "In: : ", "In: ")
    text = F.regexp_replace(text, r", Seite . -$", "")
    text = F.regexp_replace(text, "  ", " ")
    return F.regexp_replace(text, ", , ", ", ")


def legacy_titles(
    records: DataFrame, ns: Namespaces = Namespaces(), names: CollectionNames = CollectionNames(),
    union_ids: DataFrame | None = None, second_collection_mark: str = "w",
) -> DataFrame:
    """(rec_id, segments) of ``sources.split_volumes`` → one catalogue-entry row per record.

    All of it is work inside the row; only ``union_ids`` (k, v), the ids of the union catalogue, is a
    join.
    """
    text = tag_value
    base = by_name(records).select(
        "segments", "names", "stems",
        F.col("rec_id").alias("local_id"),
        text("#01 ").alias("numbering"),
        F.when(text("#36 ") == "um", "u").otherwise(text("#36 ")).alias("kind"),
        F.array_join(tag_values("#20 "), "; ").alias("title"),
        absent_if_empty(F.array_join(tag_values("#70[ 123456789]"), "; ")).alias("source"),
        text("#70b").alias("volume"), text("#70h").alias("issue"), text("#70j").alias("year"),
        text("#70s").alias("pages"), text("#70z").alias("alternative_numbering"),
        text("#70k").alias("host_author"), text("#70t").alias("host_title"),
        F.transform(tag_values("#85?"), series_parts).alias("series"),
    )
    single = F.col("kind").isin("s", "sm", "sbd")
    given_date = F.coalesce(text("#76a"), text("#76b"))

    def dated(value: Column) -> Column:
        filler = F.when(F.col("kind") == "sbd", SEE_NUMBERING).when(single, NOT_GIVEN)
        return F.coalesce(value, filler)

    article = F.coalesce(F.col("kind") == "u", F.lit(False))
    assembled = F.when(
        F.col("host_title").isNotNull(),
        citation_text(F.col("volume"), F.col("issue"), F.col("year"), F.col("pages"), F.col("alternative_numbering")),
    ).otherwise(SEE_PARTS)
    source = F.when(article & F.col("source").isNull(), assembled).otherwise(F.col("source"))
    pages_hint = F.when(
        F.col("source_text").rlike(PAGES_PATTERN),
        F.regexp_replace("source_text", PAGES_PATTERN, "Aus #70~, #701 ff.: $1"),
    ).otherwise(F.concat(F.lit("Kopiert aus #70~, #701 ff.: "), "source_text"))
    number_983 = text("#983")
    union_id = F.when(~F.coalesce(number_983.rlike(r"^\d{4,5}$"), F.lit(True)), number_983)
    chains = F.transform(
        tag_values("#32?"), lambda c: F.transform(F.split(c, " ; "), lambda v: heading_uri(v, ns))
    )
    in_collection = (
        F.when(text("#18 ").isNotNull(), names.both)
        .when(F.col("local_id").contains(second_collection_mark), names.second)
        .otherwise(names.first)
    )
    urls = F.filter(
        typed_values(URL_KINDS),
        lambda u: u["value"].isNotNull() & u["value"].rlike(URL_PATTERN),
    )
    items = F.filter(typed_values(ITEM_PLACES), lambda i: i["value"].isNotNull())
    volume_in = F.when(
        F.col("numbering").isNotNull(),
        F.struct(
            F.concat(F.lit(ns.resource), F.regexp_replace("local_id", r"b\d+", "")).alias("value"),
            F.col("numbering").alias("numbering"),
        ),
    )
    out = base.withColumn("source_text", source).select(
        "local_id",
        union_id.alias("union_id"),
        text("#14 ").isNotNull().alias("do_not_index"),
        in_collection.alias("in_collection"),
        absent_if_empty(F.col("title")).alias("title"),
        text("#21 ").alias("preferred_title"),
        tag_values("#24?").alias("parallel_title"),
        tag_values("#2[37]?").alias("alternative_title"),
        text("#28 ").alias("alternative_spelling"),
        F.coalesce(_type_name(), F.col("kind")).alias("type"),
        F.struct(
            F.col("source_text").alias("value"), F.col("volume"), F.col("issue"), F.col("year"),
            F.when(article, F.coalesce("pages", pages_hint)).otherwise(F.col("pages")).alias("pages"),
            "alternative_numbering",
        ).alias("citation"),
        text("#71 ").alias("edition"),
        text("#74 ").alias("publication_location"),
        text("#75 ").alias("published_by"),
        dated(given_date).alias("publication_date"),
        dated(text("#76b")).alias("publication_year"),
        text("#77 ").alias("extent"),
        tag_values("#81?").alias("note"),
        F.when(single, F.col("series")).alias("in_series"),
        F.when(~F.coalesce(single, F.lit(False)), F.col("series")).alias("is_part_of"),
        text("#20u").alias("superordinate"),
        text("#84 ").alias("schoene_nummer"),
        text("#86 ").alias("other_id"),
        text("#88 ").alias("serial_id"),
        text("#95 ").alias("created"),
        F.transform(tag_values("#30?"), lambda v: subject_uri(v, ns)).alias("subject"),
        F.array_distinct(F.transform(tag_values("#31?"), lambda v: spatial_uri(v, ns))).alias("spatial"),
        chains.alias("heading_chains"),
        F.coalesce(text("#39 "), around("Aus f39x: ", text("#39x"))).alias("responsibility_statement"),
        urls.alias("url"),
        items.alias("item"),
        by_role(PERSON_ROLES, ns).alias("person"),
        by_role(BODY_ROLES, ns).alias("corporate_body"),
        volume_in.alias("volume_in"),
        F.transform(tag_values("#87?"), lambda v: F.struct(v.alias("value"), F.lit(True).alias("valid"))).alias("isbn"),
    )
    if union_ids is None:
        return out
    known = union_ids.select(F.col("k").alias("_k"), F.col("v").alias("_v"))
    joined = out.join(known, F.col("local_id") == F.col("_k"), "left")
    return joined.withColumn("union_id", F.coalesce("union_id", "_v")).drop("_k", "_v")


def _type_name() -> Column:
    name = F.lit(None).cast("string")
    for code, label in TYPE_NAMES.items():
        name = F.when(F.col("kind") == code, label).otherwise(name)
    return name
