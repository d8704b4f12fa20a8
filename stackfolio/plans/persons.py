"""Person records: tagged lines to catalogue entries, entries to linked persons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import compact_to_iso, dotted_to_iso
from ..functions.identifiers import field_uri, place_uri, profession_uri
from ..functions.rows import rows_of
from ..functions.text import absent_if_empty
from ..naming import Namespaces
from ..operators.lookup import lookup, unique_keys, unique_rows
from ..operators.shape import vacuum
from .labels import Vocabularies, one_each
from .legacy_titles import by_name, tag_value, tag_values
from .resolver import chained, each, entry, resolve

# List fields, text groups and flags of a tagged person record.
LIST_FIELDS = {
    "#1nc": "variant_name", "#1nd": "other_name", "#1nn": "profession", "#1no": "place_of_activity",
    "#1nt": "related_person", "#1nu": "publication", "#1nw": "subject_category", "#1nx": "source",
}
TEXT_GROUPS = ["#1z?", "#1ü?", "#1ä?", "#1ö?", "#1ß?"]
FLAGS = {
    "#11 ": "consent_given", "#12 ": "do_delete", "#13 ": "do_not_crawl", "#14 ": "do_not_index",
    "#15 ": "do_not_feature",
}
NO_AUTHORITY = "Keine GND-Ansetzung"
GENDERS = {"männlich": ("male", "Männlich"), "weiblich": ("female", "Weiblich")}
UNKNOWN_GENDER = ("notKnown", "Unbekannt")


def at_list(tag: str) -> Column:
    """All parts of the ``@``-separated fields of one tag."""
    return F.flatten(F.transform(tag_values(tag), lambda v: F.split(v, "@")))


def biography(groups: list[str] = TEXT_GROUPS) -> Column:
    """Numbered text fields of a group are one text, its parts are paragraphs."""
    texts = F.array(*[absent_if_empty(F.array_join(tag_values(g), "\n\n")) for g in groups])
    return F.filter(texts, lambda t: t.isNotNull())


def gender_word(value: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(value, "^w+$", "weiblich"), "^m+$", "männlich"), "^d+$", "divers"
    )


def legacy_persons(
    records: DataFrame, ns: Namespaces = Namespaces(), old_new: DataFrame | None = None
) -> DataFrame:
    """(rec_id, segments) → one catalogue-entry row per person. Only ``old_new`` (k, v) is a join."""
    text = tag_value
    given = text("#82b")
    placeholder = F.concat(F.lit(f"{NO_AUTHORITY} für "), "rec_id")
    none_given = given.isNull() | given.rlike("^(?:Familienmitglied|Keine GND-Ansetzung)$")
    authority = F.when(none_given, placeholder).otherwise(F.regexp_replace(given, r"(\d+)n(\d)", "$1-$2"))
    lists = {name: at_list(tag) for tag, name in LIST_FIELDS.items()}
    lists["profession"] = F.transform(lists["profession"], lambda v: profession_uri(v, ns))
    lists["place_of_activity"] = F.transform(lists["place_of_activity"], lambda v: place_uri(v, ns))
    lists["subject_category"] = F.transform(lists["subject_category"], lambda v: field_uri(v, ns))
    lists["related_person"] = F.transform(
        lists["related_person"], lambda v: F.when(v.rlike("^_.+"), F.regexp_replace(v, "_", "")).otherwise(v)
    )
    out = by_name(records).select(
        F.col("rec_id").alias("local_id"),
        authority.alias("authority_id"),
        *[text(tag).isNotNull().alias(name) for tag, name in FLAGS.items()],
        text("#1na").alias("preferred_name"),
        text("#1ne").alias("depiction_id"),
        gender_word(text("#1nv")).alias("gender"),
        text("#1np").alias("date_of_birth"),
        place_uri(text("#1nq"), ns).alias("place_of_birth"),
        text("#1nr").alias("date_of_death"),
        place_uri(text("#1ns"), ns).alias("place_of_death"),
        compact_to_iso(text("#1ny")).alias("date_modified"),
        text("#1wz").alias("period_of_activity"),
        text("#98 ").alias("internal_note"),
        biography().alias("biography"),
        *[value.alias(name) for name, value in lists.items()],
    )
    if old_new is not None:
        out = lookup(out, "authority_id", old_new)
    return vacuum(out)


def clean_name(value: Column) -> Column:
    """Heading without life dates, sorting marks and outer blanks."""
    bare = F.regexp_replace(value, r"\/\s(ca\.|um)?-?\s?\d.+$", "")
    return F.trim(F.regexp_replace(bare, "¬", ""))


def gender_concept(value: Column, ns: Namespaces = Namespaces()) -> Column:
    def concept(code: str, label: str) -> Column:
        return F.struct(F.lit(ns.gender + code).alias("id"), F.lit(label).alias("label"))

    out = F.when(F.lit(False), concept(*UNKNOWN_GENDER))
    for word, names in GENDERS.items():
        out = out.when(value == word, concept(*names))
    return F.array(out.otherwise(concept(*UNKNOWN_GENDER)))


def person_uri(local_id: Column, authority_id: Column, ns: Namespaces = Namespaces()) -> Column:
    known = authority_id.isNotNull() & ~authority_id.contains(NO_AUTHORITY)
    return F.when(known, F.concat(F.lit(ns.authority), authority_id)).otherwise(F.concat(F.lit(ns.person), local_id))


def place_references(persons: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(local_id, role, pos, value) from single or list columns."""
    kinds = {f.name: f.dataType.typeName() for f in persons.schema.fields}
    entries = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                (F.col(c) if kinds[c] == "array" else F.filter(F.array(c), lambda v: v.isNotNull())).alias("values"),
            )
            for role, c in roles.items()
        ]
    )
    return (
        persons.select("local_id", F.explode(entries).alias("e"))
        .select("local_id", "e.role", F.posexplode("e.values").alias("pos", "value"))
    )


def place_labels(references: DataFrame, places: DataFrame, more_places: DataFrame) -> DataFrame:
    """Label of each place reference: spatial tree, then place table; other text is its own label."""
    first = unique_keys(places).select(F.col("k").alias("_k1"), F.col("v").alias("_v1"))
    second = unique_keys(more_places).select(F.col("k").alias("_k2"), F.col("v").alias("_v2"))
    is_uri = F.col("value").rlike("^http.+")
    step = references.join(first, is_uri & (F.col("value") == F.col("_k1")), "left").withColumn(
        "_l1", F.coalesce("_v1", "value")
    )
    step = step.join(second, is_uri & (F.col("_l1") == F.col("_k2")), "left")
    return step.select(*references.columns, F.coalesce("_v2", "_l1").alias("label"))


def regroup(labelled: DataFrame, roles: list[str]) -> DataFrame:
    """(local_id, role, pos, value, label) → one row per person with a list of (id, label) per role.

    The rows of a person came from one row, so a group is not larger than that row was.
    """
    def listed(role: str) -> Column:
        pairs = F.collect_list(F.when(F.col("role") == role, F.struct("pos", F.col("value").alias("id"), "label")))
        return F.transform(F.array_sort(pairs), lambda p: F.struct(p["id"].alias("id"), p["label"].alias("label"))).alias(role)

    return labelled.groupBy("local_id").agg(*[listed(r) for r in roles])


def professions(persons: DataFrame, vocab: Vocabularies) -> DataFrame:
    """(local_id, pos, id, label, alt_label[]): label by local headings, then by the authority file."""
    rows = rows_of(persons, ["local_id"], "profession", "id", "pos").withColumn(
        "_key", F.regexp_replace("id", r"^http.+/(\d.+)", "$1")
    )
    local = one_each(vocab.headings).select(F.col("k").alias("_k1"), F.col("label").alias("_l1"), F.col("variants").alias("_variants"))
    names = one_each(vocab.authorities).select(F.col("k").alias("_k2"), F.col("label").alias("_l2"))
    step = rows.join(local, F.col("_key") == F.col("_k1"), "left").withColumn("_n", F.coalesce("_l1", "_key"))
    step = step.join(names, F.col("_n") == F.col("_k2"), "left")
    return step.select(
        "local_id", "pos", "id", F.coalesce("_l2", "_n").alias("label"), F.split("_variants", "; ").alias("alt_label")
    )


def subject_categories(persons: DataFrame, categories: DataFrame, ns: Namespaces = Namespaces()) -> DataFrame:
    """(local_id, pos, id, label): known codes get their public URI, others the local one."""
    rows = rows_of(persons, ["local_id"], "subject_category", "value", "pos").withColumn(
        "_code", F.regexp_replace("value", r"^http.+/n?(\d.*)", "$1")
    )
    known = unique_keys(categories).select(F.col("k").alias("_k"), F.col("v").alias("label"))
    joined = rows.join(known, F.col("_code") == F.col("_k"), "left")
    prefix = F.when(F.col("label").isNotNull(), ns.subject_category).otherwise(ns.field)
    return joined.select("local_id", "pos", F.concat(prefix, "_code").alias("id"), "label")


def related_labels(persons: DataFrame, authorities: DataFrame, own_labels: DataFrame) -> DataFrame:
    """(local_id, pos, id, label): other persons by the authority file, then by the own set."""
    rows = rows_of(persons, ["local_id"], "related_person", "id", "pos")
    is_uri = F.col("id").rlike("^http.+")
    rows = rows.withColumn("_key", F.when(is_uri, F.regexp_replace("id", r"^http.+/([p\d].+)", "$1")))
    a = unique_rows(authorities, "k", ["label"]).select(F.col("k").alias("_k1"), F.col("label").alias("_l1"))
    b = unique_keys(own_labels).select(F.col("k").alias("_k2"), F.col("v").alias("_l2"))
    step = rows.join(a, F.col("_key") == F.col("_k1"), "left").withColumn("_n", F.coalesce("_l1", "_key"))
    step = step.join(b, F.col("_n") == F.col("_k2"), "left")
    label = F.regexp_replace(F.coalesce("_l2", "_n", "id"), "¬", "")
    return step.select("local_id", "pos", "id", label.alias("label"))


def linked_persons(persons: DataFrame, ns: Namespaces = Namespaces(), keep: Sequence[str] = ()) -> DataFrame:
    """The part of a linked person that needs no lookup, and the columns ``keep`` as they are.

    Expected columns are those of ``legacy_persons``. For whole records see ``whole_persons``.
    """
    def single(value: Column) -> Column:
        return F.filter(F.array(value), lambda v: v.isNotNull())

    rows = persons.where(~F.coalesce("do_not_index", F.lit(False)))
    names = F.concat(
        F.coalesce("variant_name", F.array().cast("array<string>")),
        F.coalesce("other_name", F.array().cast("array<string>")),
    )
    return vacuum(
        rows.select(
            F.lit(ns.person_context).alias("context"),
            person_uri(F.col("local_id"), F.col("authority_id"), ns).alias("id"),
            "local_id",
            "authority_id",
            F.array(F.lit("AuthorityResource"), F.lit("Person"), F.lit("DifferentiatedPerson")).alias("type"),
            clean_name(F.col("preferred_name")).alias("preferred_name"),
            F.array_distinct(names).alias("variant_name"),
            gender_concept(F.col("gender"), ns).alias("gender"),
            single(dotted_to_iso(F.col("date_of_birth"))).alias("date_of_birth"),
            single(dotted_to_iso(F.col("date_of_death"))).alias("date_of_death"),
            single(dotted_to_iso(F.col("period_of_activity"))).alias("period_of_activity"),
            "publication",
            F.col("biography").alias("biographical_information"),
            F.struct(F.col("date_modified").alias("date_modified"), F.col("source").alias("source")).alias("described_by"),
            *keep,
        )
    )


@dataclass(frozen=True)
class PersonVocabularies:
    """Tables of ``resolver.vocabulary`` for person records; ``feeds`` are (k, url, label), in their order.

    Places, professions and persons are looked up in two tables in turn.
    """

    places: DataFrame
    more_places: DataFrame
    headings: DataFrame
    authorities: DataFrame
    categories: DataFrame
    persons: DataFrame
    own_persons: DataFrame
    images: DataFrame
    feeds: Sequence[DataFrame] = ()


def whole_persons(persons: DataFrame, vocab: PersonVocabularies, ns: Namespaces = Namespaces()) -> DataFrame:
    """Whole linked persons: ``linked_persons`` with labels of all places, professions, categories and
    relations, images and links to other sites. All lookups are one join (see ``resolver``).

    Places and persons that are no address are their own label; codes of unknown categories get the
    local address; a profession keeps its code as label if nothing is known.
    """
    raw = ["place_of_birth", "place_of_death", "place_of_activity", "profession", "subject_category", "related_person"]
    rows = linked_persons(persons, ns, raw)
    is_uri = lambda v: v.rlike("^http.+")
    alone = lambda v: F.filter(F.array(v), lambda x: x.isNotNull())
    places = {"place_of_birth": alone(F.col("place_of_birth")), "place_of_death": alone(F.col("place_of_death")), "place_of_activity": F.col("place_of_activity")}
    code = {
        "profession": lambda v: F.regexp_replace(v, r"^http.+/(\d.+)", "$1"),
        "subject_category": lambda v: F.regexp_replace(v, r"^http.+/n?(\d.*)", "$1"),
        "related_person": lambda v: F.when(is_uri(v), F.regexp_replace(v, r"^http.+/([p\d].+)", "$1")),
    }
    asked = {name: ("place", F.transform(listed, lambda v: F.when(is_uri(v), v))) for name, listed in places.items()}
    asked |= {name: (name, F.transform(F.col(name), read)) for name, read in code.items()}
    asked |= {"image": ("image", F.array("authority_id"))}
    asked |= {f"feed{i}": (f"feed{i}", F.array("authority_id")) for i in range(len(vocab.feeds))}
    tables = {
        "place": chained(vocab.places, vocab.more_places), "profession": chained(vocab.headings, vocab.authorities),
        "subject_category": vocab.categories, "related_person": chained(vocab.persons, vocab.own_persons), "image": vocab.images,
    } | {f"feed{i}": feed for i, feed in enumerate(vocab.feeds)}
    rows = resolve(rows, "local_id", asked, tables)

    def labelled(value: Column, e: Column) -> Column:
        return F.struct(value.alias("id"), F.coalesce(e["label"], value).alias("label"))

    def profession(value: Column, e: Column) -> Column:
        label = F.coalesce(e["label"], code["profession"](value))
        return F.struct(value.alias("id"), label.alias("label"), F.split(e["variants"], "; ").alias("alt_label"))

    def category(value: Column, e: Column) -> Column:
        prefix = F.when(e["label"].isNotNull(), ns.subject_category).otherwise(ns.field)
        return F.struct(F.concat(prefix, code["subject_category"](value)).alias("id"), e["label"].alias("label"))

    def relation(value: Column, e: Column) -> Column:
        label = F.coalesce(e["label"], code["related_person"](value), value)
        return F.struct(value.alias("id"), F.regexp_replace(label, "¬", "").alias("label"))

    image = entry("image", 0)
    depiction = F.struct(image["label"].alias("id"), image["url"].alias("url"), image["detail"].alias("thumbnail"))
    links = [entry(f"feed{i}", 0) for i in range(len(vocab.feeds))]
    same_as = [
        F.when(e["url"].isNotNull(), F.struct(e["url"].alias("id"), F.struct(e["label"].alias("name")).alias("collection"))) for e in links
    ]
    out = {name: each(listed, name, labelled) for name, listed in places.items()}
    out |= {name: each(F.col(name), name, make) for name, make in zip(code, (profession, category, relation))}
    out["depiction"] = F.when(image.isNotNull(), F.array(depiction))
    if same_as:
        out["same_as"] = F.filter(F.array(*same_as), lambda x: x.isNotNull())
    return vacuum(rows.select(*[c for c in rows.columns if c not in (*out, "found")], *[c.alias(n) for n, c in out.items()]))
