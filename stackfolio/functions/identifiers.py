"""Old notations to URIs, and repairs of broken URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..naming import Namespaces

NS = Namespaces()


def bare_code(value: Column) -> Column:
    """``_4252261n4_`` → ``4252261n4``."""
    return F.regexp_replace(value, "_(.*)_", "$1")


def hyphenated(value: Column) -> Column:
    """``4252261n4`` → ``4252261-4``."""
    return F.regexp_replace(value, r"^(\d*)n(\d|X)", "$1-$2")


def with_n(value: Column) -> Column:
    return F.regexp_replace(value, r"^(\d+)-(\d+|X)$", "$1n$2")


def with_hyphen(value: Column) -> Column:
    return F.regexp_replace(value, r"^(\d+)n(\d+|X)$", "$1-$2")


def heading_uri(value: Column, ns: Namespaces = NS) -> Column:
    """Heading chain component: local record or authority file."""
    code = bare_code(value)
    local = code.rlike(r"^(?:(?:00|036n|107n|121n|929n).*|z.*)$")
    return F.when(local, F.concat(F.lit(ns.heading), code)).otherwise(
        F.concat(F.lit(ns.authority), hyphenated(code))
    )


def agent_uri(value: Column, ns: Namespaces = NS) -> Column:
    """Person or body of a title: URI of the id, plain names unchanged; text after the id is dropped."""
    code = bare_code(value)
    uri = (
        F.when(code.rlike("^(?:00|107n|929n)"), F.concat(F.lit(ns.heading), code))
        .when(code.rlike(r"^\d"), F.concat(F.lit(ns.authority), hyphenated(code)))
        .otherwise(code)
    )
    return F.regexp_replace(uri, r":?\s.*", "")


def profession_uri(value: Column, ns: Namespaces = NS) -> Column:
    code = F.regexp_replace(value, "_", "")
    return F.when(
        code.rlike(r"^\d*n\d$"),
        F.concat(F.lit(ns.authority), F.regexp_replace(code, r"^(\d*)n(\d)", "$1-$2")),
    ).otherwise(F.concat(F.lit(ns.heading), code))


def subject_uri(value: Column, ns: Namespaces = NS) -> Column:
    """``_s(n…)_`` → node of the subject tree."""
    return F.regexp_replace(value, r"_sn(\d+)_", ns.subject + "$1")


def field_uri(value: Column, ns: Namespaces = NS) -> Column:
    """``_swn12x2p_`` → ``…n12.2p``."""
    code = F.regexp_replace(F.regexp_replace(value, "_", ""), r"(\d)x(\d)", "$1.$2")
    return F.concat(F.lit(ns.field), F.regexp_replace(code, "^swn", ""))


def place_uri(value: Column, ns: Namespaces = NS) -> Column:
    """Person places: ``_o12345_`` → node of the spatial tree, plain names unchanged."""
    return F.when(
        value.rlike("^_o.+"), F.concat(F.lit(ns.spatial), F.regexp_replace(value, "^_o|_$", ""))
    ).otherwise(value)


def spatial_uri(value: Column, ns: Namespaces = NS) -> Column:
    """Place notation of a title: authority id, numbered place, or region."""
    in_region = r"^_r\d{2}_\s_(\d*)n(\d)_$"
    return (
        F.when(value.rlike(in_region), F.regexp_replace(value, in_region, ns.authority + "$1-$2"))
        .when(value.contains("_r99_"), F.regexp_replace(value, r"^_r99_\s_o(\d+)_$", ns.spatial + "$1"))
        .otherwise(F.regexp_replace(value, r"^_r(\d{2})_$", ns.spatial + "$1"))
    )


def repaired_heading(value: Column, ns: Namespaces = NS) -> Column:
    """``…/2071807nX`` → ``…/2071807-X``."""
    return F.regexp_replace(value, rf"^{ns.authority}([0-9]+)nX$", ns.authority + "$1-X")


def repaired_agent(value: Column, ns: Namespaces = NS) -> Column:
    """``…/121-931350`` is a local heading, not an authority record."""
    return F.regexp_replace(value, rf"^{ns.authority}(\d+?)-(\w{{2,}})$", ns.heading + "$1n$2")


def spatial_candidate(value: Column, ns: Namespaces = NS) -> Column:
    """The tree node that an old place notation or authority URI would have, or NULL."""
    notation = r"^_.+?_ _(.+)_$"
    authority = rf"^{ns.authority}([0-9]+)-([0-9]+|X)$"
    return F.when(
        value.rlike(notation), F.regexp_replace(value, notation, ns.spatial + "$1")
    ).when(value.rlike(authority), F.regexp_replace(value, authority, ns.spatial + "$1n$2"))


def region_of(value: Column, ns: Namespaces = NS) -> Column:
    """``_r30_ _2071807nX_`` → region 30; NULL for other values."""
    pattern = "^_r(.+?)_ _.+_$"
    return F.when(value.rlike(pattern), F.regexp_replace(value, pattern, ns.spatial + "$1"))


def heading_of_place(value: Column, ns: Namespaces = NS) -> Column:
    """The heading that goes with a region notation: ``_r30_ _2071807nX_`` → authority 2071807-X."""
    code = F.regexp_extract(value, r"^_r.+?_ _(.+)_$", 1)
    known = code.rlike(r"^\d+(?:n(?:\d|X))?$")
    return F.when(code == "", F.lit(None)).when(
        known, F.concat(F.lit(ns.authority), F.regexp_replace(code, "n", "-"))
    ).otherwise(F.concat(F.lit(ns.heading), code))


AUTHORITY_ID = (
    r"1[0123]?[0-9]{7}[0-9X]|[47][0-9]{6}[n-][0-9]|[1-9][0-9]{0,7}[n-][0-9X]|3[0-9]{7}[0-9X]"
)
