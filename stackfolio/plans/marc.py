"""Access to the fields of a MARC row (leader, control, data) and combined heading labels.

``prepared`` adds ``tags``, the tags of the data fields in a text, so that a rule goes through the fields only when
its tag is there. Whole-row access is written as SQL text: one expression per call, parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.marcxml import DATA

NO_TEXT = "array<string>"


def no_texts() -> Column:
    return F.expr("cast(array() as array<string>)")


def present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def prepared(records: DataFrame) -> DataFrame:
    """Add ``tags`` (the tags of the data fields as one text), unless it is there."""
    if "tags" in records.columns:
        return records
    return records.withColumn("tags", F.expr("concat('|', array_join(transform(data, d -> d.tag), '|'), '|')"))


def control(tag: str) -> Column:
    return F.expr(f"get(filter(control, c -> c.tag = '{tag}'), 0).value")


def controls(tag: str) -> Column:
    return F.expr(f"transform(filter(control, c -> c.tag = '{tag}'), c -> c.value)")


def _indicator(name: str, spec: str) -> list[str]:
    if spec == "?":
        return []
    listed = ", ".join(f"'{c}'" for c in spec.strip("[]"))
    return [f"d.{name} IN ({listed})"]


def _parts(spec: str) -> tuple[str, str, str]:
    """``264[ 23][ 1]`` → tag and the two indicator tests."""
    rest, tests = spec[3:], []
    while rest:
        end = rest.index("]") + 1 if rest[0] == "[" else 1
        tests.append(rest[:end])
        rest = rest[end:]
    first, second = (tests + ["?", "?"])[:2]
    return spec[:3], first, second


def fields_sql(spec: str) -> str:
    """Fields whose tag and indicators match one of the ``|``-separated patterns, in document order."""
    options = [_parts(one) for one in spec.split("|")]
    if len({tag for tag, _, _ in options}) > 1:
        tests = [
            " AND ".join([f"d.tag = '{tag}'", *_indicator("ind1", a), *_indicator("ind2", b)]) for tag, a, b in options
        ]
        return f"filter(data, d -> ({') OR ('.join(tests)}))"
    tag = options[0][0]
    tests = [" AND ".join([*_indicator("ind1", a), *_indicator("ind2", b)]) for _, a, b in options]
    test = f"d.tag = '{tag}'" + ("" if "" in tests else f" AND (({') OR ('.join(tests)}))")
    return f"IF(contains(tags, '|{tag}|'), filter(data, d -> {test}), cast(array() as {DATA}))"


def subs_sql(field: str, codes: str) -> str:
    test = f"s.code = '{codes}'" if len(codes) == 1 else "s.code IN (" + ", ".join(f"'{c}'" for c in codes) + ")"
    return f"transform(filter({field}.subs, s -> {test}), s -> s.value)"


def _name(code: str) -> str:
    """Struct names do not tell upper from lower case, so upper-case codes get another prefix."""
    return f"u{code.lower()}" if code.isupper() else f"s{code}"


def fields(spec: str, codes: str) -> Column:
    """Matching fields as structs: tag, first indicator, and one value list per subfield code."""
    lists = ", ".join(f"{subs_sql('d', c)} AS {_name(c)}" for c in codes)
    return F.expr(f"transform({fields_sql(spec)}, d -> struct(d.tag AS tag, d.ind1 AS ind1, {lists}))")


def has_field(spec: str) -> Column:
    return F.expr(f"size({fields_sql(spec)}) > 0")


def subs(d: Column, code: str) -> Column:
    """Values of one subfield of an entry of ``fields``."""
    return d[_name(code)]


def sub(d: Column, code: str) -> Column:
    return F.get(d[_name(code)], F.lit(0))


def values(spec: str, codes: str) -> Column:
    """Values of the subfields with one of the codes, in document order."""
    return F.expr(f"flatten(transform({fields_sql(spec)}, d -> {subs_sql('d', codes)}))")


def value(spec: str, code: str) -> Column:
    return F.get(values(spec, code), F.lit(0))


def each(spec: str, codes: str, make) -> Column:
    return F.transform(fields(spec, codes), make)


def code_at(text: Column, place: int) -> Column:
    return F.substring(text, place + 1, 1)


def record_kind() -> Column:
    """Leader 06 and 07."""
    return F.substring("leader", 7, 2)


def without_brackets(text: Column) -> Column:
    return F.regexp_replace(text, "<<|>>", "")


# --- heading labels ---------------------------------------------------------------------------

# Order of the subfields of a label.
PERSON_CODES, EVENT_CODES, OTHER_CODES = "abcgxt", "abngdct", "apbcfgnxtz"


def _joined(d: Column, codes: str, sep: str) -> Column:
    """All values of the codes, code by code."""
    return F.array_join(F.concat(*[subs(d, c) for c in codes]), sep)


def _more(d: Column, code: str, before: str, after: str = "") -> Column:
    return F.concat(F.lit(before), sub(d, code), F.lit(after))


def person_label(d: Column) -> Column:
    """``name number, title (extra) / part: work``"""
    return F.concat_ws(
        "", _joined(d, "ab", " "), _more(d, "c", ", "), _more(d, "g", " (", ")"), _more(d, "x", " / "), _more(d, "t", ": ")
    )


def event_label(d: Column) -> Column:
    """``name. part (number : extra : date : place): work``"""
    details = F.nullif(_joined(d, "ngdc", " : "), F.lit(""))
    return F.concat_ws("", _joined(d, "ab", ". "), F.concat(F.lit(" ("), details, F.lit(")")), _more(d, "t", ": "))


def other_label(d: Column) -> Column:
    """``name. part. subunit, c (f) (g), n / x: t (z)``"""
    return F.concat_ws(
        "", _joined(d, "apb", ". "), _more(d, "c", ", "), _more(d, "f", " (", ")"), _more(d, "g", " (", ")"),
        _more(d, "n", ", "), _more(d, "x", " / "), _more(d, "t", ": "), _more(d, "z", " (", ")"),
    )


LABELS = {"person": (person_label, PERSON_CODES), "event": (event_label, EVENT_CODES), "other": (other_label, OTHER_CODES)}


def union_codes(*codes: str) -> str:
    return "".join(dict.fromkeys("".join(codes)))


# --- authority ids ----------------------------------------------------------------------------

AUTHORITY = r"^\(DE-588\)(.+)$"
ID_CODES = "0B"


def authority_number(d: Column) -> Column:
    """Id of subfield 0 in the public authority file, X in upper case; the last one counts."""
    hits = F.filter(subs(d, "0"), lambda v: v.rlike(AUTHORITY))
    return F.regexp_extract(F.upper(F.try_element_at(hits, F.lit(-1))), AUTHORITY, 1)


def record_number(d: Column) -> Column:
    """Internal authority record number: subfield B, else out of subfield 0."""
    from_zero = F.transform(
        subs(d, "0"),
        lambda v: F.when(v.rlike(r"^.*DNB\|(.*)$"), F.regexp_replace(v, r"^.*DNB\|(.*)$", "GND-$1")).when(
            v.rlike(r"^\(DE-101\)(.+)$"), F.regexp_replace(v, r"^\(DE-101\)(.+)$", "GND-$1")
        ),
    )
    return F.coalesce(sub(d, "B"), F.try_element_at(present(from_zero), F.lit(-1)))


def variant_entries(specs: list[tuple[str, str]]) -> Column:
    """Enrichment fields as (idn[], label): ``specs`` gives field pattern and kind of label."""
    parts = []
    for spec, kind in specs:
        make, codes = LABELS[kind]
        usable = fields(spec, union_codes(codes, "Bi"))
        if kind != "person":
            usable = F.filter(usable, lambda d: ~F.array_contains(subs(d, "i"), "Spitzenorgan"))
        parts.append(
            F.transform(
                usable,
                (lambda f: lambda d: F.struct(subs(d, "B").alias("idn"), without_brackets(f(d)).alias("label")))(make),
            )
        )
    return F.concat(*parts)


# Enrichment fields with variant names.
AGENT_VARIANTS = [("GPN??", "person"), ("GKS??", "event"), ("GEL??|GKT??|GST??|GGN??", "other")]
CHAIN_VARIANTS = [("GPN??", "person"), ("GEL??|GKT??|GKS??|GST??|GGN??", "other")]
SUBJECT_VARIANTS = [("GPN??", "person"), ("GKS??", "event"), ("GEL??|GKT??|GKS??|GST??|GGN??", "other")]


def variants_of(idn: Column, entries: Column) -> Column:
    """Variant names of one authority record within the row (``entries`` is a column made before)."""
    hits = F.filter(entries, lambda e: F.array_contains(e["idn"], idn))
    return F.array_distinct(F.transform(hits, lambda e: e["label"]))
