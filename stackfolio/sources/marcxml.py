"""MARC records as one row each: leader, control fields, data fields with their subfields.

A record stays one row from file to result. All field work is done on its arrays, so no MARC rule
needs a shuffle; only lookups in other tables do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import rows_of

XML_SCHEMA = (
    "leader string, "
    "controlfield array<struct<_tag:string,_VALUE:string>>, "
    "datafield array<struct<_tag:string,_ind1:string,_ind2:string,"
    "subfield:array<struct<_code:string,_VALUE:string>>>>"
)
CONTROL = "array<struct<tag:string,value:string>>"
DATA = "array<struct<tag:string,ind1:string,ind2:string,subs:array<struct<code:string,value:string>>>>"


def read_marcxml(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    # Indicators and fixed fields are blank-padded, so white space is kept.
    raw = spark.read.format("xml").options(
        rowTag=row_tag, ignoreSurroundingSpaces="false", ignoreNamespace="true"
    )
    return marc_records(raw.schema(XML_SCHEMA).load(path))


def parse_marcxml(df: DataFrame, column: str) -> DataFrame:
    options = {"ignoreSurroundingSpaces": "false", "ignoreNamespace": "true"}
    parsed = df.select(F.from_xml(column, XML_SCHEMA, options).alias("r"))
    # A generator keeps later filters above the parser; pushed below it, they would parse again.
    return marc_records(parsed.select(F.inline(F.array("r"))))


def marc_records(raw: DataFrame) -> DataFrame:
    """Parsed XML → (rec_id, leader, control, data); records marked deleted are left out."""

    def pad(value: Column) -> Column:
        return F.rpad(F.coalesce(value, F.lit(" ")), 1, " ")

    control = F.transform(
        F.coalesce("controlfield", F.array().cast("array<struct<_tag:string,_VALUE:string>>")),
        lambda c: F.struct(c["_tag"].alias("tag"), c["_VALUE"].alias("value")),
    )
    data = F.transform(
        "datafield",
        lambda d: F.struct(
            d["_tag"].alias("tag"),
            pad(d["_ind1"]).alias("ind1"),
            pad(d["_ind2"]).alias("ind2"),
            F.transform(
                d["subfield"],
                lambda s: F.struct(s["_code"].alias("code"), s["_VALUE"].alias("value")),
            ).alias("subs"),
        ),
    )
    kept = raw.where(~is_deleted())
    records = kept.select(
        "leader",
        control.alias("control"),
        F.coalesce(data, F.array().cast(DATA)).alias("data"),
    )
    record_id = F.expr("get(filter(control, c -> c.tag = '001'), 0).value")
    return records.select(record_id.alias("rec_id"), "leader", "control", "data")


def is_deleted() -> Column:
    """Test on the parsed XML, before any field work."""
    return F.expr(
        "coalesce(exists(datafield, d -> d._tag = 'DEL' AND exists(d.subfield, s -> s._code = 'a' AND s._VALUE = 'Y')), false)"
    )


def marc_fields(records: DataFrame) -> DataFrame:
    """Long form (rec_id, fseq, tag, ind1, ind2, sseq, code, value) for ad-hoc analysis."""
    return (
        rows_of(rows_of(records, ["rec_id"], "data", "d", "fseq"), ["rec_id", "fseq", "d"], "d.subs", "s", "sseq")
        .select("rec_id", "fseq", "d.tag", "d.ind1", "d.ind2", "sseq", "s")
        .select("rec_id", "fseq", "tag", "ind1", "ind2", "sseq", "s.code", "s.value")
    )


# --- writing -------------------------------------------------------------------------------------


def to_marcxml(records: DataFrame) -> DataFrame:
    """(rec_id, xml): the XML text of each record."""

    def escaped(value: str) -> str:
        return f"replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

    control = (
        "array_join(transform(control, c -> concat('<controlfield tag=\"', c.tag, '\">', "
        f"{escaped('c.value')}, '</controlfield>')), '')"
    )
    subfields = (
        "array_join(transform(d.subs, s -> concat('<subfield code=\"', s.code, '\">', "
        f"{escaped('s.value')}, '</subfield>')), '')"
    )
    data = (
        "array_join(transform(data, d -> concat('<datafield tag=\"', d.tag, '\" ind1=\"', d.ind1, '\" ind2=\"', d.ind2, "
        f"'\">', {subfields}, '</datafield>')), '')"
    )
    return records.select(
        "rec_id", F.expr(f"concat('<record><leader>', leader, '</leader>', {control}, {data}, '</record>')").alias("xml")
    )
