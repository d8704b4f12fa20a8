"""Work that is done once per record: the plans do not decode, look up or build a value again."""

from pyspark.sql import functions as F

from stackfolio.operators.shape import vacuum
from stackfolio.plans import marc_records
from stackfolio.plans.labels import Vocabularies
from stackfolio.plans.legacy_titles import legacy_titles
from stackfolio.plans.titles import as_entries, linked_titles
from stackfolio.sources import split_volumes
from stackfolio.sources.marcxml import CONTROL, DATA
from stackfolio.sources.tagged import checked_lines

LINES = [
    "[/]#00 a1[/]#20 One[/]#36 um[/]#30a_sn5_[/]#31a_r99_ _o7_[/]#321_41n1_ ; _00S2_[/]#40a_41n1_[/]#40b_42n1_[/]#60a_00S2_[/]#70t Host[/]#70j1999[/]",
    "[/]#00 a2[/]#14 x[/]#20 Two[/]#36 s[/]#60e_00S9_[/]#85aSeries ; 3[/]",
]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def entries(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    return legacy_titles(split_volumes(checked_lines(lines)))


def vocabularies(spark) -> Vocabularies:
    return Vocabularies(
        headings=spark.createDataFrame([("00S2", "3-1", "x; y")], "k string, label string, variants string"),
        authorities=spark.createDataFrame([("41-1", "Ann", "A; N"), ("3-1", "Body", None)], "k string, label string, variants string"),
        subjects=spark.createDataFrame([], "k string, v string"),
        places=spark.createDataFrame([], "k string, v string"),
    )


def test_filter_on_a_title_column_does_not_decode(spark):
    rows = entries(spark).where("type = 'u'")
    plan = optimized(rows)
    assert not [x for x in plan.splitlines() if "Filter" in x and "map_from_entries" in x]
    assert [r["local_id"] for r in rows.collect()] == ["a1"]


def test_titles_are_decoded_for_their_ids_and_for_themselves(spark):
    rows = linked_titles(as_entries(entries(spark)), vocabularies(spark))
    assert optimized(rows).count("#36 sm") <= 2
    (row,) = rows.collect()
    agents = [(c["agent"]["label"], c["agent"]["alt_label"], c["role"]["label"]) for c in row["contribution"]]
    assert agents == [
        ("Ann", ["A", "N"], "Verfasser/in"), ("42-1", None, "Verfasser/in"), ("Body", ["x", "y"], "Geistiger Schöpfer"),
    ]
    assert row["subject"][1]["label"] == "Ann | Body"


def test_vacuum_says_each_value_once(spark):
    nested = F.struct(F.array(F.struct(F.array(F.struct(F.col("v").alias("leaf"), F.lit("").alias("none"))).alias("low"))).alias("mid")).alias("top")
    df = spark.createDataFrame([("x",), ("",)], "v string").select(nested)
    rows = vacuum(df)
    assert optimized(rows).count(".leaf") <= 4
    got = [r["top"] for r in rows.collect()]
    assert got[1] is None and got[0]["mid"][0]["low"][0]["leaf"] == "x" and got[0]["mid"][0]["low"][0]["none"] is None


def marc_record(spark):
    field = lambda tag, ind1, ind2, **subs: (tag, ind1, ind2, list(subs.items()))
    data = [field("245", "1", "0", a="Title"), field("300", " ", " ", a="1 CD"), field("655", " ", "7", a="Statistik"), field("24|", " ", " ", a="x")]
    return spark.createDataFrame([("r1", "00000nam a2200000 c 4500", [("001", "r1"), ("007", "tu")], data)], f"rec_id string, leader string, control {CONTROL}, data {DATA}")


def test_fields_are_not_grouped_by_tag_to_be_found(spark):
    rows = marc_records.described(marc_record(spark))
    assert "map_from_entries" not in optimized(rows)
    (row,) = rows.collect()
    assert row["title"] == "Title" and row["form_terms"] == ["Statistik"] and "Statistics" in row["type"]
