"""Known single cases of value rules."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from stackfolio.functions import dates, identifiers as ids, isbn, predicates as P, sortkeys, text
from stackfolio.naming import Namespaces
from stackfolio.plans import titles
from stackfolio.plans.marc_agents import role_code

NS = Namespaces()


@pytest.mark.parametrize("raw, plain", [("Siée", "Siee"), ("Chajjâm", "Chajjam"), ("Haën", "Haen"), ("Köln", "Köln"),
    ("ﬁnǄŉ²Ａ½ﷺé", "".join(c for c in unicodedata.normalize("NFKD", "ﬁnǄŉ²Ａ½ﷺé") if not "\u0300" <= c <= "\u036f")),
    ("김각 𝐀x", unicodedata.normalize("NFKD", "김각 𝐀x")), ("", ""),
])
def test_strip_diacritics(one, raw, plain):
    assert one({"x": raw}, lambda X: text.strip_diacritics(X)) == plain


@pytest.mark.parametrize(
    "types, best",
    [
        (["BibliographicResource", "MultiVolumeBook", "Book"], "MultiVolumeBook"),
        (["MultiVolumeBook", "PublishedScore", "Book"], "PublishedScore"),
        (["MultiVolumeBook", "BibliographicResource", "EditedVolume"], "EditedVolume"),
        (["Miscellaneous", "Book"], "Book"), (["Miscellaneous"], "Miscellaneous"), (["Standard"], None),
    ],
)
def test_most_specific_type(one, types, best):
    assert one({"x": types}, lambda X: titles.most_specific_type(X)) == best


def test_short_id(one):
    assert one({"x": "http://example.org/tree#n141020"}, lambda X: text.short_id(X)) == "141020"


@pytest.mark.parametrize(
    "raw, fixed",
    [
        ("1900-02-29", "1900-02-28"), ("2000-02-29", "2000-02-29"), ("1999-02-31", "1999-02-28"), ("2001-04-31", "2001-04-30"),
        ("1996-02-29", "1996-02-29"), ("1700-02-29", "1700-02-28"), ("1999", "1999"), ("1999-01-31", "1999-01-31"),
    ],
)
def test_calendar_fix(one, raw, fixed):
    assert one({"x": raw}, lambda X: dates.calendar_fix(X)) == fixed


@pytest.mark.parametrize(
    "span, born, died, kept",
    [
        ("1850-1912", "1850", "1912", None), ("v43-17", "-0043", "0017", None), ("ca. 1500-1560", None, "1560", "ca. 1500-1560"),
        ("5-99", "0005", "0099", None), ("1850-", "1850", None, None), ("-v3", None, "-0003", None), ("17. Jh.", None, None, "17. Jh."),
    ],
)
def test_life_dates(one, span, born, died, kept):
    got = one({"x": span}, lambda X: F.struct(dates.birth_year(X), dates.death_year(X), dates.approximate_span(X)))
    assert tuple(got) == (born, died, kept)


@pytest.mark.parametrize("raw, year", [("[1618?]", "1618"), ("ca. 950", "950"), ("o. J.", None)])
def test_start_year(one, raw, year):
    assert one({"x": raw}, lambda X: dates.start_year(X)) == year


def test_control_characters(one):
    assert one({"x": "\x98Der\x9c Markt\r\n\tX"}, lambda X: text.strip_controls(X)) == "Der Markt\r\n\tX"


def test_isbn(one):
    assert one({"x": "3-89570-664-3"}, lambda X: isbn.to_isbn13(isbn.clean_isbn(X))) == "9783895706646"
    assert one({"x": "978-0-8044-2957-3 (geb.)"}, lambda X: isbn.to_isbn10(isbn.clean_isbn(X))) == "080442957X"
    assert one({"x": ["080442957X", "nothing"]}, lambda X: isbn.both_forms(X)) == ["080442957X", "9780804429573"]


@pytest.mark.parametrize(
    "raw, uri",
    [
        ("_4252261n4_", NS.authority + "4252261-4"), ("_00Sn09k3368351a_", NS.heading + "00Sn09k3368351a"), ("_121n931350_", NS.heading + "121n931350"),
    ],
)
def test_heading_uri(one, raw, uri):
    assert one({"x": raw}, lambda X: ids.heading_uri(X)) == uri


@pytest.mark.parametrize(
    "raw, uri",
    [("_r30_ _2071807n1_", NS.authority + "2071807-1"), ("_r99_ _o135_", NS.spatial + "135"), ("_r07_", NS.spatial + "07")],
)
def test_spatial_uri(one, raw, uri):
    assert one({"x": raw}, lambda X: ids.spatial_uri(X)) == uri


def test_repairs(one):
    assert one({"x": NS.authority + "121-931350"}, lambda X: ids.repaired_agent(X)) == NS.heading + "121n931350"
    assert one({"x": NS.authority + "4035-X"}, lambda X: ids.repaired_agent(X)) == NS.authority + "4035-X"
    assert one({"x": NS.authority + "2071807nX"}, lambda X: ids.repaired_heading(X)) == NS.authority + "2071807-X"
    assert one({"x": "_r19_ _00Sn02m0557a_"}, lambda X: ids.spatial_candidate(X)) == NS.spatial + "00Sn02m0557a"


def test_missing_values_fail_every_test(spark):
    df = spark.createDataFrame([([],), (None,)], "x array<string>")
    X = F.col("x")
    tests = [P.any_match(X, ".*"), P.all_match(X, ".*"), P.any_equal(X, "a"), P.all_equal(X, "a"), P.any_contain(X, ""), P.all_contain(X, "")]
    for row in df.select(*tests).collect():
        assert not any(row)


def test_match_is_whole_value(one):
    assert one({"x": ["abc"]}, lambda X: P.any_match(X, "b")) is False
    assert one({"x": ["abc"]}, lambda X: P.any_match(X, ".b.|zz")) is True


@pytest.mark.parametrize("values", [[f"Stadtbezirk {i}" for i in range(1, 11)], [f"Stadtbezirk {r}" for r in sortkeys.ROMAN]])
def test_district_numbers(spark, values):
    df = spark.createDataFrame([(v,) for v in reversed(values)], "x string")
    assert [r["x"] for r in df.orderBy(sortkeys.district(F.col("x"))).collect()] == values


def test_isil_order(spark):
    want = ["DE-5", "DE-5-11", "DE-5-20", "DE-6", "DE-Walb1"]
    df = spark.createDataFrame([(v,) for v in reversed(want)], "x string")
    assert [r["x"] for r in df.orderBy(sortkeys.isil(F.col("x"))).collect()] == want


def test_german_order(spark):
    want = ["Apfel", "Äpfel", "Öl", "Oma", "Zebra", "zoo"]
    df = spark.createDataFrame([(v,) for v in reversed(want)], "x string")
    assert [r["x"] for r in df.orderBy(sortkeys.german(F.col("x"))).collect()] == want


@pytest.mark.parametrize("statement, code", [("Hrsg.", "edt"), ("Verfasser", "aut"), ("[Übers.]", "trl"), ("Ed.", "edt"), ("xyz", None)])
def test_role_of_statement(one, statement, code):
    assert one({"x": statement}, lambda X: role_code(X)) == code
