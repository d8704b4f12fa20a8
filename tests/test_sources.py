"""Sources and sinks on small files."""

import pytest
from pyspark.sql import functions as F

from stackfolio import sinks
from stackfolio.functions.identifiers import AUTHORITY_ID
from stackfolio.sources import (
    decode_tagged, marc_fields, mine_ids, parse_lookup, read_beacon, read_communes_csv, read_lines, read_lookup,
    read_marcxml, read_ndjson, read_register_csv, read_skos, read_tagged, rejected_lines, unread_skos,
)

RHINE = (
    "[/]#00 929t124030[/]#20 Deutsche Binnenwasserstraßen[/]#36 sm[/]#01 6/2022[/]#36 sbd[/]"
    "#20 Der Rhein - Rheinfelden bis Koblenz[/]#01 7. Band 2022[/]#20 Der Rhein - Koblenz bis Tolkamer[/]"
    "#01 Nachgewiesen 2007 -[/]#20 [/]#01 Nachgewiesen 2008 -[/]"
)


def decoded(spark, line):
    rows = decode_tagged(spark.createDataFrame([(line,)], "value string")).orderBy("rec_id", "seq").collect()
    out = {}
    for r in rows:
        out.setdefault(r["rec_id"], []).append((r["tag"], r["value"]))
    return out


def test_simple_record(spark):
    assert decoded(spark, "[/]#00 123[/]#20 abc[/]#983HT011020818[/]") == {
        "123": [("f00_", "123"), ("f20_", "abc"), ("f983", "HT011020818")]
    }


def test_volumes(spark):
    title = "Deutsche Binnenwasserstraßen"
    got = decoded(spark, RHINE)
    assert got["929t124030"] == [("f00_", "929t124030"), ("f20_", title), ("f36_", "sm"), ("f36t", "MultiVolumeBook")]
    assert got["929t124030b1"] == [
        ("f00_", "929t124030b1"), ("f20u", title), ("f20_", f"{title} : 6/2022"), ("f01_", "6/2022"), ("f36_", "sbd"),
        ("f20_", "Der Rhein - Rheinfelden bis Koblenz"),
    ]
    assert got["929t124030b3"][-1] == ("f20_", "")
    assert len(got) == 5


def test_periodical(spark):
    got = decoded(
        spark,
        "[/]#00 929t111930[/]#20 Sommerspiele[/]#36 sm[/]#88 1201241-5[/]#01 1958 - 1968 nachgewiesen[/]#36 sbd[/]",
    )
    assert got["929t111930"][-2:] == [("f88_", "1201241-5"), ("f36t", "Periodical")]


def test_volume_field_without_marker_is_plain_data(spark):
    got = decoded(spark, "[/]#00 a[/]#20 T[/]#36 TEST[/]#01 6[/]#20 U[/]#01 7[/]")
    assert list(got) == ["a"] and len(got["a"]) == 6


def test_nonsort_and_reject(spark):
    assert decoded(spark, "[/]#00 b[/]#20 ¬Der¬ Rhein[/]")["b"][1] == ("f20_", "Der Rhein")
    lines = spark.createDataFrame([("[/]#01something[/]",), ("[/]#00 ok[/]",)], "value string")
    assert [r["problem"] for r in rejected_lines(lines).collect()] == ["Can't get ID from input"]


def test_legacy_charset(spark, tmp_path):
    file = tmp_path / "titles.txt"
    file.write_bytes("[/]#00 1[/]#20 Köln[/]\n".encode("cp437"))
    rows = read_tagged(spark, str(file)).where("tag = 'f20_'").collect()
    assert rows[0]["value"] == "Köln"


def test_ndjson_paths(spark, tmp_path):
    file = tmp_path / "x.ndjson"
    file.write_text('{"member":[{"attributes":{"id":"1"}},{"attributes":{"id":"2"}}]}\n{"other":1}\n')
    got = read_ndjson(spark, str(file), "id string", "member[].attributes").collect()
    assert sorted(r["id"] for r in got) == ["1", "2"]


MARC = """<collection>
<record><leader>00000nam a2200000 c 4500</leader><controlfield tag="001">r1</controlfield>
<datafield tag="245" ind1="1" ind2="0"><subfield code="a">Title &amp; more /</subfield><subfield code="c">by X</subfield></datafield>
<datafield tag="264" ind1=" " ind2="1"><subfield code="a">Mainz :</subfield></datafield></record>
<record><leader>00000nam a2200000 c 4500</leader><controlfield tag="001">r2</controlfield>
<datafield tag="DEL" ind1=" " ind2=" "><subfield code="a">Y</subfield></datafield></record>
</collection>"""


def test_marcxml_file(spark, tmp_path):
    file = tmp_path / "marc.xml"
    file.write_text(MARC)
    records = read_marcxml(spark, str(file))
    rows = marc_fields(records).orderBy("fseq", "sseq").collect()
    assert [(r["rec_id"], r["tag"], r["ind1"], r["ind2"], r["code"], r["value"]) for r in rows] == [
        ("r1", "245", "1", "0", "a", "Title & more /"), ("r1", "245", "1", "0", "c", "by X"), ("r1", "264", " ", "1", "a", "Mainz :"),
    ]


def test_lookup_file(spark, tmp_path):
    file = tmp_path / "map.tsv"
    file.write_text("a\t1\tx\nb\t\ty\nshort\t1\na\t2\tz\n")
    got = {r["k"]: r["v"] for r in read_lookup(spark, str(file), expected_columns=3).collect()}
    assert got == {"a": "2"}
    got = {r["k"]: r["v"] for r in read_lookup(spark, str(file), expected_columns=3, allow_empty=True).collect()}
    assert got == {"a": "2", "b": ""}
    got = {r["k"]: r["v"] for r in read_lookup(spark, str(file), value_col=1, expected_columns=-1).collect()}
    assert got == {"a": "2", "short": "1"}


def test_lookup_from_dataframe_order(spark):
    lines = spark.createDataFrame([("k\tnew", 2), ("k\told", 1)], "value string, o int")
    assert parse_lookup(lines, order_col="o").collect()[0]["v"] == "new"


def test_beacon_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("#FORMAT: BEACON\n#TARGET: http://www.site.org/p/{ID}\n#NAME: My   Site\n118\n119|3|x\n")
    (tmp_path / "two.txt").write_text("#TARGET: https://www.other.org/{ID}\n#DESCRIPTION:\n\n118|https://www.third.org/q\n")
    got = sorted((r["id"], r["url"], r["name"]) for r in read_beacon(spark, str(tmp_path / "*.txt")).collect())
    assert got == [
        ("118", "http://www.site.org/p/118", "My Site"), ("118", "https://www.third.org/q", "third.org"), ("119", "http://www.site.org/p/119", "My Site"),
    ]


SKOS = """@prefix skos: <http://www.w3.org/2004/02/skos/core#> .

<http://x/s>
    a skos:ConceptScheme ;
    skos:hasTopConcept <http://x/s#n1> .

<http://x/s#n1>
    a skos:Concept ;
    skos:notation "ab1" ;
    skos:prefLabel "One"@en, "Eins \\"A\\""@de .

<http://x/s#n11>
    a skos:Concept ;
    skos:broader <http://x/s#n1> ;
    skos:prefLabel "Elf"@de .
"""


def test_skos_file(spark, tmp_path):
    file = tmp_path / "v.ttl"
    file.write_text(SKOS)
    got = sorted((r["id"], r["pref_label"], r["broader"], r["notation"]) for r in read_skos(spark, str(file)).collect())
    assert got == [("http://x/s#n1", 'Eins "A"', None, "ab1"), ("http://x/s#n11", "Elf", "http://x/s#n1", None)]


def test_skos_statements_without_blank_lines(spark, tmp_path):
    file = tmp_path / "v.ttl"
    file.write_text(
        '@prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n# a "comment. <x\n'
        '<http://x/s#a> a skos:Concept ; skos:prefLabel "A. B <c> . D"@de .\n'
        '<http://x/s#b>\n  a skos:Concept ; skos:broader <http://x/s#a>, <http://x/s#c> ; skos:broader <http://x/s#d> .\n'
        '<http://x/s#e> a skos:Concept . <http://x/s#f> a skos:Concept ; skos:notation "1.2" .\n'
        'ex:g a skos:Concept .'
    )
    got = sorted((r["id"][-1], r["pref_label"], r["broader"], r["notation"], [b[-1] for b in r["all_broader"]]) for r in read_skos(spark, str(file)).collect())
    assert got == [
        ("a", "A. B <c> . D", None, None, []), ("b", None, "http://x/s#a", None, ["a", "c", "d"]),
        ("e", None, None, None, []), ("f", None, None, "1.2", []),
    ]
    left = unread_skos(spark.read.text(str(file), wholetext=True)).collect()
    assert [r["statement"].split()[0] for r in left] == ["ex:g"]


def test_skos_written_and_read(spark, tmp_path):
    nodes = spark.createDataFrame(
        [(None, "http://x/s#n1", 'Eins "A"', "1"), ("http://x/s#n1", "http://x/s#n11", "Elf", "11")],
        "parent string, id string, label string, notation string",
    )
    path = str(tmp_path / "out")
    sinks.write_skos(nodes, path, "http://x/s", "Scheme", "http://x/s#", "s")
    got = {r["id"]: (r["pref_label"], r["broader"]) for r in read_skos(spark, path).collect()}
    assert got == {"http://x/s#n1": ('Eins "A"', None), "http://x/s#n11": ("Elf", "http://x/s#n1")}


def test_register_csv(spark, tmp_path):
    file = tmp_path / "j.csv"
    file.write_text('"Das ""Blatt""","http://x/1"\n"only label"\n')
    got = [(r["label"], r["value"]) for r in read_register_csv(spark, str(file)).collect()]
    assert got == [("Das 'Blatt'", "http://x/1")]


def test_communes_csv(spark, tmp_path):
    file = tmp_path / "g.csv"
    file.write_text("Nr,Teil,Name\n13100000,,Ort\n")
    got = read_communes_csv(spark, str(file), {"code": "Nr", "part": "Teil", "label": "Name"}).collect()
    assert (got[0]["code"], got[0]["part"], got[0]["label"]) == ("13100000", None, "Ort")


def test_mined_ids(spark):
    texts = spark.createDataFrame([("see 118540238 and 4076031-5, 4076031n5",)], "text string")
    assert {r["id"] for r in mine_ids(texts, "text", AUTHORITY_ID).collect()} == {"118540238", "4076031-5", "4076031n5"}


def test_bulk_files(spark, tmp_path):
    df = spark.range(25).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("none"))
    path = tmp_path / "bulk"
    sinks.write_bulk(df.coalesce(1), str(path), "id", "i", "t", batch=10)
    files = sorted(path.glob("part-*"))
    assert [len(f.read_text().splitlines()) for f in files] == [20, 20, 10]
    assert files[0].read_text().splitlines()[1] == '{"id":"0"}'


def test_tsv_and_json_list(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ny"), ("a", "x\ny"), ("b", None)], "k string, v string")
    sinks.write_lookup_tsv(df.coalesce(1), str(tmp_path / "t"), ["k", "v"], distinct=True, header=False)
    lines = [x for f in (tmp_path / "t").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines) == ["a\tx;y", "b\t"]
    sinks.write_json_array(df, str(tmp_path / "j"), "k")
    assert "".join(x for f in sorted((tmp_path / "j").glob("part-*")) for x in f.read_text().splitlines()) == '["a","b"]'


def test_json_list_of_nothing_and_of_one(spark, tmp_path):
    import json

    for name, rows in (("none", []), ("nulls", [(None,)]), ("one", [('a"\n',)]), ("many", [(f"v{i % 700}",) for i in range(2000)])):
        sinks.write_json_array(spark.createDataFrame(rows, "k string"), str(tmp_path / name), "k")
        text = "\n".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))
        assert json.loads(text) == sorted({r[0] for r in rows} - {None})


def test_ndjson_leaves_absent_fields_out(spark, tmp_path):
    sinks.write_ndjson(spark.createDataFrame([("1", None)], "id string, x string"), str(tmp_path / "n"))
    assert [x for f in (tmp_path / "n").glob("part-*") for x in f.read_text().splitlines()] == ['{"id":"1"}']


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.read_snapshot(spark, root, "s") is None
    sinks.swap_snapshot(spark.range(3), root, "s")
    sinks.swap_snapshot(spark.range(5), root, "s")
    assert sinks.read_snapshot(spark, root, "s").count() == 5


@pytest.mark.parametrize("charset", ["IBM437", "cp850", "ISO-8859-1", "cp1250"])
def test_lines_of_a_legacy_charset(spark, tmp_path, charset):
    line = "".join(c for c in bytes(range(32, 256)).decode(charset, "ignore") if c not in "\x85")
    (tmp_path / "l.txt").write_bytes(line.encode(charset) + b"\nx\n")
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    assert [r["value"] for r in read_lines(spark, str(tmp_path / "l.txt"), charset).collect()] == [line, "x"]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before
