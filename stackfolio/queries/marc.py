"""Rules on MARC rows. The rows are made from orders, so that the results can be said in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..naming import Namespaces
from ..plans import marc as M
from ..plans.resolver import vocabulary
from ..plans import marc_agents, marc_links, marc_notes, marc_records, marc_subjects, marc_titles, marc_types
from ..plans.resolver import vocabulary
from ..sources import inline_lookup, marc_fields
from .bindings import MARC_SUBFIELDS, marc_rows
from .registry import query

NS = Namespaces()
O = """
WITH o AS (SELECT 'o' || o_orderkey AS rec_id, o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS n9, substr(o_orderpriority, 1, 1) AS u, o_orderpriority AS p,
  o_orderstatus AS s, CAST(o_custkey AS VARCHAR) AS c, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)
"""


def joined(column, out, sep="|"):
    return F.array_join(column, sep).alias(out)


@query(O + """
SELECT rec_id, 'Order <' || p || '> & more' || CASE s WHEN 'P' THEN ', Vol. ' || u || ': A part' WHEN 'F' THEN ', A part' ELSE '' END AS title,
  CASE WHEN s = 'P' THEN 'Also o' ELSE '' END AS alternative, 'status ' || s AS other_info, u || '. ed.' AS edition, 'by ' || c AS statement FROM o
""".replace("'Also o'", "'Also ' || o_orderkey"))
def marc_title_statements(t):
    rows = marc_titles.marc_titles(marc_rows(t))
    return rows.select(
        "rec_id", "title", joined("alternative_title", "alternative"), joined("other_title_information", "other_info"),
        joined("edition", "edition"), joined("responsibility_statement", "statement"),
    )


@query(O + """
SELECT rec_id, CAST(0 AS INTEGER) AS event_no, 'PublicationEvent' AS type, CASE WHEN s = 'F' THEN 'Current' ELSE '[Town ' || u || ']' END AS location,
  CASE WHEN s = 'F' THEN '' ELSE 'Firm ' || c END AS publisher, CASE WHEN s = 'F' THEN 'ca. ' || y || '-' ELSE '[' || y || ']' END AS date_statement,
  y AS start_date, NULL AS end_date, CASE WHEN s = 'F' THEN 'laufend' END AS status, CASE WHEN s = 'F' AND u = '2' THEN 'monatlich' END AS frequency FROM o
UNION ALL SELECT rec_id, 1, 'PublicationEvent', '[Town ' || u || ']', 'Firm ' || c, '[' || y || ']', y, NULL, NULL, NULL FROM o WHERE s = 'F'
UNION ALL SELECT rec_id, CASE WHEN s = 'F' THEN 2 ELSE 1 END, 'SecondaryPublicationEvent', 'Place', 'Agency', NULL, '2001', '2004', NULL, NULL FROM o WHERE u = '4'
""")
def marc_publication_events(t):
    rows = marc_titles.marc_publication(marc_rows(t), 2026)
    return rows.select(
        "rec_id", "event_no", joined("type", "type"), joined("location", "location"), joined("published_by", "publisher"), "date_statement",
        "start_date", "end_date", F.col("status.label").alias("status"), F.get("frequency", F.lit(0))["label"].alias("frequency"),
    )


@query(O + f"""
, r AS (
SELECT rec_id, 1 AS g, 'Person' AS type, 'Customer ' || c || ', A' || CASE WHEN true THEN '.' END AS label, CASE WHEN s = 'O' THEN 'cre' WHEN s = 'F' THEN 'edt' ELSE 'cre' END AS role,
  '{NS.authority}11' || c || 'X' AS id, '-0043' AS born, lpad(u, 4, '0') AS died FROM o
UNION ALL SELECT rec_id, 2, 'Person', 'Helper ' || c, CASE u WHEN '1' THEN 'edt' WHEN '2' THEN 'trl' ELSE 'ctb' END, NULL, NULL, NULL FROM o
UNION ALL SELECT rec_id, 3, 'CorporateBody', 'Body ' || c || '. Unit', unnest(['isb', 'pbl']), NULL, NULL, NULL FROM o
UNION ALL SELECT rec_id, 4, 'ConferenceOrEvent', 'Congress (' || u || ' : ' || y || ' : Trier)', 'oth', NULL, NULL, NULL FROM o WHERE s = 'P')
SELECT rec_id, type, label, '{NS.relator}' || role AS role, id, born, died FROM r
""")
def marc_contributions(t):
    """Agents and roles; record types are given by status here."""
    status = F.substring("leader", 7, 2)
    kinds = F.when(status == "as", F.array(F.lit("Periodical"))).otherwise(F.array(F.lit("Miscellaneous")))
    rows = marc_agents.marc_contributions(marc_rows(t).withColumn("type", kinds))
    return rows.select("rec_id", joined("type", "type"), "label", "role", "id", F.col("date_of_birth").alias("born"), F.col("date_of_death").alias("died"))


@query(O + """
SELECT rec_id, 'Topic ' || u AS label, 'Other Name ' || c || ', Dr.|Variant ' || u AS variants FROM o
""")
def marc_variant_names(t):
    """Variant names of a subject from the enrichment fields of its row; parent bodies are no variants."""
    rows = marc_subjects.marc_headings(marc_rows(t)).where(F.col("id").isNotNull())
    return rows.select("rec_id", "label", joined("alt_label", "variants"))


@query(O + """
, r AS (SELECT rec_id, 'Freie Verschlagwortung' AS scheme, 'Free ' || u || ' / Sub' AS label FROM o
UNION ALL SELECT rec_id, 'Library of Congress Subject Headings', 'Loc ' || u FROM o
UNION ALL SELECT rec_id, 'FAST (Faceted Application of Subject Terminology)', 'Fast ' || u FROM o WHERE u = '2'
UNION ALL SELECT rec_id, 'Gemeinsame Normdatei (GND)', 'Topic ' || u FROM o)
SELECT * FROM r
""")
def marc_headings_by_scheme(t):
    return marc_subjects.marc_headings(marc_rows(t)).select("rec_id", "scheme", "label")


@query(O + f"""
SELECT rec_id, CAST(0 AS INTEGER) AS pos, 'Mainz | Person ' || c || ' II.' AS label, 'PlaceOrGeographicName Person' AS kinds, '{NS.authority}4036-' || u AS first_id, '1850/1912' AS years FROM o
UNION ALL SELECT rec_id, 1, 'Event ' || u || ' (2 : Trier)', 'ConferenceOrEvent', NULL, '' FROM o WHERE s = 'P'
""")
def marc_heading_chains(t):
    rows = marc_subjects.marc_chains(marc_rows(t))
    kinds = F.flatten(F.transform("parts", lambda p: p["type"]))
    years = F.filter(
        F.transform("parts", lambda p: F.concat(p["date_of_birth"], F.lit("/"), p["date_of_death"])), lambda v: v.isNotNull()
    )
    return rows.select(
        "rec_id", "pos", "label", joined(kinds, "kinds", " "), F.get("parts", F.lit(0))["id"].alias("first_id"), joined(years, "years")
    )


@query(O + f"""
SELECT rec_id, 'Dewey-Dezimalklassifikation' AS scheme, u || '00' AS notation, '22' AS version, CASE WHEN u < '4' THEN 'Class ' || u END AS label FROM o
UNION ALL SELECT rec_id, 'RVK', 'NP ' || u || '600', NULL, CASE WHEN u = '3' THEN 'Region 3' END FROM o WHERE s = 'F'
""")
def marc_notations(t):
    """Dewey numbers with labels; RVK notations of wrong form and codes without scheme are dropped."""
    schemes = t.spark.createDataFrame([("rvk", "RVK", "https://d-nb.info/gnd/4449787-8"), ("x", "X", "no uri")], "code string, name string, uri string")
    labels = t.spark.createDataFrame(
        [("ddc", f"{i}00", f"Class {i}") for i in range(1, 4)] + [("rvk", "NP 3600", "Region 3"), ("ddc", "NP 1600", "no"), ("rvk", "A1", "no")],
        "code string, notation string, label string",
    )
    return marc_subjects.marc_notations(marc_rows(t), schemes, labels).select("rec_id", "scheme", "notation", "version", "label")


@query(O + """
SELECT rec_id, CASE u WHEN '1' THEN 'Festschrift' WHEN '3' THEN 'Website' ELSE 'Statistik' END AS label,
  'https://d-nb.info/gnd/' || CASE u WHEN '1' THEN '4016928-5' WHEN '3' THEN '4596172-4' ELSE '4056995-0' END AS id FROM o WHERE u <> '2'
""")
def marc_nature_of_content(t):
    """Form terms with their authority number; carrier terms are left out."""
    terms = t.spark.createDataFrame(
        [("Festschrift", "4016928-5"), ("Website", "4596172-4"), ("Statistik", "4056995-0"), ("CD", "4139307-7")], "label string, number string"
    )
    return marc_subjects.nature_of_content(marc_rows(t), terms)


@query(O + """
SELECT rec_id, 'http://example.org/spatial#' || u AS id, CASE WHEN u <> '5' THEN 'Place ' || u END AS label, u AS notation,
  CASE WHEN u <> '5' THEN 'city, town' END AS kinds, CASE WHEN u <> '5' THEN 49.5 + CAST(u AS INT) END AS lat, CASE WHEN u <> '5' THEN 8.25 END AS lon FROM o
""")
def marc_spatial(t):
    places = t.spark.createDataFrame(
        [(f"http://example.org/spatial#{i}", f"Place {i}", f"Q{i}", "city, town", f"Point(8.25 {49.5 + i})") for i in range(1, 5)],
        "id string, label string, focus_id string, types string, point string",
    )
    rows = marc_subjects.spatial_tags(marc_rows(t), places, "http://example.org/spatial#")
    return rows.select("rec_id", "id", "label", "notation", F.array_join("focus_types", ", ").alias("kinds"), "lat", "lon")


@query(O + """
SELECT rec_id, CAST(o_orderkey AS VARCHAR) AS oclc, 'HT' || o_orderkey AS union_id, CASE WHEN s = 'F' THEN '1' || o_orderkey || '-X' END AS zdb_id,
  CASE WHEN s = 'F' THEN '1234' || lpad(c, 4, '0') ELSE '' END AS issn, CASE WHEN u = '1' THEN '10.1/' || o_orderkey ELSE '' END AS doi,
  CASE WHEN s = 'O' THEN '978' || n9 || '0' ELSE '' END AS first_isbn FROM o
""")
def marc_identifiers(t):
    rows = marc_links.identifiers(marc_rows(t))
    return rows.select(
        "rec_id", joined("oclc", "oclc"), "union_id", F.when(F.col("zdb_id").isNotNull(), F.regexp_replace("zdb_id", " ", "")).alias("zdb_id"),
        joined("issn", "issn"), joined("doi", "doi"), F.coalesce(F.get("isbn", F.lit(0)), F.lit("")).alias("first_isbn"),
    )


LINK = "'http://example.org/o/' || o_orderkey"


@query(O + f"""
SELECT rec_id, 'contents' AS kind, {LINK} AS id, 'Inhaltsverzeichnis' AS label FROM o WHERE u = '1'
UNION ALL SELECT rec_id, 'fulltext', {LINK}, 'Online-Ressource' FROM o WHERE u = '1'
UNION ALL SELECT rec_id, unnest(['fulltext', 'same_as']), 'https://doi.org/10.1/' || o_orderkey, 'DOI-Link' FROM o WHERE u = '1'
UNION ALL SELECT rec_id, 'fulltext', {LINK}, 'Volltext' FROM o WHERE u = '2'
UNION ALL SELECT rec_id, 'description', {LINK}, 'Inhaltstext' FROM o WHERE u = '3'
UNION ALL SELECT rec_id, 'fulltext', {LINK}, 'Verlag' FROM o WHERE u = '4'
UNION ALL SELECT rec_id, 'fulltext', {LINK}, 'EZB' FROM o WHERE u = '5'
""")
def classified_links(t):
    return marc_links.classify_links(marc_rows(t)).drop("pos")


@query(O + f"""
SELECT rec_id, 'http://worldcat.org/oclc/' || o_orderkey AS id, 'OCLC-Ressource' AS label FROM o
UNION ALL SELECT rec_id, 'http://ld.zdb-services.de/resource/1' || o_orderkey || '-X', 'ZDB-Ressource' FROM o WHERE s = 'F'
UNION ALL SELECT rec_id, '{NS.host_catalogue}' || rec_id || '#!', 'Verbund-Ressource' FROM o
UNION ALL SELECT rec_id, 'https://doi.org/10.1/' || o_orderkey, 'DOI-Link' FROM o WHERE u = '1'
""")
def marc_same_as(t):
    return marc_links.marc_same_as(marc_rows(t))


@query(O + f"""
SELECT rec_id, 'is_part_of' AS kind, '{NS.host_catalogue}' || c || '#!' AS id, 'Host ' || u AS label, u AS numbering FROM o WHERE s = 'P'
UNION ALL SELECT rec_id, 'is_part_of', NULL, 'Series ' || u, u FROM o WHERE s = 'O'
UNION ALL SELECT rec_id, 'is_part_of', '{NS.resource}HT' || c || '#!', 'Traced ' || u, u FROM o WHERE s = 'O'
UNION ALL SELECT rec_id, 'related', NULL, 'Other', NULL FROM o WHERE s = 'O'
UNION ALL SELECT rec_id, 'predecessor', '{NS.resource}ZDB-' || c || '#!', 'Old ' || u, NULL FROM o WHERE s = 'F'
""")
def marc_related_works(t):
    return marc_links.marc_related(marc_rows(t)).select("rec_id", "kind", "id", "label", "numbering")


@query(O + f"""
SELECT rec_id, 'Zeitschriftendatenbank (ZDB)' AS label FROM o WHERE s = 'F'
UNION ALL SELECT rec_id, 'Journals' FROM o WHERE u = '5'
UNION ALL SELECT rec_id, 'Marked' FROM o WHERE u = '4'
UNION ALL SELECT rec_id, CASE u WHEN '1' THEN 'ZDB Collection' WHEN '2' THEN 'OERSI' ELSE 'ZDB-x Collection' END FROM o WHERE u <> '3'
""")
def marc_collections(t):
    found = marc_links.collections(
        [("EZB", "http://x/ezb", "Journals")], [("084??", "a", "^A4", "http://x/marked", "Marked")]
    )
    rows = marc_links.with_identifiers(M.prepared(marc_rows(t)), ("zdb_id",)).select("rec_id", F.explode(found).alias("c"))
    return rows.select("rec_id", "c.label")


@query(O + f"""
SELECT rec_id, 'K ' || c || '/' || y AS call_number, '{NS.item}' || rec_id || ':DE-36:K+' || c || '%2F' || y || '#!' AS id FROM o WHERE s = 'P'
""")
def marc_holdings(t):
    rows = M.prepared(marc_rows(t)).select("rec_id", F.explode(marc_links.holdings("DE-36")).alias("h"))
    return rows.select("rec_id", "h.call_number", "h.id")


@query(O + """
SELECT rec_id, CASE WHEN s = 'P' THEN NULL ELSE 1 END AS some, u || ' Seiten : Ill. ; 21 cm' || CASE WHEN u = '5' THEN ' ; 1 CD' ELSE '' END AS extent FROM o
""".replace("CASE WHEN s = 'P' THEN NULL ELSE 1 END AS some, ", ""))
def marc_extent(t):
    return marc_notes.marc_notes(marc_rows(t)).select("rec_id", "extent")


@query(O + """
SELECT rec_id, 'Note ' || u AS note, 'About ' || p AS abstract, CASE WHEN u = '1' THEN 'https://creativecommons.org/licenses/by/4.0' END AS license,
  CASE WHEN u = '1' THEN 'Open Access' END AS access, CASE WHEN u = '3' THEN 'Journal ' || u WHEN s = 'P' THEN 'Host ' || u END AS citation FROM o
""")
def marc_notes_and_rights(t):
    rows = marc_notes.marc_notes(marc_rows(t))
    return rows.select(
        "rec_id", joined("note", "note"), joined("abstract", "abstract"), F.get("license", F.lit(0))["id"].alias("license"),
        F.col("access_rights.label").alias("access"), F.col("bibliographic_citation").alias("citation"),
    )


@query(O + f"""
SELECT rec_id, '{NS.language}' || CASE u WHEN '1' THEN 'eng' ELSE 'ger' END AS id, CASE u WHEN '1' THEN 'Englisch' ELSE 'Deutsch' END AS label FROM o WHERE s <> 'P'
UNION ALL SELECT rec_id, '{NS.language}fre', 'Französisch' FROM o WHERE u = '2'
""")
def marc_languages(t):
    names = inline_lookup(t.spark, {"ger": "Deutsch", "eng": "Englisch", "fre": "Französisch"})
    return marc_notes.languages(marc_rows(t), names).select("rec_id", "id", "label")


@query(O + """
, f AS (SELECT *, CASE s WHEN 'O' THEN 'am' WHEN 'F' THEN 'as' ELSE 'em' END AS code FROM o),
e AS (SELECT *,
  list_distinct(['BibliographicResource']
  || CASE WHEN s IN ('O', 'F') AND u = '4' THEN ['Bibliography'] ELSE [] END
  || CASE WHEN u = '1' THEN ['Festschrift'] ELSE [] END
  || CASE WHEN s = 'P' THEN ['Map'] ELSE [] END
  || CASE WHEN s IN ('O', 'P') AND u = '1' THEN ['MultiVolumeBook'] ELSE [] END
  || CASE WHEN s = 'F' THEN ['Periodical'] ELSE [] END
  || CASE WHEN s IN ('O', 'F') AND u = '5' THEN ['Proceedings'] ELSE [] END
  || CASE WHEN u IN ('4', '5') THEN ['Statistics'] ELSE [] END
  || CASE WHEN s = 'O' AND u <> '2' THEN ['Book'] ELSE [] END) AS ts FROM f)
SELECT rec_id, array_to_string(list_sort(CASE WHEN len(ts) = 1 THEN ts || ['Miscellaneous'] ELSE ts END), ' ') AS types FROM e
""")
def marc_record_types(t):
    """Types from fixed fields, form terms and titles by rule table."""
    rows = marc_records.described(marc_rows(t))
    return rows.select("rec_id", joined(F.array_sort("type"), "types", " "))


@query(O + """
, m AS (SELECT rec_id, s, u, list_sort(list_distinct(
  CASE WHEN u = '2' THEN ['Audio-Dokument', 'Audio-Kassette'] ELSE [] END
  || CASE WHEN u <> '2' AND s = 'O' THEN ['Print'] ELSE [] END
  || CASE WHEN u <> '2' AND s <> 'O' THEN ['Print'] ELSE [] END
  || CASE WHEN s = 'P' THEN ['Print'] ELSE [] END
  || CASE WHEN u = '3' AND s <> 'P' THEN ['Online-Ressource'] ELSE [] END
  || CASE WHEN u = '3' THEN ['Online-Ressource'] ELSE [] END)) AS ms FROM o)
SELECT rec_id, array_to_string(CASE WHEN len(ms) = 0 THEN ['Print'] ELSE ms END, ' ') AS media FROM m
""")
def marc_carriers(t):
    rows = marc_records.described(marc_rows(t))
    return rows.select("rec_id", joined(F.array_sort(F.transform("medium", lambda m: m["label"])), "media", " "))


@query(O + """
SELECT rec_id, CASE s WHEN 'F' THEN 'Serial' ELSE 'Monograph/Item' END AS level FROM o
""")
def marc_levels(t):
    return marc_rows(t).select("rec_id", marc_types.bibliographic_level()["label"].alias("level"))


@query(O + """
SELECT rec_id, '245' AS tag, 'Body ' || c || '. Unit' AS body, CASE WHEN s = 'P' THEN 'Event ' || u || ' (2 : Trier)' END AS event, 'Person ' || c || ' II.' AS person FROM o
""")
def marc_heading_labels(t):
    """Combined labels of a body, an event and a person."""
    def label(spec, kind, place):
        make, codes = M.LABELS[kind]
        return F.get(M.each(spec, codes, make), F.lit(place))

    return M.prepared(marc_rows(t)).select(
        "rec_id", F.lit("245").alias("tag"), label("710??", "other", 0).alias("body"), label("6891?", "event", 0).alias("event"),
        label("6890?", "person", 1).alias("person"),
    )


@query(f"WITH {MARC_SUBFIELDS} SELECT tag, code, count(*) AS n FROM subfields GROUP BY ALL")
def marc_subfield_counts(t):
    """Long form of the rows, counted per subfield."""
    return marc_fields(marc_rows(t)).groupBy("tag", "code").agg(F.count(F.lit(1)).alias("n"))


@query(O + f"""
SELECT rec_id, '{NS.resource}' || rec_id || '#!' AS id, y AS start_date, 4 + CASE WHEN s = 'P' THEN 1 ELSE 0 END AS contributions, CASE WHEN s = 'P' THEN 1 ELSE 0 END AS items, 'Kyr ' || u AS other_script FROM o
""")
def linked_marc_records(t):
    """The whole MARC plan in one select."""
    rows = marc_records.linked_marc(marc_rows(t), "DE-36", this_year=2026)
    first = F.get("other_scripts", F.lit(0))["fields"]
    return rows.select(
        "rec_id", "id", F.get("publication", F.lit(0))["start_date"].alias("start_date"), F.size("contribution").alias("contributions"),
        F.size("has_item").alias("items"), F.get(first, F.lit(0))["other_value"].alias("other_script"),
    )


@query(O + f"""
, v AS (SELECT *, (u = '3') AS site FROM o)
SELECT rec_id, '{NS.resource}' || rec_id || '#!' AS id, 'http://raw/' || rec_id || '?x' AS described_by,
  concat_ws('|', CASE WHEN s <> 'P' THEN CASE u WHEN '1' THEN '{NS.language}eng=Englisch' ELSE '{NS.language}ger=Deutsch' END END,
    CASE WHEN u = '2' THEN '{NS.language}fre=Französisch' END) AS language,
  'Dewey-Dezimalklassifikation=' || u || '00=22=' || CASE WHEN u < '4' THEN 'Class ' || u ELSE '' END
    || CASE WHEN s = 'F' THEN '|RVK=NP ' || u || '600==' || CASE WHEN u = '3' THEN 'Region 3' ELSE '' END ELSE '' END AS notation,
  CASE u WHEN '1' THEN 'Festschrift=https://d-nb.info/gnd/4016928-5' WHEN '2' THEN '' WHEN '3' THEN 'Website=https://d-nb.info/gnd/4596172-4'
    ELSE 'Statistik=https://d-nb.info/gnd/4056995-0' END AS nature_of_content,
  'http://example.org/spatial#' || u || '=' || CASE WHEN u <> '5' THEN 'Place ' || u ELSE '' END || '=' || u || '='
    || CASE WHEN u <> '5' THEN 'Q' || u || '=city+town=' || CAST(49.5 + CAST(u AS INT) AS VARCHAR) || '=8.25' ELSE '===' END AS spatial,
  array_to_string(list_sort(list_filter([CASE WHEN s = 'F' THEN 'Zeitschriftendatenbank (ZDB)' END, CASE WHEN u = '5' THEN 'Journals' END, CASE WHEN u = '4' THEN 'Marked' END,
    CASE u WHEN '1' THEN 'ZDB Collection' WHEN '2' THEN 'OERSI' WHEN '3' THEN NULL ELSE 'ZDB-x Collection' END], lambda x: x IS NOT NULL)), '|') AS in_collection,
  array_to_string(list_sort(list_filter(['Free ' || u || ' / Sub', 'Loc ' || u, CASE WHEN u = '2' THEN 'Fast ' || u END, 'Topic ' || u, 'Mainz', 'Person ' || c || ' II.',
    CASE WHEN s = 'P' THEN 'Event ' || u || ' (2 : Trier)' END], lambda x: x IS NOT NULL)), '|') AS subject_labels,
  CASE WHEN site THEN 'http://example.org/o/' || o_orderkey || '=example.org/o/' || o_orderkey ELSE '' END AS web_page_archived,
  y AS start_date, 4 + CASE WHEN s = 'P' THEN 1 ELSE 0 END AS contributions, 'Kyr ' || u AS other_script, 'Note ' || u AS note
FROM v
""")
def whole_marc_records(t):
    """The whole MARC plan with all lookups in one join: every field that a lookup or the assembly gives."""
    made = lambda rows, names: t.spark.createDataFrame(rows, names)
    terms = made([("Festschrift", "4016928-5"), ("Website", "4596172-4"), ("Statistik", "4056995-0"), ("CD", "4139307-7")], "k string, number string")
    vocab = marc_records.MarcVocabularies(
        languages=vocabulary(inline_lookup(t.spark, {"ger": "Deutsch", "eng": "Englisch", "fre": "Französisch"}), label="v"),
        schemes=vocabulary(made([("rvk", "RVK", "https://d-nb.info/gnd/4449787-8"), ("x", "X", "no uri")], "k string, name string, uri string"), label="name", url="uri"),
        notations=vocabulary(made([(f"ddc {i}00", f"Class {i}") for i in range(1, 4)] + [("rvk NP 3600", "Region 3")], "k string, v string"), label="v"),
        terms=vocabulary(terms, label="number"),
        term_numbers=vocabulary(terms.toDF("label", "k"), label="label"),
        places=vocabulary(
            made(
                [(f"http://example.org/spatial#{i}", f"Place {i}", f"Q{i}", "city, town", f"Point(8.25 {49.5 + i})") for i in range(1, 5)],
                "k string, label string, focus string, types string, point string",
            ), label="label", variants="types", url="focus", detail="point",
        ),
    )
    rows = marc_records.whole_marc(
        marc_rows(t), "DE-36", vocab, this_year=2026, url_rules=[("EZB", "http://x/ezb", "Journals")],
        selection_rules=[("084??", "a", "^A4", "http://x/marked", "Marked")], places="http://example.org/spatial#", source=("http://raw/", "?x"),
    )

    def listed(name, *parts):
        one = lambda x: F.concat_ws("=", *[F.coalesce(p(x).cast("string"), F.lit("")) for p in parts])
        return F.coalesce(F.array_join(F.transform(name, one), "|"), F.lit("")).alias(name)

    field = lambda *names: [lambda x, n=n: x[n] for n in names]
    first = F.get("other_scripts", F.lit(0))["fields"]
    return rows.select(
        "rec_id", "id", F.col("described_by.object_id").alias("described_by"), listed("language", *field("id", "label")),
        listed("notation", *field("scheme", "notation", "version", "label")), listed("nature_of_content", *field("label", "id")),
        listed("spatial", *field("id", "label", "notation", "focus_id"), lambda x: F.array_join(x["focus_types"], "+"), *field("lat", "lon")),
        F.array_join(F.array_sort(F.transform("in_collection", lambda c: c["label"])), "|").alias("in_collection"),
        F.array_join(F.array_sort("subject_labels"), "|").alias("subject_labels"), listed("web_page_archived", *field("id", "label")),
        F.get("publication", F.lit(0))["start_date"].alias("start_date"), F.size("contribution").alias("contributions"),
        F.get(first, F.lit(0))["other_value"].alias("other_script"), joined("note", "note"),
    )
