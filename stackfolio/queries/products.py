"""Whole record plans: titles, persons, headings from tagged lines to linked records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import around
from ..naming import Namespaces
from ..operators import lookup, quality
from ..operators.sets import route_collections
from ..plans import authorities, persons, titles
from ..plans.labels import Vocabularies
from ..plans.legacy_titles import legacy_titles
from ..plans.resolver import vocabulary
from ..sources import split_volumes
from ..sources.tagged import checked_lines, tagged_line
from .bindings import text
from .registry import query

NS = Namespaces()


def title_records(t):
    """Tagged title line of each order, split into segments."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    cust = F.col("o_custkey").cast("string")
    year = F.year("o_orderdate").cast("string")
    urgent = F.substring(priority, 1, 1)
    kind = F.when(status == "F", "s").when((status == "O") & (urgent == "1"), "sbd").when(status == "O", "um").otherwise("sm")
    article = kind == "um"

    def f(tag, value, when=None):
        out = F.concat(F.lit(tag), value)
        return out if when is None else F.when(when, out)

    orders = t.wide("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    lines = orders.select(
        tagged_line(
            F.concat(F.when(urgent == "5", "w").otherwise("o"), F.col("o_orderkey").cast("string")),
            f("#01 ", urgent, kind == "sbd"),
            f("#14 ", F.lit("x"), (urgent == "4") & (status == "P")),
            f("#20 ", F.concat(F.lit("¬The¬ title + "), priority)), f("#20u", F.concat(F.lit("Parent "), cust), kind == "sbd"),
            f("#241", F.concat(F.lit("Parallel "), cust), urgent == "2"), f("#28 ", F.concat(F.lit("spelled "), urgent)),
            f("#30a", F.concat(F.lit("_sn"), cust, F.lit("_"))), f("#31a", F.concat(F.lit("_r99_ _o"), cust, F.lit("_"))), f("#31b", F.lit("_r07_")),
            f("#321", F.concat(F.lit("_4"), cust, F.lit("n1_ ; _00S"), cust, F.lit("_"))),
            f("#36 ", kind), f("#39x", F.concat(F.lit("by "), cust)),
            f("#40a", F.concat(F.lit("_4"), cust, F.lit("n1_"))), f("#41a", F.concat(F.lit("Name, "), urgent)), f("#60a", F.concat(F.lit("_00S"), cust, F.lit("_: Body"))),
            f("#70 ", F.concat(F.lit("In: Journal, S. 3-"), urgent), article & (urgent == "2")),
            f("#70b", urgent, article), f("#70j", year, article), f("#70t", F.lit("Host"), article & (urgent == "3")),
            f("#71 ", F.concat(urgent, F.lit(". ed."))), f("#74 ", F.concat(F.lit("Town "), urgent)), f("#75 ", F.concat(F.lit("Firm "), cust)),
            f("#76b", F.concat(F.lit("["), year, F.lit("?]")), urgent != "3"), f("#77 ", F.lit("12 S.")), f("#81a", F.lit("Note")), f("#81b", F.lit("Note")),
            f("#84 ", F.concat(F.lit("1."), cust)), f("#85 ", F.concat(F.lit("Series "), cust, F.lit(" ; "), urgent)), f("#871", F.concat(F.lit("978"), cust)),
            f("#88 ", F.concat(cust, F.lit("-1")), kind == "sm"),
            f("#90b", F.lit("call")), f("#90e", F.concat(F.lit("http://example.org/o "), cust), urgent == "1"), f("#90f", F.concat(F.lit("http://www.example.org/"), cust)),
            f("#983", F.concat(F.lit("HT"), cust), urgent != "1"),
        ).alias("value")
    )
    return split_volumes(checked_lines(lines))


BASE = """
WITH o AS (SELECT CASE WHEN o_orderpriority LIKE '5%' THEN 'w' ELSE 'o' END || o_orderkey AS local_id, substr(o_orderpriority, 1, 1) AS u, o_orderpriority AS p,
  o_orderstatus AS s, CAST(o_custkey AS VARCHAR) AS c, o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS y,
  CASE WHEN o_orderstatus = 'F' THEN 's' WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'sbd' WHEN o_orderstatus = 'O' THEN 'u' ELSE 'sm' END AS k FROM orders)
"""


@query(BASE + f"""
SELECT local_id, 'The title + ' || p AS title, CASE k WHEN 's' THEN 'Monografie' WHEN 'sm' THEN 'Mehrt. Mono (ÜO)' WHEN 'sbd' THEN 'Band' ELSE k END AS type,
  CASE WHEN u <> '1' THEN 'HT' || c END AS union_id, k = 'sm' AND u = '4' AS do_not_index, CASE WHEN u = '5' THEN 'nur zweite' ELSE 'nur erste' END AS in_collection,
  CASE WHEN u <> '3' THEN '[' || y || '?]' WHEN k = 'sbd' THEN 's. Zählung in numbering' WHEN k <> 'u' THEN 'N/A' END AS publication_date,
  CASE WHEN k = 'u' AND u = '2' THEN 'In: Journal, S. 3-2' WHEN k = 'u' AND u = '3' THEN 'In: Host. - 3 (' || y || '), '
    WHEN k = 'u' THEN 's. spez. Felder (volume, issue, etc.)' END AS source,
  CASE WHEN k = 'u' AND u = '2' THEN 'Aus #70~, #701 ff.: S. 3-2' WHEN k = 'u' AND u = '3' THEN 'Kopiert aus #70~, #701 ff.: In: Host. - 3 (' || y || '), '
    WHEN k = 'u' THEN 'Kopiert aus #70~, #701 ff.: s. spez. Felder (volume, issue, etc.)' END AS pages,
  'Series ' || c AS series, u AS series_no, '{NS.subject}' || c AS subject, '{NS.spatial}' || c || ' {NS.spatial}07' AS places,
  '{NS.authority}4' || c || '-1 {NS.heading}00S' || c AS chain, '{NS.authority}4' || c || '-1 Verfasser/in, Name, Herausgeber/in' AS people,
  '{NS.heading}00S' || c || ' Geistiger Schöpfer' AS bodies, 'Aus f39x: by ' || c AS statement, 'http://www.example.org/' || c AS urls, 'SP' AS items,
  CASE WHEN k = 'sbd' THEN '{NS.resource}' || local_id END AS volume_in
FROM o
""")
def legacy_title_entries(t):
    rows = legacy_titles(title_records(t))
    people = F.array_join(F.transform("person", lambda x: F.concat_ws(" ", x["value"], x["type"])), ", ")
    series = F.get(F.coalesce("in_series", "is_part_of"), F.lit(0))
    return rows.select(
        "local_id", "title", "type", "union_id", "do_not_index", "in_collection", "publication_date",
        F.col("citation.value").alias("source"), F.col("citation.pages").alias("pages"),
        series["value"].alias("series"), series["numbering"].alias("series_no"),
        F.array_join("subject", " ").alias("subject"), F.array_join("spatial", " ").alias("places"),
        F.array_join(F.flatten("heading_chains"), " ").alias("chain"), people.alias("people"),
        F.array_join(F.transform("corporate_body", lambda x: F.concat_ws(" ", x["value"], x["type"])), ", ").alias("bodies"),
        F.col("responsibility_statement").alias("statement"), F.array_join(F.transform("url", lambda u: u["value"]), " ").alias("urls"),
        F.array_join(F.transform("item", lambda i: i["type"]), " ").alias("items"), F.col("volume_in.value").alias("volume_in"),
    )


def vocabularies(t) -> Vocabularies:
    """Customers as headings, authority records and tree nodes."""
    rich = t.customer.where("c_acctbal > 0")
    return Vocabularies(
        headings=t.customer.select(text("00S", "c_custkey").alias("k"), F.concat(F.lit("Heading "), "c_custkey").alias("label"), F.concat(F.lit("h1; h"), "c_custkey").alias("variants")),
        authorities=rich.select(F.concat(F.lit("4"), "c_custkey", F.lit("-1")).alias("k"), F.col("c_name").alias("label"), F.concat("c_mktsegment", F.lit("; v")).alias("variants")),
        subjects=rich.select(text(NS.subject, "c_custkey").alias("k"), F.concat(F.lit("Subject "), "c_custkey").alias("v")),
        places=t.customer.select(text(NS.spatial, "c_custkey").alias("k"), F.concat(F.lit("Place "), "c_custkey").alias("v")),
    )


def _linked(t):
    return titles.linked_titles(titles.as_entries(legacy_titles(title_records(t))), vocabularies(t))


@query(BASE + f"""
SELECT local_id, '{NS.resource}' || local_id AS id, 'BibliographicResource' || CASE k WHEN 'sm' THEN ' MultiVolumeBook' WHEN 'u' THEN ' Article' ELSE ' Book' END AS type,
  'The title ' || p AS title, CASE WHEN u <> '3' THEN y END AS start_date, CASE WHEN u <> '3' THEN '[' || y || '?]' END AS date_statement, 'Town ' || u AS location, 'Firm ' || c AS publisher,
  CASE WHEN r.c_custkey IS NOT NULL THEN 'Subject ' || c ELSE '{NS.subject}' || c END || ' / ' || coalesce(r.c_name, '4' || c || '-1') || ' | Heading ' || c AS subjects,
  'Place ' || c AS places,
  coalesce(r.c_name, '4' || c || '-1') || ' aut / Name, edt / Heading ' || c || ' cre' AS contributors,
  'h1, h' || c AS body_variants, CASE WHEN k = 'sbd' THEN 'Series ' || c || ' / Parent ' || c ELSE 'Series ' || c END AS is_part_of,
  CASE WHEN u = '5' THEN 'Zweite Sammlung' ELSE 'Erste Sammlung' END AS collections, CASE WHEN k = 'sm' THEN c || '-1' END AS zdb_id, '1' || c AS schoene_nummer,
  CASE WHEN u = '2' THEN '= Parallel ' || c END AS other_title, 'Note' AS note
FROM o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) r ON r.c_custkey = o.o_custkey WHERE NOT (k = 'sm' AND u = '4')
""")
def linked_title_records(t):
    rows = _linked(t)
    event = F.get("publication", F.lit(0))
    agents = F.transform(
        "contribution", lambda c: F.concat(c["agent"]["label"], F.lit(" "), F.element_at(F.split(c["role"]["id"], "/"), -1))
    )
    above = F.transform("is_part_of", lambda p: F.get(p["has_superordinate"], F.lit(0))["label"])
    return rows.select(
        "local_id", "id", F.array_join("type", " ").alias("type"), "title", event["start_date"].alias("start_date"), event["date_statement"].alias("date_statement"),
        F.get(event["location"], F.lit(0)).alias("location"), F.get(event["published_by"], F.lit(0)).alias("publisher"),
        F.array_join(F.transform("subject", lambda s: s["label"]), " / ").alias("subjects"),
        F.array_join(F.transform("spatial", lambda s: s["label"]), " / ").alias("places"),
        F.array_join(agents, " / ").alias("contributors"),
        F.array_join(F.try_element_at("contribution", F.lit(-1))["agent"]["alt_label"], ", ").alias("body_variants"),
        F.array_join(above, " / ").alias("is_part_of"),
        F.array_join(F.transform("in_collection", lambda c: c["label"]), ", ").alias("collections"), "zdb_id", "schoene_nummer",
        F.get("other_title_information", F.lit(0)).alias("other_title"), F.array_join("note", ", ").alias("note"),
    )


@query(BASE + """
SELECT local_id AS id, 'zdb_id' AS path, 'pattern' AS rule FROM o WHERE k = 'sm' AND u <> '4' AND length(c) > 7
""".replace("length(c) > 7", "NOT regexp_matches(c || '-1', '^\\d{1,7}-[Xx\\d]$')") + """
UNION ALL SELECT local_id, 'local_id', 'pattern' FROM o WHERE local_id LIKE 'w%' AND NOT (k = 'sm' AND u = '4')
""")
def title_contract(t):
    """Finished titles against the published contract and one house rule."""
    rows = _linked(t)
    checks = [*quality.title_contract(NS.resource), quality.pattern("local_id", "^o")]
    return quality.validate(rows, "local_id", checks)


@query(BASE + """
SELECT local_id, CASE WHEN u = '2' THEN 'In: Journal, S. 3-2' WHEN u = '3' THEN 'In: Host. - 3 (' || y || '), ' ELSE 's. spez. Felder (volume, issue, etc.)' END AS citation,
  'Link ' || c || ' 1 (' || y || ') 7  Seite 5-' || u AS linked_citation FROM o WHERE k = 'u'
""")
def title_citations(t):
    """Sources as text, and linked sources put together from their parts."""
    entries = titles.as_entries(legacy_titles(title_records(t))).where("type = 'u'")
    linked = F.transform(
        "citations",
        lambda c: F.struct(
            F.lit("http://x").alias("value"), F.concat(F.lit("Link "), F.element_at(F.split("union_id", "HT"), -1)).alias("label"), F.lit("1").alias("volume"),
            c["year"].alias("year"), F.lit("7").alias("issue"), F.lit(None).cast("string").alias("alternative_numbering"),
            F.concat(F.lit("5-"), c["volume"]).alias("pages"),
        ),
    )
    return entries.select(
        "local_id", titles.citations(F.col("citations")).alias("citation"), titles.citations(linked).alias("linked_citation")
    )


@query("""
SELECT 'o' || p_partkey AS local_id, CASE WHEN p_type = 'SMALL' THEN 'Book' WHEN p_type = 'PROMO' THEN 'CreativeWork' ELSE 'Article' END AS type,
  p_name AS name, CAST(p_size AS VARCHAR) AS "numberOfPages", p_brand AS "bookEdition" FROM part
""")
def schema_org_view(t):
    kind = F.when(F.col("p_type") == "SMALL", "MultiVolumeBook").when(F.col("p_type") == "PROMO", "Map").otherwise("Article")
    rows = t.part.select(
        text("o", "p_partkey").alias("local_id"), kind.alias("kind"), F.col("p_name").alias("title"),
        F.col("p_size").cast("string").alias("extent"), F.col("p_brand").alias("edition"),
    )
    return titles.to_schema_org(rows, "kind")


@query(BASE + """
SELECT local_id, 'second' AS collection FROM o WHERE u = '5' UNION ALL SELECT local_id, 'first' FROM o WHERE u <> '5'
""")
def titles_by_collection(t):
    rows = legacy_titles(title_records(t))
    mark = F.col("in_collection")
    return route_collections(rows, {"first": mark.isin("nur erste", "beide"), "second": mark.isin("nur zweite", "beide")}).select("local_id", "collection")


# --- persons ----------------------------------------------------------------------------------


def person_records(t):
    """Tagged person line of each customer."""
    key = F.col("c_custkey").cast("string")
    kind = F.col("c_mktsegment")
    nation = F.col("c_nationkey").cast("string")
    lines = t.wide("customer").select(
        tagged_line(
            F.concat(F.lit("p"), key), around("#82b", F.when(F.col("c_acctbal") > 0, F.concat(F.lit("1"), key, F.lit("n5")))),
            F.when(kind == "MACHINERY", "#14 x"), F.concat(F.lit("#1na"), "c_name", F.lit(" / 1850-1912")),
            F.concat(F.lit("#1ncVar A"), key, F.lit("@Var B@Var A"), key), F.lit("#1ndVar B@Other"),
            F.concat(F.lit("#1nn_4"), key, F.lit("n1_@_b"), nation, F.lit("_")), F.concat(F.lit("#1no_o"), nation, F.lit("_@Mainz")),
            F.concat(F.lit("#1np0"), F.lit("4.05.18"), F.lpad(nation, 2, "0")), F.concat(F.lit("#1nq_o"), nation, F.lit("_")), F.lit("#1nrMärz 1908"), F.lit("#1nsTrier"),
            F.concat(F.lit("#1nt_1"), key, F.lit("_@Other, A / 1800-")), F.lit("#1nvw"), F.concat(F.lit("#1nw_swn"), nation, F.lit("x2p_")),
            F.lit("#1ny20240312"), F.lit("#1z1First."), F.concat(F.lit("#1z2Second "), key), F.lit("#1ä1Third"),
        ).alias("value")
    )
    return split_volumes(checked_lines(lines))


PERSON = "WITH p AS (SELECT *, CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS n FROM customer) "


@query(PERSON + f"""
SELECT 'p' || k AS local_id, CASE WHEN c_acctbal > 0 THEN '1' || k || '-5' ELSE 'Keine GND-Ansetzung für p' || k END AS authority_id,
  c_name || ' / 1850-1912' AS preferred_name, c_mktsegment = 'MACHINERY' AS do_not_index, 'Var A' || k || '|Var B|Var A' || k AS variants,
  '{NS.authority}4' || k || '-1|{NS.heading}b' || n AS professions, '{NS.spatial}' || n || '|Mainz' AS places, '{NS.spatial}' || n AS born_in, '1' || k || '|Other, A / 1800-' AS related,
  '{NS.field}' || n || '.2p' AS fields, '2024-03-12' AS date_modified, 'First.' || chr(10) || chr(10) || 'Second ' || k || '|Third' AS biography, 'weiblich' AS gender
FROM p
""")
def legacy_person_entries(t):
    rows = persons.legacy_persons(person_records(t))

    def joined(name, out):
        return F.array_join(name, "|").alias(out)

    return rows.select(
        "local_id", "authority_id", "preferred_name", "do_not_index", joined("variant_name", "variants"), joined("profession", "professions"),
        joined("place_of_activity", "places"), F.col("place_of_birth").alias("born_in"), joined("related_person", "related"),
        joined("subject_category", "fields"), "date_modified", joined("biography", "biography"), "gender",
    )


@query(PERSON + f"""
SELECT 'p' || k AS local_id, CASE WHEN c_acctbal > 0 THEN '{NS.authority}1' || k || '-5' ELSE '{NS.person}p' || k END AS id, c_name AS preferred_name,
  'Var A' || k || '|Var B|Other' AS variants, 'Weiblich' AS gender, '18' || lpad(n, 2, '0') || '-05-04' AS born, 'März 1908' AS died FROM p WHERE c_mktsegment <> 'MACHINERY'
""")
def linked_person_records(t):
    rows = persons.linked_persons(persons.legacy_persons(person_records(t)))
    return rows.select(
        "local_id", "id", "preferred_name", F.array_join("variant_name", "|").alias("variants"), F.get("gender", F.lit(0))["label"].alias("gender"),
        F.get("date_of_birth", F.lit(0)).alias("born"), F.get("date_of_death", F.lit(0)).alias("died"),
    )


# what the lookups of a person give, by (k, n)
PERSON_LOOKUPS = PERSON + f"""
, l AS (
  SELECT p.*, CASE WHEN n_regionkey <> 0 THEN n_name || CASE WHEN n_regionkey = 2 THEN ' again' ELSE '' END ELSE '{NS.spatial}' || n END AS place,
    CASE WHEN n_regionkey = 1 THEN n_name END AS category, c_acctbal > 0 AS known, n_regionkey <> 3 AND c_acctbal > 0 AS pictured,
    CASE WHEN c_acctbal > 0 THEN '1' || k || '-5' ELSE 'Keine GND-Ansetzung für p' || k END AS gnd
  FROM p JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'MACHINERY'
)
"""


@query(PERSON_LOOKUPS + f"""
SELECT 'p' || k AS local_id, CASE WHEN known THEN '{NS.authority}' || gnd ELSE '{NS.person}p' || k END AS id, gnd AS authority_id, '{NS.person_context}' AS context,
  'AuthorityResource|Person|DifferentiatedPerson' AS type, c_name AS preferred_name, 'Var A' || k || '|Var B|Other' AS variant_name,
  '{NS.gender}female=Weiblich' AS gender, '18' || lpad(n, 2, '0') || '-05-04' AS date_of_birth, 'März 1908' AS date_of_death, '' AS period_of_activity,
  'First.' || chr(10) || chr(10) || 'Second ' || k || '|Third' AS biographical_information, '2024-03-12' AS date_modified, '' AS source, '' AS publication,
  '{NS.spatial}' || n || '=' || place AS place_of_birth, 'Trier=Trier' AS place_of_death, '{NS.spatial}' || n || '=' || place || '|Mainz=Mainz' AS place_of_activity,
  '{NS.authority}4' || k || '-1=' || CASE WHEN known THEN c_name ELSE '4' || k || '-1' END || '=|{NS.heading}b' || n || '=' || '{NS.heading}b' || n || '=' AS profession,
  CASE WHEN category IS NOT NULL THEN '{NS.subject_category}' || n || '.2p=' || category ELSE '{NS.field}' || n || '.2p=' END AS subject_category,
  '1' || k || '=1' || k || '|Other, A / 1800-=Other, A / 1800-' AS related_person,
  CASE WHEN pictured THEN 'i' || gnd || '=http://img/' || gnd || '=http://img/small/' || gnd ELSE '' END AS depiction,
  concat_ws('|', CASE WHEN known THEN 'http://a/' || gnd || '=A' END, CASE WHEN known AND c_acctbal > 5000 THEN 'http://b/' || k || '=Z' END) AS same_as
FROM l
""")
def whole_person_records(t):
    """Every field of a linked person, with all lookups in one join."""
    known = t.customer.where("c_acctbal > 0").withColumn("gnd", F.concat(F.lit("1"), "c_custkey", F.lit("-5")))
    twice = t.customer.where("c_acctbal > 5000").select(
        F.concat(F.lit("1"), "c_custkey", F.lit("-5")).alias("k"), text("http://b/", "c_custkey").alias("url"),
        F.explode(F.array(F.lit("B"), F.lit("Z"))).alias("name"),
    )
    words = vocabularies(t)
    vocab = persons.PersonVocabularies(
        places=vocabulary(t.nation.where("n_regionkey <> 0").select(text(NS.spatial, "n_nationkey").alias("k"), "n_name"), label="n_name"),
        more_places=vocabulary(t.nation.where("n_regionkey = 2").select(F.col("n_name").alias("k"), F.concat("n_name", F.lit(" again")).alias("v")), label="v"),
        headings=vocabulary(words.headings, label="label", variants="variants"),
        authorities=vocabulary(words.authorities, label="label"),
        categories=vocabulary(t.nation.where("n_regionkey = 1").select(F.concat("n_nationkey", F.lit(".2p")).alias("k"), "n_name"), label="n_name"),
        persons=vocabulary(known, "gnd", label="c_name"),
        own_persons=vocabulary(t.nation, "n_name", label="n_name"),
        images=vocabulary(
            known.join(t.nation.where("n_regionkey <> 3"), F.col("c_nationkey") == F.col("n_nationkey")).select(
                F.col("gnd").alias("k"), F.concat(F.lit("i"), "gnd").alias("id"), F.concat(F.lit("http://img/"), "gnd").alias("url"),
                F.concat(F.lit("http://img/small/"), "gnd").alias("small"),
            ), label="id", url="url", detail="small",
        ),
        feeds=[
            vocabulary(known.select(F.col("gnd").alias("k"), F.concat(F.lit("http://a/"), "gnd").alias("url"), F.lit("A").alias("name")), url="url", label="name"),
            vocabulary(twice, url="url", label="name"),
        ],
    )
    rows = persons.whole_persons(persons.legacy_persons(person_records(t)), vocab)

    def listed(name, *parts):
        one = lambda x: F.concat_ws("=", *[F.coalesce(p(x), F.lit("")) for p in parts])
        return F.coalesce(F.array_join(F.transform(name, one), "|"), F.lit("")).alias(name)

    field = lambda *names: [lambda x, n=n: x[n] for n in names]
    return rows.select(
        "local_id", "id", "authority_id", "context", F.array_join("type", "|").alias("type"), "preferred_name", F.array_join("variant_name", "|").alias("variant_name"),
        listed("gender", *field("id", "label")), listed("date_of_birth", lambda x: x), listed("date_of_death", lambda x: x), listed("period_of_activity", lambda x: x),
        listed("biographical_information", lambda x: x), F.col("described_by.date_modified").alias("date_modified"),
        F.coalesce(F.array_join("described_by.source", "|"), F.lit("")).alias("source"), listed("publication", lambda x: x),
        listed("place_of_birth", *field("id", "label")), listed("place_of_death", *field("id", "label")), listed("place_of_activity", *field("id", "label")),
        listed("profession", *field("id", "label"), lambda x: F.array_join(x["alt_label"], ",")), listed("subject_category", *field("id", "label")),
        listed("related_person", *field("id", "label")), listed("depiction", *field("id", "url", "thumbnail")),
        listed("same_as", lambda x: x["id"], lambda x: x["collection"]["name"]),
    )


@query(PERSON + """
, l AS (SELECT k, CASE WHEN n_regionkey <> 0 THEN n_name || CASE WHEN n_regionkey = 2 THEN ' again' ELSE '' END END AS place, n FROM p JOIN nation ON c_nationkey = n_nationkey)
SELECT 'p' || k AS local_id, coalesce(place, '""" + NS.spatial + """' || n) || ', Mainz' AS active_in, coalesce(place, '""" + NS.spatial + """' || n) AS born_in, 'Trier' AS died_in FROM l
""")
def person_places(t):
    """Places of persons by role: spatial tree, then a second table, else the text itself."""
    rows = persons.legacy_persons(person_records(t))
    refs = persons.place_references(rows, {"active": "place_of_activity", "born": "place_of_birth", "died": "place_of_death"})
    tree = t.nation.where("n_regionkey <> 0").select(text(NS.spatial, "n_nationkey").alias("k"), F.col("n_name").alias("v"))
    more = t.nation.where("n_regionkey = 2").select(F.col("n_name").alias("k"), F.concat("n_name", F.lit(" again")).alias("v"))
    listed = persons.regroup(persons.place_labels(refs, tree, more), ["active", "born", "died"])

    def labels(name, out):
        return F.array_join(F.transform(name, lambda p: p["label"]), ", ").alias(out)

    return listed.select("local_id", labels("active", "active_in"), labels("born", "born_in"), labels("died", "died_in"))


@query(PERSON + f"""
SELECT 'p' || k AS local_id, CAST(0 AS INTEGER) AS pos, coalesce(r.c_name, '4' || k || '-1') AS label FROM p LEFT JOIN (SELECT c_custkey AS ck, c_name FROM customer WHERE c_acctbal > 0) r ON r.ck = p.c_custkey
UNION ALL SELECT 'p' || k, 1, '{NS.heading}b' || n FROM p
""")
def person_professions(t):
    rows = persons.legacy_persons(person_records(t))
    return persons.professions(rows, vocabularies(t)).select("local_id", "pos", "label")


@query(PERSON + f"""
SELECT 'p' || k AS local_id, CASE WHEN n_regionkey = 1 THEN '{NS.subject_category}' ELSE '{NS.field}' END || n || '.2p' AS id, CASE WHEN n_regionkey = 1 THEN n_name END AS label
FROM p JOIN nation ON n_nationkey = c_nationkey
""")
def person_categories(t):
    rows = persons.legacy_persons(person_records(t))
    known = t.nation.where("n_regionkey = 1").select(F.concat("n_nationkey", F.lit(".2p")).alias("k"), F.col("n_name").alias("v"))
    return persons.subject_categories(rows, known).drop("pos")


@query(PERSON + f"""
SELECT 'p' || k AS local_id, CAST(0 AS INTEGER) AS pos, CASE WHEN c_acctbal > 0 THEN c_name ELSE '1' || k END AS label FROM p
UNION ALL SELECT 'p' || k, 1, 'Other, A / 1800-' FROM p
""")
def person_relations(t):
    """Related persons by the authority file, then by the own set; text as it is."""
    rows = persons.legacy_persons(person_records(t)).withColumn(
        "related_person", F.transform("related_person", lambda v: F.when(v.rlike(r"^\d"), F.concat(F.lit(NS.person), v)).otherwise(v))
    )
    names = t.customer.where("c_acctbal > 0").select(text("1", "c_custkey").alias("k"), F.col("c_name").alias("label"))
    none = t.nation.select(F.col("n_name").alias("k"), F.col("n_name").alias("v"))
    return persons.related_labels(rows, names, none).select("local_id", "pos", "label")


@query("SELECT 'p' || c_custkey AS k, c_name AS v FROM customer WHERE c_acctbal <= 0")
def own_person_labels(t):
    return authorities.own_person_labels(persons.legacy_persons(person_records(t)))


# --- headings ---------------------------------------------------------------------------------


def heading_records(t):
    lines = t.wide("part").select(
        tagged_line(
            F.concat(F.lit("00S"), F.col("p_partkey").cast("string")), F.when(F.col("p_type") == "PROMO", "#82b1n2"),
            F.concat(F.lit("#3na"), "p_name"), F.concat(F.lit("#3nb"), "p_brand"), F.concat(F.lit("#3nc"), "p_type"), F.concat(F.lit("#3ra"), "p_size"),
            F.concat(F.lit("#99z"), F.when(F.col("p_type") == "SMALL", "Sx").when(F.col("p_type") == "ECONOMY", "G").otherwise("q")),
        ).alias("value")
    )
    return split_volumes(checked_lines(lines))


@query("""
SELECT '00S' || p_partkey AS local_id, p_name AS preferred_name, p_brand || '; ' || p_type AS variants, CAST(p_size AS VARCHAR) AS related,
  CASE p_type WHEN 'SMALL' THEN 'Sachschlagwort' WHEN 'ECONOMY' THEN 'Geografikum' ELSE 'N/A' END AS type FROM part WHERE p_type <> 'PROMO'
""")
def local_headings(t):
    rows = authorities.authorities(heading_records(t))
    return rows.select(
        "local_id", "preferred_name", F.array_join("variant_name", "; ").alias("variants"), F.array_join("related_entity", "; ").alias("related"), "type"
    )


@query("SELECT '00S' || p_partkey AS k, p_name AS label, p_brand || '; ' || p_type AS variants FROM part WHERE p_type <> 'PROMO'")
def heading_lookup_table(t):
    return authorities.heading_table(authorities.authorities(heading_records(t)))


@query("""
SELECT c_custkey, n_name AS label, n_nationkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3
UNION ALL SELECT c_custkey, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3
""")
def images_of_persons(t):
    """Images known for the nations of most regions, several values in one lookup."""
    known = t.nation.where("n_regionkey <> 3").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("id"))
    rows = lookup.lookup_wide(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", known, "key", ["label", "id"])
    return rows.select("c_custkey", "label", "id")
