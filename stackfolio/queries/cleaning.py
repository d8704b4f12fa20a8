"""Cleaning and derivation of single values, with codes composed from keys, dates and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, identifiers as ids, isbn, text as texts
from ..naming import Namespaces
from ..operators.shape import split_values
from ..plans import authorities, legacy_titles, marc_links, persons, repairs, titles
from .bindings import concepts, isbn12, text
from .registry import query

NS = Namespaces()
KEY = "CAST(o_orderkey AS VARCHAR)"


@query(f"""
SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN '{NS.heading}00' || {KEY} || 'a' ELSE '{NS.authority}4' || {KEY} || '-' || substr(o_orderpriority, 1, 1) END AS heading,
  CASE WHEN o_orderstatus = 'F' THEN '{NS.heading}107n' || {KEY} WHEN o_orderstatus = 'O' THEN '{NS.authority}4' || {KEY} || '-X' ELSE 'Name,' END AS agent,
  '{NS.subject}' || o_custkey AS subject, '{NS.field}' || o_custkey || '.' || substr(o_orderpriority, 1, 1) || 'p' AS field,
  CASE WHEN o_orderstatus = 'F' THEN '{NS.spatial}' || o_custkey ELSE 'Mainz' END AS place,
  CASE WHEN o_orderstatus = 'F' THEN '{NS.authority}' || o_custkey || '-1' WHEN o_orderstatus = 'O' THEN '{NS.spatial}' || o_custkey ELSE '{NS.spatial}07' END AS spatial,
  CASE WHEN o_orderstatus = 'F' THEN '{NS.authority}' || o_custkey || '-1' ELSE '{NS.heading}b' || o_custkey END AS profession
FROM orders
""")
def uris_of_codes(t):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    status, digit = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    old, new = status == "F", status == "O"
    c = F.concat
    heading = F.when(old, c(F.lit("_00"), key, F.lit("a_"))).otherwise(c(F.lit("_4"), key, F.lit("n"), digit, F.lit("_")))
    agent = F.when(old, c(F.lit("_107n"), key, F.lit("_: Name"))).when(new, c(F.lit("_4"), key, F.lit("nX_"))).otherwise("Name, Vorname")
    place = F.when(old, c(F.lit("_o"), cust, F.lit("_"))).otherwise("Mainz")
    spatial = (
        F.when(old, c(F.lit("_r30_ _"), cust, F.lit("n1_"))).when(new, c(F.lit("_r99_ _o"), cust, F.lit("_"))).otherwise("_r07_")
    )
    return t.orders.select(
        "o_orderkey",
        ids.heading_uri(heading).alias("heading"),
        ids.agent_uri(agent).alias("agent"),
        ids.subject_uri(c(F.lit("_sn"), cust, F.lit("_"))).alias("subject"),
        ids.field_uri(c(F.lit("_swn"), cust, F.lit("x"), digit, F.lit("p_"))).alias("field"),
        ids.place_uri(place).alias("place"),
        ids.spatial_uri(spatial).alias("spatial"),
        ids.profession_uri(F.when(old, c(F.lit("_"), cust, F.lit("n1_"))).otherwise(c(F.lit("_b"), cust, F.lit("_")))).alias("profession"),
    )


@query(f"""
SELECT o_orderkey, '{NS.authority}' || o_custkey || '-X|z' AS chains FROM orders WHERE o_orderstatus = 'F'
""")
def repaired_headings(t):
    """Chains with an id that ends in ``nX``; others are not given out."""
    bad = F.concat(F.lit(NS.authority), "o_custkey", F.when(F.col("o_orderstatus") == "F", "nX").otherwise("-X"))
    rows = t.orders.select("o_orderkey", F.array(F.array(bad, F.lit("z"))).alias("chains"))
    fixed = repairs.repair_headings(rows, "o_orderkey", "chains")
    return fixed.withColumn("chains", F.array_join(F.flatten("chains"), "|"))


@query(f"""
SELECT o_orderkey, '{NS.heading}121n' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS agents FROM orders WHERE o_orderstatus <> 'O'
""")
def repaired_agents(t):
    code = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    value = F.when(F.col("o_orderstatus") == "O", F.lit("Name")).otherwise(F.concat(F.lit(NS.authority + "121-"), code))
    rows = t.orders.select("o_orderkey", F.array(value, value).alias("agents"))
    return repairs.repair_agents(rows, "o_orderkey", "agents").withColumn("agents", F.array_join("agents", "|"))


@query(f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '{NS.spatial}00S' || o_custkey ELSE '{NS.spatial}' || o_custkey || 'n1' END AS node,
  o_orderstatus, o_custkey FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey, node || '|other' AS places FROM o
WHERE node IN (SELECT '{NS.spatial}00S' || c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT '{NS.spatial}' || c_custkey || 'n1' FROM customer WHERE c_acctbal > 5000)
""")
def repaired_places(t):
    """Old place notations rewritten only if the node is in the tree."""
    status = F.col("o_orderstatus")
    value = (
        F.when(status == "F", F.concat(F.lit("_r19_ _00S"), "o_custkey", F.lit("_")))
        .when(status == "O", F.concat(F.lit(NS.authority), "o_custkey", F.lit("-1"))).otherwise("plain")
    )
    rows = t.orders.select("o_orderkey", F.array(value, F.lit("other")).alias("places"))
    first = t.customer.where("c_acctbal > 0").select(text(NS.spatial + "00S", "c_custkey").alias("id"))
    second = t.customer.where("c_acctbal > 5000").select(F.concat(F.lit(NS.spatial), "c_custkey", F.lit("n1")).alias("id"))
    fixed = repairs.repair_places(rows, "o_orderkey", "places", first.unionByName(second))
    return fixed.withColumn("places", F.array_join("places", "|"))


@query(f"""
SELECT o_orderkey, '{NS.spatial}' || CASE WHEN o_orderstatus = 'F' THEN '30' ELSE '32' END AS places,
  CASE WHEN o_orderstatus = 'F' THEN '{NS.authority}' || o_custkey || '-X|' ELSE '{NS.heading}00S' || o_custkey || '|' END || 'old' AS headings
FROM orders WHERE o_orderstatus <> 'P'
""")
def split_places(t):
    status = F.col("o_orderstatus")
    value = (
        F.when(status == "F", F.concat(F.lit("_r30_ _"), "o_custkey", F.lit("nX_")))
        .when(status == "O", F.concat(F.lit("_r32_ _00S"), "o_custkey", F.lit("_"))).otherwise("plain")
    )
    rows = t.orders.select("o_orderkey", F.array(value).alias("places"), F.array(F.lit("old")).alias("headings"))
    fixed = repairs.split_places(rows, "o_orderkey", "places", "headings")
    return fixed.select("o_orderkey", F.array_join("places", "|").alias("places"), F.array_join("headings", "|").alias("headings"))


@query(f"""
SELECT o_orderkey, '{NS.spatial}4116352n7|x' AS places, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE '{NS.authority}4680138-8|' END ||
  CASE WHEN o_orderpriority = '5-LOW' THEN '{NS.authority}4680138-8' ELSE 'old' END AS headings FROM orders WHERE o_orderstatus = 'F'
""")
def replaced_places(t):
    old = F.lit(NS.authority + "4680138-8")
    value = F.when(F.col("o_orderstatus") == "F", old).otherwise("y")
    heading = F.when(F.col("o_orderpriority") == "5-LOW", old).otherwise("old")
    rows = t.orders.select("o_orderkey", F.array(value, F.lit("x")).alias("places"), F.array(heading).alias("headings"))
    fixed = repairs.replace_places(rows, "o_orderkey", "places", "headings")
    return fixed.select("o_orderkey", F.array_join("places", "|").alias("places"), F.array_join("headings", "|").alias("headings"))


@query(f"""
SELECT DISTINCT '{NS.authority}' || o_custkey || '-1' AS place, '{NS.spatial}' || o_custkey || 'n1' AS broader FROM orders WHERE o_orderstatus = 'F'
UNION SELECT '{NS.authority}' || o_custkey, '{NS.spatial}31' FROM orders WHERE o_orderstatus = 'O'
""")
def wider_places_learned(t):
    status = F.col("o_orderstatus")
    fields = t.orders.select(
        F.col("o_orderkey").alias("rec_id"),
        F.posexplode(
            F.when(
                status == "F",
                F.array(F.concat(F.lit("_r96_ _"), "o_custkey", F.lit("n1_"))),
            ).when(status == "O", F.array(F.lit("_r07_"), F.concat(F.lit("_r31_ _"), "o_custkey", F.lit("_")))).otherwise(F.array(F.lit("_r07_")))
        ).alias("seq", "value"),
    ).withColumn("tag", F.lit("f31_"))
    return repairs.wider_places(fields)


@query("""
WITH s AS (SELECT c_custkey, CAST(CAST(floor(abs(c_acctbal) / 4) AS BIGINT) AS VARCHAR) AS b, CAST(CAST(floor(abs(c_acctbal) / 6) AS BIGINT) AS VARCHAR) AS d, c_mktsegment AS m FROM customer)
SELECT c_custkey,
  CASE WHEN m = 'BUILDING' THEN NULL ELSE CASE WHEN m = 'MACHINERY' THEN '-' ELSE '' END || lpad(b, 4, '0') END AS born,
  CASE WHEN m = 'HOUSEHOLD' THEN '-' ELSE '' END || lpad(d, 4, '0') AS died, CASE WHEN m = 'BUILDING' THEN 'ca. ' || b || '-' || d END AS approximate FROM s
""")
def life_dates(t):
    born = F.floor(F.abs("c_acctbal") / 4).cast("bigint").cast("string")
    died = F.floor(F.abs("c_acctbal") / 6).cast("bigint").cast("string")
    kind = F.col("c_mktsegment")
    span = F.concat(
        F.when(kind == "BUILDING", "ca. ").when(kind == "MACHINERY", "v").otherwise(""), born, F.lit("-"),
        F.when(kind == "HOUSEHOLD", "v").otherwise(""), died,
    )
    return t.customer.select(
        "c_custkey", dates.birth_year(span).alias("born"), dates.death_year(span).alias("died"), dates.approximate_span(span).alias("approximate")
    )


@query("""
WITH o AS (SELECT o_orderkey, year(o_orderdate) - 100 * (CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) AS y, month(o_orderdate) AS m, CASE o_orderstatus WHEN 'F' THEN 31 WHEN 'O' THEN 29 ELSE 30 END AS d FROM orders)
SELECT o_orderkey, CAST(y AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || CASE
  WHEN m = 2 AND d > 29 THEN '28'
  WHEN m = 2 AND d = 29 AND NOT ((y BETWEEN 1800 AND 2099) AND y % 4 = 0 AND y NOT IN (1800, 1900)) THEN '28'
  WHEN m IN (4, 6, 9, 11) AND d = 31 THEN '30' ELSE CAST(d AS VARCHAR) END AS fixed FROM o
""")
def calendar_fixed(t):
    """Order dates with days that not every month has, over five centuries."""
    year = (F.year("o_orderdate") - 100 * (F.substring("o_orderpriority", 1, 1).cast("int") - 1)).cast("string")
    day = F.when(F.col("o_orderstatus") == "F", "31").when(F.col("o_orderstatus") == "O", "29").otherwise("30")
    date = F.concat_ws("-", year, F.date_format("o_orderdate", "MM"), day)
    return t.orders.select("o_orderkey", dates.calendar_fix(date).alias("fixed"))


@query("""
SELECT o_orderkey, 'um ' || strftime(o_orderdate, '%Y-%m-%d') AS dotted, strftime(o_orderdate, '%Y-%m-%d') AS compact, CAST(year(o_orderdate) AS VARCHAR) AS start_year FROM orders
""")
def iso_dates(t):
    dotted = F.concat(F.lit("um "), F.date_format("o_orderdate", "dd.MM.yyyy"))
    return t.orders.select(
        "o_orderkey", dates.dotted_to_iso(dotted).alias("dotted"),
        dates.compact_to_iso(F.date_format("o_orderdate", "yyyyMMdd")).alias("compact"),
        dates.start_year(F.concat(F.lit("[ca. "), F.year("o_orderdate"), F.lit("?]"))).alias("start_year"),
    )


def _check13(d: str) -> str:
    odd = " + ".join(f"CAST(substr({d}, {i}, 1) AS INT)" for i in range(1, 13, 2))
    even = " + ".join(f"3 * CAST(substr({d}, {i}, 1) AS INT)" for i in range(2, 13, 2))
    return f"CAST((10 - ({odd} + {even}) % 10) % 10 AS VARCHAR)"


def _check10(d: str) -> str:
    total = " + ".join(f"{11 - i} * CAST(substr({d}, {i}, 1) AS INT)" for i in range(1, 10))
    return f"CASE WHEN (11 - ({total}) % 11) % 11 = 10 THEN 'X' ELSE CAST((11 - ({total}) % 11) % 11 AS VARCHAR) END"


ISBN = "WITH k AS (SELECT p_partkey, p_name, '978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS d, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS n FROM part)"


@query(f"{ISBN} SELECT p_partkey, d || {_check13('d')} AS isbn13, n || {_check10('n')} AS isbn10 FROM k")
def isbn_forms(t):
    """Both forms from an ISBN-10 with hyphens."""
    first9 = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    raw = F.concat(F.substring(first9, 1, 1), F.lit("-"), F.substring(first9, 2, 8), F.lit("-"), isbn.check10(first9), F.lit(" (pbk.)"))
    forms = isbn.both_forms(F.array(raw))
    return t.part.select("p_partkey", F.get(forms, F.lit(1)).alias("isbn13"), F.get(forms, F.lit(0)).alias("isbn10"))


@query(f"""
WITH k AS (SELECT l_orderkey, l_partkey, '978' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS d FROM lineitem GROUP BY ALL),
g AS (SELECT d || {_check13('d')} AS isbn13, l_orderkey AS rec_id, count(*) OVER (PARTITION BY d) AS n, min(l_orderkey) OVER (PARTITION BY d) AS first_id FROM k)
SELECT isbn13, rec_id, first_id FROM g WHERE n > 1
""")
def isbn_clusters(t):
    """Orders that share a part, by the ISBN of the part."""
    lines = t.wide("lineitem", "l_orderkey", "l_partkey").select("l_orderkey", isbn12(F.col("l_partkey")).alias("d"))
    rows = lines.select("l_orderkey", F.array(F.concat("d", isbn.check13(F.col("d")))).alias("isbn"))
    return marc_links.isbn_cluster(rows, "l_orderkey", "isbn")


@query("""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '?') THEN replace(url, '://', ':/') WHEN length(url) > 45 THEN replace(url, '/', '/ ') ELSE url END AS link FROM pages)
SELECT page_id, link FROM u WHERE NOT regexp_matches(link, '^(https?|ftp)://(\\S+\\.)+\\S+(/\\S*)?$')
""")
def audited_urls(t):
    link = (
        F.when(F.col("url").contains("?"), F.regexp_replace("url", "://", ":/"))
        .when(F.length("url") > 45, F.regexp_replace("url", "/", "/ ")).otherwise(F.col("url"))
    )
    return marc_links.audit_urls(t.pages.select("page_id", link.alias("link")), "link")


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[^\\p{L}]+')) AS name FROM documents),
p AS (SELECT name, CASE WHEN regexp_matches(lower(name), '[äöü]') THEN name ELSE strip_accents(name) END AS plain FROM w)
SELECT name, 'old; ' || plain AS variants FROM p WHERE plain <> name
""")
def ascii_variants(t):
    """Words as headings that need a variant without accents."""
    headings = t.wide("documents", "text").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("name")).distinct()
    rows = headings.select("name", F.array(F.lit("old")).alias("old_variants"))
    found = authorities.ascii_variants(rows, "name", "name", "old_variants")
    return found.select("name", F.array_join("old_variants", "; ").alias("variants"))


@query("""
SELECT doc_id, md5(text) AS kept, length(text) AS n FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g') AS text FROM documents)
""")
def without_controls(t):
    """Control characters put into the texts, and what a text has itself, are gone; line breaks stay."""
    dirty = F.concat(F.char(F.lit(0x98)), F.regexp_replace("text", " ", F.concat(F.lit(" "), F.char(F.lit(1)))), F.char(F.lit(0x9C)))
    clean = texts.strip_controls(dirty)
    return t.documents.select("doc_id", clean.alias("clean")).select(
        "doc_id", F.md5("clean").alias("kept"), F.length("clean").cast("bigint").alias("n")
    )


@query("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'EditedVolume' WHEN p_size > 40 THEN 'MultiVolumeBook' WHEN p_type = 'SMALL' THEN 'Book' ELSE 'Miscellaneous' END AS kind FROM part
""")
def most_specific_types(t):
    types = F.filter(
        F.array(
            F.lit("BibliographicResource"), F.when(F.col("p_type") == "SMALL", "Book"), F.when(F.col("p_size") > 40, "MultiVolumeBook"),
            F.when(F.col("p_type") == "PROMO", "EditedVolume"),
            F.when((F.col("p_type") != "SMALL") & (F.col("p_size") <= 40) & (F.col("p_type") != "PROMO"), "Miscellaneous"),
        ),
        lambda x: x.isNotNull(),
    )
    return t.part.select("p_partkey", titles.most_specific_type(types).alias("kind"))


@query("""
SELECT o_orderkey, 'Serie ' || o_orderpriority AS value, CAST(o_custkey AS VARCHAR) AS numbering FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'Serie ' || o_orderpriority, NULL FROM orders WHERE o_orderstatus <> 'F'
""")
def split_series(t):
    tail = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" ; x ; "), "o_custkey")).otherwise("")
    rows = t.orders.select("o_orderkey", legacy_titles.series_parts(F.concat(F.lit("Serie "), "o_orderpriority", tail)).alias("s"))
    return rows.select("o_orderkey", "s.value", "s.numbering")


@query("""
SELECT c_custkey, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'Weiblich' WHEN 'HOUSEHOLD' THEN 'Männlich' ELSE 'Unbekannt' END AS gender,
  CASE WHEN c_acctbal > 0 THEN 'https://d-nb.info/gnd/1' || c_custkey ELSE 'https://example.org/persons/p' || c_custkey END AS id FROM customer
""")
def person_names(t):
    """Headings with sorting marks and life dates, gender codes, ids with and without authority record."""
    kind = F.col("c_mktsegment")
    dates_ = F.when(kind == "BUILDING", " / ca. 1850-1912").when(kind == "HOUSEHOLD", " / -1912").otherwise(" / 1850-")
    name = F.concat(F.lit("¬"), F.substring("c_name", 1, 1), F.lit("¬"), F.substring("c_name", 2, 100), dates_)
    code = F.when(kind == "BUILDING", "w").when(kind == "HOUSEHOLD", "mm")
    authority = F.when(F.col("c_acctbal") > 0, text("1", "c_custkey")).otherwise(F.concat(F.lit("Keine GND-Ansetzung für p"), "c_custkey"))
    return t.customer.select(
        "c_custkey", persons.clean_name(name).alias("name"),
        F.get(persons.gender_concept(persons.gender_word(code)), F.lit(0))["label"].alias("gender"),
        persons.person_uri(text("p", "c_custkey"), authority).alias("id"),
    )


@query("""
SELECT 'c' || c_custkey AS notation, CAST(c_custkey AS VARCHAR) AS short_id FROM customer UNION ALL SELECT 'n' || n_nationkey, CAST(n_nationkey AS VARCHAR) FROM nation
UNION ALL SELECT 'r' || r_regionkey, CAST(r_regionkey AS VARCHAR) FROM region
""")
def short_ids(t):
    return concepts(t).select("notation", texts.short_id(F.col("id")).alias("short_id"))


@query("""
SELECT p_partkey AS k, p_brand AS label, array_to_string(string_split(p_name, ' '), '; ') AS variants FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
""")
def label_map_of_used(t):
    """Lookup table from all parts, for the ones in use only."""
    records = t.part.select("p_partkey", F.col("p_brand").alias("label"), split_values(F.col("p_name"), " ").alias("variants"))
    used = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return authorities.build_label_map(records, "p_partkey", ["label", "variants"], used)


@query("""
SELECT doc_id, regexp_extract(text, '(\\d{3,4})', 1) AS year FROM documents WHERE regexp_extract(text, '(\\d{3,4})', 1) <> ''
""")
def years_in_texts(t):
    found = t.documents.select("doc_id", dates.start_year(F.col("text")).alias("year"))
    return found.where("year IS NOT NULL")


