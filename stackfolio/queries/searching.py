"""Search conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import positions, search
from ..session import scratch_path
from .bindings import text
from .registry import query

TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query(f"""
SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'of'])
""")
def search_all_terms(t):
    return t.wide("documents", "doc_id", "text").where(search.has_all_terms(F.col("text"), "the-of")).select("doc_id")


@query(f"SELECT doc_id AS rec_id FROM documents WHERE list_has_all({TOKENS}, ['la', 'de', 'un'])")
def search_by_index(t):
    return search.search_index(search.token_index(t.wide("documents", "doc_id", "text"), "doc_id", "text"), "la de un")


@query(f"""
SELECT doc_id FROM documents WHERE (list_contains({TOKENS}, 'the') AND NOT list_contains({TOKENS}, 'of'))
  OR len(list_filter({TOKENS}, lambda w: w LIKE 'sch%')) > 0
""")
def search_with_operators(t):
    return t.wide("documents", "doc_id", "text").where(search.has_all_terms(F.col("text"), "+the -of OR sch*")).select("doc_id")


def _index(t):
    return search.token_index(t.wide("documents", "doc_id", "text"), "doc_id", "text")


@query(f"""
SELECT doc_id AS rec_id FROM documents WHERE (list_contains({TOKENS}, 'the') AND NOT list_contains({TOKENS}, 'of'))
  OR len(list_filter({TOKENS}, lambda w: w LIKE 'sch%')) > 0
""")
def index_with_operators(t):
    return search.search_index(_index(t), "+the -of OR sch*")


@query(f"SELECT doc_id AS rec_id FROM documents WHERE len({TOKENS}) > 0 AND NOT list_contains({TOKENS}, 'de')")
def index_without_word(t):
    return search.search_index(_index(t), "-de")


@query(f"SELECT doc_id AS rec_id FROM documents WHERE len({TOKENS}) > 0")
def index_of_all(t):
    return search.search_index(_index(t), "")


AT_REST: dict[tuple[str, str], str] = {}
FIELDS = {"text": "text", "source": "source"}
LINES = """
WITH l AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS text,
  ' ' || trim(regexp_replace(lower(coalesce(source, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS source FROM documents)
"""


def _at_rest(t, asked):
    """An index of all documents is written once per session and folder, and searched many times."""
    place = (t.spark.sparkContext.applicationId, t.folder)
    if place not in AT_REST:
        path = scratch_path(t.spark, "word-index")
        positions.write_index(t.wide("documents", "doc_id", *FIELDS), path, "doc_id", FIELDS)
        AT_REST[place] = path
    return positions.search_at_rest(t.spark, AT_REST[place], asked, list(FIELDS))


@query(LINES + "SELECT doc_id AS rec_id FROM l WHERE text LIKE '% de la %' OR source LIKE '% de la %'")
def search_phrase(t):
    return _at_rest(t, '"de la"')


@query(LINES + "SELECT doc_id FROM l WHERE text LIKE '% de la %' OR source LIKE '% de la %'")
def scan_phrase(t):
    fields = {name: F.col(column) for name, column in FIELDS.items()}
    return t.wide("documents", "doc_id", *FIELDS).where(positions.answers(fields, '"de la"')).select("doc_id")


@query(LINES + "SELECT doc_id AS rec_id FROM l WHERE source LIKE '% src7 %' AND text LIKE '% the %'")
def search_fields(t):
    return _at_rest(t, "source:src7 AND text:the")


@query(LINES + """
SELECT doc_id AS rec_id FROM l WHERE (text LIKE '% the %' OR text LIKE '% la %' OR source LIKE '% the %' OR source LIKE '% la %')
  AND NOT (text LIKE '% of %' OR text LIKE '% des %') AND (source LIKE '% src1 %' OR source LIKE '% src2 %' OR text LIKE '% dans %')
""")
def search_brackets(t):
    return _at_rest(t, "(the OR la) -text:(of OR des) AND (source:(src1 OR src2) OR text:dans)")


@query(LINES + """
SELECT doc_id AS rec_id FROM l WHERE NOT (text LIKE '% dans la %' OR source LIKE '% dans la %')
  AND (NOT text LIKE '% sch%' OR source LIKE '% src3 %')
""")
def search_without_phrase(t):
    """A query that records without any of its words can answer."""
    return _at_rest(t, '-"dans la" AND (-text:sch* OR source:src3)')


@query(LINES + """
SELECT doc_id FROM l WHERE NOT (text LIKE '% dans la %' OR source LIKE '% dans la %')
  AND (NOT text LIKE '% sch%' OR source LIKE '% src3 %')
""")
def scan_without_phrase(t):
    fields = {name: F.col(column) for name, column in FIELDS.items()}
    asked = positions.answers(fields, '-"dans la" AND (-text:sch* OR source:src3)')
    return t.wide("documents", "doc_id", *FIELDS).where(asked).select("doc_id")


CONTRIB = """
WITH c AS (SELECT o_orderkey, 'Customer ' || o_custkey AS l1, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'Person' END AS t1,
  o_orderpriority AS l2, 'CorporateBody' AS t2, o_custkey FROM orders)
"""


def _contributions(t):
    """Orders with two contributors: the customer and the priority, a body."""
    def entry(label, kind, uri):
        return F.struct(
            label.alias("label"), F.array(F.concat(F.lit("alias of "), label)).alias("alt_label"), uri.alias("id"),
            F.filter(F.array(kind), lambda k: k.isNotNull()).alias("type"),
        )

    person = F.when(F.col("o_orderstatus") != "P", "Person")
    return t.orders.select(
        "o_orderkey",
        F.array(
            entry(text("Customer ", "o_custkey"), person, text("https://d-nb.info/gnd/", "o_custkey")),
            entry(F.col("o_orderpriority"), F.lit("CorporateBody"), F.lit("http://x/")),
        ).alias("contribution"),
    )


@query(CONTRIB + "SELECT o_orderkey FROM c WHERE (o_custkey = 7 AND (t1 IS NULL OR t1 = 'Person')) ")
def search_person_by_name(t):
    """The name and the kind must be those of one and the same contributor."""
    return _contributions(t).where(search.contributor_is(F.col("contribution"), "customer AND 7", "Person")).select("o_orderkey")


@query(CONTRIB + "SELECT o_orderkey FROM c WHERE l2 = '2-HIGH' OR (o_custkey = 2 AND t1 IS NULL AND l1 LIKE '% high%')")
def search_body_by_alias(t):
    return _contributions(t).where(search.contributor_is(F.col("contribution"), "alias high", "CorporateBody")).select("o_orderkey")


@query(CONTRIB + "SELECT o_orderkey FROM c WHERE o_custkey = 12 AND (t1 IS NULL OR t1 = 'Person')")
def search_person_by_id(t):
    return _contributions(t).where(search.contributor_is(F.col("contribution"), "12", "Person")).select("o_orderkey")


@query("""
SELECT p_partkey, list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'bolt') AS all_of,
  list_contains(string_split(p_name, ' '), 'red') OR list_contains(string_split(p_name, ' '), 'bolt') AS any_of FROM part
""")
def values_all_or_any(t):
    ws = F.split("p_name", " ")
    return t.part.select(
        "p_partkey", search.has_values(ws, "red,bolt,AND").alias("all_of"), search.has_values(ws, "red,bolt").alias("any_of")
    )


@query("""
SELECT o_orderkey, year(o_orderdate) = 1996 AS one, year(o_orderdate) BETWEEN 1995 AND 1997 AS span, year(o_orderdate) >= 1998 AS later FROM orders
""")
def issued_ranges(t):
    year = F.year("o_orderdate")
    return t.orders.select(
        "o_orderkey", search.issued_range(year, "1996").alias("one"), search.issued_range(year, "1995-1997").alias("span"),
        search.issued_range(year, "1998-*").alias("later"),
    )


@query("""
SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1998 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'
  AND o_totalprice > 1000 AND o_custkey < 100000
""")
def search_many_conditions(t):
    """All conditions of a fielded search at once, with a dataset filter."""
    records = t.orders.select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.array("o_orderpriority").alias("media"),
        F.array("o_orderstatus").alias("types"), F.concat(F.lit("title "), "o_orderpriority").alias("title"),
    )
    fields = {"year": "year", "media": "media", "types": "types", "title": "title"}
    found = search.search(
        records, fields, dataset=F.col("o_totalprice") > 1000, issued="1995-1998", medium="1-URGENT,2-HIGH", t="O", name="title"
    )
    return found.select("o_orderkey")


@query("""
SELECT o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS asked, c_custkey
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def fetched_in_order(t):
    """Customers asked for by an ordered list that mixes keys and names."""
    key = F.col("o_custkey").cast("string")
    asked = t.orders.select(
        F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "F", key).otherwise(F.concat(F.lit("Customer#"), F.lpad(key, 9, "0"))).alias("asked")
    )
    found = search.fetch_many(t.customer.select("c_custkey", "c_name"), "c_custkey", ["c_custkey", "c_name"], asked, "pos", "asked")
    return found.select("pos", "asked", "c_custkey")
