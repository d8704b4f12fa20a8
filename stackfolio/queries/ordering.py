"""Ordered work: numbering, running values, neighbours, sorted lists. Ranks are columns here, so that
the order itself is checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sortkeys
from ..operators import order, scan
from .bindings import text
from .registry import query

TOTAL_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"


def _lines(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag", "l_quantity")


def _keys(*names: str):
    return [F.col(n).asc() for n in names]


@query(f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)
  OVER (PARTITION BY l_orderkey ORDER BY {TOTAL_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS volume FROM lineitem
""")
def volume_numbers(t):
    """Returned lines start a new volume of their order."""
    rows = scan.scan(
        _lines(t).withColumn("_start", F.when(F.col("l_returnflag") == "R", 1).otherwise(0)), ["l_orderkey"],
        _keys("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"), sums={"volume": "_start"},
    )
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("volume").cast("bigint").alias("volume"))


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS title FROM conversations
""")
def carried_titles(t):
    """The last user text is carried to the following turns."""
    rows = scan.parent_title(
        t.conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn",
        F.when(F.col("role") == "user", F.md5("text")), "title",
    )
    return rows.select("conv_id", "turn", "title")


@query("""
SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id
""")
def latest_per_user(t):
    return scan.latest_per_id(t.events, "user_id", F.col("ts"), ["event_id", "event_type"])


@query("""
SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS prev_id, lead(o_orderkey) OVER w AS next_id, row_number() OVER w AS position,
  count(*) OVER (PARTITION BY o_custkey) AS total FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def hit_neighbours(t):
    """Orders of a customer as a hit list by date."""
    hits = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return scan.neighbours(hits, ["o_custkey"], _keys("o_orderdate", "o_orderkey"), "o_orderkey").drop("o_orderdate")


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no,
  CAST(floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / 1000) AS BIGINT) AS batch FROM orders
""")
def batch_numbers(t):
    rows = scan.batch_number(t.orders.select("o_orderkey", "o_totalprice"), _keys("o_totalprice", "o_orderkey"))
    return rows.select("o_orderkey", "row_no", "batch")


@query("""
WITH w AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS ws FROM part)
SELECT p_partkey, i AS pos, ws[i] AS word, CASE WHEN i = 1 THEN p_brand END AS history FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)
""")
def first_event_info(t):
    events = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word"), F.lit(None).cast("string").alias("history")))
    filled = scan.first_event_only(events, history=F.col("p_brand"))
    rows = t.part.select("p_partkey", F.posexplode(filled).alias("pos", "e"))
    return rows.select("p_partkey", (F.col("pos") + 1).cast("bigint").alias("pos"), "e.word", "e.history")


@query("""
SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 40 THEN NULL ELSE p_size END DESC NULLS LAST, p_partkey) AS rank FROM part
""")
def ranked_newest(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("year"))
    return scan.ranked(rows, [], [F.desc_nulls_last("year"), F.asc("p_partkey")]).drop("year")


@query("""
SELECT o_orderkey FROM orders ORDER BY year(o_orderdate) DESC, o_orderkey LIMIT 20 OFFSET 40
""")
def third_page(t):
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"))
    return order.page(rows, [F.desc_nulls_last("year"), F.asc("o_orderkey")], 40, 20).select("o_orderkey")


GERMAN_WORDS = """
WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[^\\p{L}]+')) AS word FROM documents)
"""


@query(GERMAN_WORDS + """
SELECT word, row_number() OVER (ORDER BY word COLLATE de, word) AS rank FROM w WHERE word <> ''
""")
def ranked_german(t):
    """Different words of all documents in German order."""
    found = t.wide("documents", "text").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word"))
    rows = found.where("word <> ''").distinct()
    return scan.ranked(rows, [], [sortkeys.german(F.col("word")).asc(), F.asc("word")])


@query("""
WITH s AS (SELECT s_suppkey, CASE WHEN s_acctbal < 3000 THEN 'Der ' WHEN s_acctbal < 6000 THEN 'Dä ' ELSE '' END || chr(CAST(65 + s_nationkey AS INTEGER)) || ' ' || s_name AS label FROM supplier)
SELECT s_suppkey, row_number() OVER (ORDER BY regexp_replace(label, '^(Der|Die|Das|De|Dä)\\s', '') COLLATE de, s_suppkey) AS rank FROM s
""")
def ranked_without_article(t):
    article = F.when(F.col("s_acctbal") < 3000, "Der ").when(F.col("s_acctbal") < 6000, "Dä ").otherwise("")
    label = F.concat(article, F.char(F.col("s_nationkey") + 65), F.lit(" "), "s_name")
    rows = t.supplier.select("s_suppkey", label.alias("label"))
    return scan.ranked(rows, [], [sortkeys.no_article(F.col("label")).asc(), F.asc("s_suppkey")]).drop("label")


@query("""
WITH i AS (SELECT DISTINCT 'DE-' || CASE WHEN l_returnflag = 'A' THEN 'Wa' ELSE '' END || l_suppkey || CASE WHEN l_returnflag = 'N' THEN '' ELSE '-' || l_linenumber END AS isil FROM lineitem),
k AS (SELECT isil, string_split(isil, '-') AS p FROM i)
SELECT isil, row_number() OVER (ORDER BY CAST(regexp_replace(p[2], '\\D', '9', 'g') AS BIGINT), p[2], len(p),
  coalesce(CAST(regexp_replace(p[3], '\\D', '9', 'g') AS BIGINT), -1), isil) AS rank FROM k
""")
def ranked_isil(t):
    isil = F.concat(
        F.lit("DE-"), F.when(F.col("l_returnflag") == "A", "Wa").otherwise(""), F.col("l_suppkey").cast("string"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("-"), F.col("l_linenumber").cast("string"))),
    )
    rows = t.lineitem.select(isil.alias("isil")).distinct()
    return scan.ranked(rows, [], [sortkeys.isil(F.col("isil")).asc()])


@query("""
WITH n AS (SELECT p_partkey, p_brand || ' Stadtbezirk ' || CASE WHEN p_size <= 10 THEN CAST(p_size AS VARCHAR)
  WHEN p_size <= 20 THEN ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'][p_size - 10] ELSE 'Nord' END AS label, p_brand, p_size FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size <= 20 THEN p_brand || ' Stadtbezirk' ELSE label END COLLATE de,
  CASE WHEN p_size <= 10 THEN p_size WHEN p_size <= 20 THEN p_size - 10 ELSE 0 END, p_partkey) AS rank FROM n
""")
def ranked_districts(t):
    roman = F.get(F.array(*[F.lit(r) for r in sortkeys.ROMAN]), F.col("p_size") - 11)
    numeral = F.when(F.col("p_size") <= 10, F.col("p_size").cast("string")).when(F.col("p_size") <= 20, roman).otherwise("Nord")
    rows = t.part.select("p_partkey", F.concat("p_brand", F.lit(" Stadtbezirk "), numeral).alias("label"))
    return scan.ranked(rows, [], [sortkeys.district(F.col("label")).asc(), F.asc("p_partkey")]).drop("label")


@query("""
SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25
""")
def newest_hits(t):
    rows = t.part.select("p_partkey", "p_size")
    return order.sort_hits(rows, "newest", "p_size", "p_partkey").limit(25)


@query("""
WITH n AS (
SELECT 'n' || n_regionkey AS parent, 'x#n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, n_name AS label FROM nation
UNION ALL SELECT NULL, 'x#n' || r_regionkey, r_name FROM region
UNION ALL SELECT 'n' || c_nationkey || 'c', 'x#n' || c_custkey || 'c', c_name FROM customer)
SELECT parent, id, label, row_number() OVER (ORDER BY parent NULLS FIRST, CASE WHEN parent LIKE '%c' THEN label ELSE substr(id, 4) END COLLATE de, id) AS rank FROM n
""")
def siblings_in_order(t):
    """Nations under regions (sorted by id), customers under nations (sorted by name)."""
    nations = t.nation.select(
        text("n", "n_regionkey").alias("parent"), F.concat(F.lit("x#n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("id"), F.col("n_name").alias("label")
    )
    regions = t.region.select(F.lit(None).cast("string").alias("parent"), text("x#n", "r_regionkey").alias("id"), F.col("r_name").alias("label"))
    customers = t.customer.select(
        F.concat(F.lit("n"), "c_nationkey", F.lit("c")).alias("parent"), F.concat(F.lit("x#n"), "c_custkey", F.lit("c")).alias("id"), F.col("c_name").alias("label")
    )
    rows = order.with_sibling_key(nations.unionByName(regions).unionByName(customers))
    return scan.ranked(rows, [], [F.asc_nulls_first("parent"), F.asc("_key"), F.asc("id")]).drop("_key")
