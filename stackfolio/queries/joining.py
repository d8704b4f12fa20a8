"""Lookups and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import areas, changes, lookup, sets
from ..operators.reconcile import reconcile
from ..plans import marc_titles
from ..plans.marc import prepared
from ..sources import inline_lookup
from .bindings import concepts, marc_rows, text
from .registry import query


def _trading_nations(t):
    """(k, v): names of the nations that have a supplier with a positive balance."""
    active = t.supplier.where("s_acctbal > 5000").select("s_nationkey").distinct()
    rows = t.nation.join(active, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return rows.select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("v"))


ACTIVE = "(SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))"


def _customers(t):
    return t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))


@query(f"""
SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation
FROM customer LEFT JOIN {ACTIVE} n ON c_nationkey = n_nationkey
""")
def lookup_keep(t):
    return lookup.lookup(_customers(t), "nation", _trading_nations(t))


@query(f"SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN {ACTIVE} n ON c_nationkey = n_nationkey")
def lookup_delete(t):
    return lookup.lookup(_customers(t), "nation", _trading_nations(t), "delete")


@query(f"""
SELECT c_custkey, coalesce(n_name, 'N/A') AS nation FROM customer LEFT JOIN {ACTIVE} n ON c_nationkey = n_nationkey
""")
def lookup_default(t):
    return lookup.lookup(_customers(t), "nation", _trading_nations(t), "default", "N/A")


@query("""
WITH a AS (SELECT 'n' || s_suppkey AS k, s_name AS v FROM supplier WHERE s_acctbal > 0),
b AS (SELECT '-' || s_suppkey AS k, 'second ' || s_name AS v FROM supplier),
step AS (SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(a.v, 'n' || l_suppkey) AS s1 FROM lineitem LEFT JOIN a ON a.k = 'n' || l_suppkey)
SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(b.v, regexp_replace(s1, '^n(\\d+)$', '-\\1')) AS name
FROM step LEFT JOIN b ON b.k = regexp_replace(s1, '^n(\\d+)$', '-\\1')
""")
def lookup_two_spellings(t):
    """First the table with ``n`` spelling, then, on its result, the one with ``-``."""
    first = t.supplier.where("s_acctbal > 0").select(text("n", "s_suppkey").alias("k"), F.col("s_name").alias("v"))
    second = t.supplier.select(text("-", "s_suppkey").alias("k"), F.concat(F.lit("second "), "s_name").alias("v"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_suppkey").cast("string").alias("name"))
    steps = [
        (first, lambda c: F.concat(F.lit("n"), c)),
        (second, lambda c: F.regexp_replace(c, r"^n(\d+)$", "-$1")),
    ]
    return lookup.lookup_chain(rows, "name", steps)


@query("""
WITH b AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
e AS (SELECT doc_id, i, ws[i] AS w FROM d, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i))
SELECT e.doc_id, count(*) AS n_words, count(b.w) AS known, md5(string_agg(CASE WHEN b.w IS NULL THEN e.w ELSE '*' || e.w END, ' ' ORDER BY i)) AS marked
FROM e LEFT JOIN b ON b.w = e.w AND b.w <> '' GROUP BY e.doc_id
""")
def lookup_in_lists(t):
    """Each word of a text looked up in the words of the benchmark texts, order kept."""
    known = t.benchmark.select(F.explode(words(F.col("text"))).alias("k")).distinct()
    table = known.select("k", F.concat(F.lit("*"), "k").alias("v"))
    docs = t.wide("documents", "doc_id", "text").select("doc_id", words(F.col("text")).alias("words"))
    marked = lookup.lookup_array(docs, "doc_id", "words", table).where(F.size("words") > 0)
    return marked.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.size(F.filter("words", lambda w: w.startswith("*"))).cast("bigint").alias("known"),
        F.md5(F.array_join("words", " ")).alias("marked"),
    )


@query("""
SELECT o_orderkey, c_name, c_mktsegment, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey
""")
def lookup_several_values(t):
    table = t.customer.where("c_acctbal > 0")
    rows = lookup.lookup_wide(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", table, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])
    return rows.drop("o_custkey")


@query("""
WITH c AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS last_status, arg_max(o_orderpriority, o_orderkey) AS last_priority FROM orders GROUP BY 1),
s AS (SELECT c_nationkey AS k, max(c_mktsegment) AS segment FROM customer GROUP BY 1)
SELECT c_custkey, last_status, last_priority, coalesce(CAST(f.n AS VARCHAR), segment) AS first_known FROM customer LEFT JOIN c ON c.k = c_custkey
  LEFT JOIN s ON s.k = c_custkey LEFT JOIN (SELECT l_suppkey AS k, max(l_linenumber) AS n FROM lineitem GROUP BY 1) f ON f.k = c_custkey
""")
def lookups_with_double_keys(t):
    """Tables that have most keys many times: a customer stays one row, with the last order's values."""
    orders = t.orders.select("o_custkey", F.col("o_orderstatus").alias("last_status"), F.col("o_orderpriority").alias("last_priority"), F.col("o_orderkey").alias("o"))
    rows = lookup.lookup_wide(t.customer.select("c_custkey"), "c_custkey", orders, "o_custkey", ["last_status", "last_priority"])
    lines = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("v")).withColumn("v", F.col("v").cast("string"))
    segments = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return lookup.lookup_any(rows, "c_custkey", [lines, segments], "first_known")


@query("""
WITH s AS (SELECT s_nationkey AS k, max('http://s/' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS url FROM supplier GROUP BY 1),
n AS (SELECT n_nationkey AS k, 'http://n/' || n_nationkey AS url FROM nation),
p AS (SELECT page_id AS k, max(url) AS url FROM pages GROUP BY 1)
SELECT c_custkey, nullif(concat_ws(' ', s.url, n.url, p.url), '') AS links, CAST((s.url IS NOT NULL)::INT + (n.url IS NOT NULL)::INT + (p.url IS NOT NULL)::INT AS BIGINT) AS n_links
FROM customer c LEFT JOIN s ON s.k = c.c_nationkey LEFT JOIN n ON n.k = c.c_nationkey LEFT JOIN p ON p.k = c.c_nationkey
""")
def link_out_feeds(t):
    """Three feeds probed by one key, links in feed order."""
    suppliers = t.supplier.select(
        F.col("s_nationkey").cast("bigint").alias("k"),
        F.concat(F.lit("http://s/"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("url"), F.lit("Suppliers").alias("name"),
    )
    nations = t.nation.select(F.col("n_nationkey").cast("bigint").alias("k"), text("http://n/", "n_nationkey").alias("url"), F.lit("Nations").alias("name"))
    pages = t.pages.select(F.col("page_id").alias("k"), "url", F.lit("Pages").alias("name"))
    persons = t.customer.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"))
    linked = lookup.link_out(persons, "c_custkey", "nation", [("s", suppliers), ("n", nations), ("p", pages)])
    urls = F.transform("same_as", lambda x: x["id"])
    return linked.select(
        "c_custkey", F.array_join(urls, " ").alias("links"), F.coalesce(F.size("same_as"), F.lit(0)).cast("bigint").alias("n_links")
    )


@query("""
WITH m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS new FROM part)
SELECT CAST(CASE WHEN old <> new THEN new ELSE l_partkey END AS VARCHAR) AS part, count(*) AS n
FROM lineitem JOIN m ON old = l_partkey GROUP BY 1
""")
def redirected_ids(t):
    """Parts with the same name, brand and type go to the one with the smallest key."""
    first = t.part.groupBy("p_name", "p_brand", "p_type").agg(F.min("p_partkey").alias("new"))
    table = t.part.join(first, ["p_name", "p_brand", "p_type"]).where("new <> p_partkey").select(
        F.col("p_partkey").cast("string"), F.col("new").cast("string")
    )
    rows = t.lineitem.select(F.col("l_partkey").cast("string").alias("part"))
    return lookup.redirect_ids(rows, "part", table).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def used_only(t):
    good = t.labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    return lookup.keep_used(t.documents.select("doc_id", "lang"), good, key="doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_only(t):
    return lookup.missing_from(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("""
WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
v AS (SELECT l_orderkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS alt_label, min(l_linenumber) AS variant_pos
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT l_orderkey, l_suppkey, alt_label, variant_pos FROM a JOIN v USING (l_orderkey, l_suppkey)
""")
def agent_variants(t):
    """Suppliers of an order as agents, ship dates as their variant names."""
    agents = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    variants = t.lineitem.select(
        F.col("l_orderkey").alias("rec_id"), F.col("l_suppkey").alias("idn"), F.col("l_linenumber").alias("pos"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("label"), F.when(F.col("l_returnflag") == "R", "Spitzenorgan").alias("relation"),
    )
    return lookup.add_variants(agents, "l_orderkey", "l_suppkey", variants)


@query("""
WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers, max(c_name) AS name FROM customer GROUP BY 1),
s AS (SELECT s_nationkey + 3 AS nation, count(*) AS suppliers, max(s_name) AS name FROM supplier GROUP BY 1)
SELECT coalesce(c.nation, s.nation) AS nation, customers, suppliers, coalesce(c.name, s.name) AS name FROM c FULL JOIN s ON c.nation = s.nation
""")
def merged_by_id(t):
    """Customers and suppliers of a number; some numbers have one of them only."""
    left = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("customers"), F.max("c_name").alias("name")
    )
    right = t.supplier.groupBy((F.col("s_nationkey") + 3).alias("nation")).agg(
        F.count(F.lit(1)).alias("suppliers"), F.max("s_name").alias("name")
    )
    return lookup.merge_by_id(left, right, "nation")


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'own' ELSE 'foreign' END AS type, coalesce(d.lang, 'x') AS lang,
  CASE WHEN l.doc_id IS NULL THEN source ELSE 'q' || l.quality || ' ' || source END AS notes,
  CASE WHEN l.doc_id IS NULL THEN NULL ELSE 'u' || d.doc_id END AS union_id, l.toxic
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def merged_external(t):
    """Labels are the foreign base record of a document."""
    internal = t.documents.select(
        "doc_id", F.lit("own").alias("type"), "lang", F.array("source").alias("notes"), F.lit(None).cast("string").alias("union_id")
    )
    external = t.labels.select(
        "doc_id", F.lit("foreign").alias("type"), F.lit("zz").alias("lang"), F.array(text("q", "quality")).alias("notes"),
        text("u", "doc_id").alias("union_id"), "toxic", F.lit("x").alias("described_by"),
    )
    merged = lookup.merge_external(internal, external, "doc_id", from_external=["union_id"])
    return merged.withColumn("notes", F.array_join("notes", " "))


@query("""
WITH c AS (SELECT 'c' || c_custkey AS id, c_name AS l, 'n' || c_nationkey AS up FROM customer
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, 'none' FROM region)
SELECT a.id, coalesce(b.l, a.up) AS parent_label FROM c a LEFT JOIN c b ON a.up = b.id
""")
def labels_of_own_set(t):
    nodes = concepts(t).select("notation", "pref_label", F.element_at(F.split("broader", "#"), -1).alias("up"))
    rows = nodes.select(F.col("notation").alias("id"), F.coalesce("up", F.lit("none")).alias("up"))
    return lookup.self_label(rows, "up", nodes, "notation", "pref_label", "parent_label").select("id", "parent_label")


@query("""
WITH asked AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS a FROM orders WHERE o_orderstatus <> 'F'
  UNION SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') FROM orders WHERE o_orderstatus = 'F')
SELECT a AS asked, c_custkey AS rec_id FROM asked JOIN customer ON a = CAST(c_custkey AS VARCHAR) OR a = c_name
""")
def resolved_by_any_id(t):
    """Customers found by key or by name."""
    by_key = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_custkey").cast("string").alias("id"))
    by_name = t.orders.where("o_orderstatus = 'F'").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("id")
    )
    return lookup.resolve_any_id(t.customer, "c_custkey", ["c_custkey", "c_name"], by_key.unionByName(by_name))


@query("""
WITH p AS (SELECT page_id, 'http://example.org/resources/' || regexp_extract(url, '(\\d+)', 1) || '#!' AS url, regexp_extract(url, '(\\d+)', 1) AS num FROM pages),
c AS (SELECT DISTINCT o_custkey FROM orders)
SELECT page_id, p.url, coalesce('https://here/' || d.doc_id, 'https://here/c' || c.c_custkey, p.url) AS link
FROM p LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = num AND d.lang = 'de' LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = num
""")
def local_links(t):
    """Catalogue links of pages: German documents are here, customers know a local twin."""
    refs = t.pages.select(
        "page_id", F.concat(F.lit("http://example.org/resources/"), F.regexp_extract("url", r"(\d+)", 1), F.lit("#!")).alias("url")
    )
    here = t.documents.where("lang = 'de'").select(F.col("doc_id").alias("rec_id"))
    remote = t.customer.select(F.col("c_custkey").alias("remote_id"), text("c", "c_custkey").alias("local_id"))
    return lookup.local_link(refs, "url", "https?://example.org/resources/", "https://here/", here, remote)


@query("""
WITH b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS ws FROM benchmark),
d AS (SELECT doc_id, lang, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS ws FROM documents),
s AS (SELECT item_id, doc_id, len(list_intersect(b.ws, d.ws)) / len(b.ws) AS overlap, CASE WHEN lang = 'en' THEN 0.25 ELSE 0 END AS bonus
  FROM b, d WHERE len(list_intersect(b.ws, d.ws)) >= 0.8 * len(b.ws) - 1e-9),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap + bonus DESC, doc_id) AS rn FROM s)
SELECT item_id, doc_id, round(overlap, 6) AS overlap, round(overlap + bonus, 6) AS score FROM r WHERE rn = 1
""")
def reconciled_titles(t):
    """Benchmark texts matched with the documents that contain (almost) all their words."""
    records = t.benchmark.withColumn("lang", F.lit("en"))
    best = reconcile(records, t.wide("documents", "doc_id", "text", "lang"), "item_id", "text", "doc_id", "text", {"lang": 0.25}, 0.8)
    return best.withColumn("overlap", F.round("overlap", 6)).withColumn("score", F.round("score", 6))


ITEM_SQL = """
WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey, 'DE-' || l_suppkey || CASE WHEN l_returnflag = 'N' THEN '' ELSE '-' || l_linenumber END AS isil FROM lineitem)
"""


@query(ITEM_SQL + """
SELECT 'http://example.org/items/' || l_orderkey || ':' || isil || ':x#!' AS item, CAST(l_orderkey AS VARCHAR) AS record_id, isil,
  'http://opac/' || l_suppkey || '?id=' || l_orderkey AS url_all,
  CASE WHEN isil = 'DE-' || l_suppkey AND t.s_acctbal > 0 THEN 'http://opac/' || l_suppkey || '?id=' || l_orderkey END AS url,
  CASE WHEN isil = 'DE-' || l_suppkey THEN s.s_name ELSE s.s_name || ': ' || isil END AS library
FROM i JOIN supplier s ON s.s_suppkey = l_suppkey LEFT JOIN supplier t ON t.s_suppkey = l_suppkey
""".replace("  'http://opac/' || l_suppkey || '?id=' || l_orderkey AS url_all,\n", ""))
def linked_holdings(t):
    isil = F.concat(
        F.lit("DE-"), "l_suppkey", F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("-"), "l_linenumber"))
    )
    items = t.lineitem.select(F.concat(F.lit("http://example.org/items/"), "l_orderkey", F.lit(":"), isil, F.lit(":x#!")).alias("item"))
    templates = t.supplier.where("s_acctbal > 0").select(
        text("DE-", "s_suppkey").alias("k"), F.concat(F.lit("http://opac/"), "s_suppkey", F.lit("?id={id}")).alias("v")
    )
    labels = t.supplier.select(text("DE-", "s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return lookup.holding_links(items, "item", templates, labels)


@query("SELECT o_orderkey, c_name AS mapped_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def crosswalked_ids(t):
    mapping = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return lookup.crosswalk(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", mapping).drop("o_custkey")


@query("""
WITH a AS (SELECT l_orderkey AS k, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey AS k, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS id, a.lines AS al, b.lines AS bl, a.quantity AS aq, b.quantity AS bq FROM a FULL JOIN b ON a.k = b.k)
SELECT id, 'lines' AS "column", CAST(al AS VARCHAR) AS left_value, CAST(bl AS VARCHAR) AS right_value FROM j WHERE al IS DISTINCT FROM bl
UNION ALL SELECT id, 'quantity', CAST(aq AS VARCHAR), CAST(bq AS VARCHAR) FROM j WHERE aq IS DISTINCT FROM bq
""")
def compared_outputs(t):
    def totals(rows):
        return rows.groupBy(F.col("l_orderkey").alias("id")).agg(
            F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity")
        )

    return lookup.compare_outputs(totals(t.lineitem), totals(t.lineitem.where("l_returnflag <> 'R'")), "id")


AREA = [(-0.2, -0.2), (0.25, -0.15), (0.1, 0.0), (0.2, 0.25), (-0.15, 0.2)]


def _area_sql() -> str:
    edges = []
    for (y1, x1), (y2, x2) in zip(AREA, [*AREA[1:], AREA[0]]):
        edges.append(f"(CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND (lon < ({x2 - x1!r} * (lat - {y1}) / {y2 - y1!r} + {x1})) THEN 1 ELSE 0 END)")
    lats, lons = [p[0] for p in AREA], [p[1] for p in AREA]
    return (
        "WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings) "
        f"SELECT vec_id FROM p WHERE lat BETWEEN {min(lats)} AND {max(lats)} AND lon BETWEEN {min(lons)} AND {max(lons)} "
        f"AND ({' + '.join(edges)}) % 2 = 1"
    )


@query(_area_sql())
def points_in_polygon(t):
    """The first two dimensions of a vector are a point."""
    points = t.embeddings.select(
        "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("lat"), F.get("embedding", F.lit(1)).cast("double").alias("lon")
    )
    return lookup.within_polygon(points, "lat", "lon", AREA).select("vec_id")


CORNERS = [(-1.0, -1.0), (-0.2, 0.0), (-1.0, 1.0), (1.0, 0.25)]


@query("""
WITH a AS (SELECT s_suppkey AS area, ((s_suppkey * 37) % 101) / 250.0 - 0.2 AS y, ((s_suppkey * 53) % 97) / 250.0 - 0.2 AS x, (1 + s_suppkey % 7) * (s_suppkey % 3 + 0.5) / 64.0 AS r FROM supplier),
c AS (SELECT area, [""" + ", ".join(f"{{'lat': y + {a} * r, 'lon': x + {b} * r}}" for a, b in CORNERS) + """] AS ring FROM a),
e AS (SELECT area, ring[i].lat AS y1, ring[i].lon AS x1, ring[i % 4 + 1].lat AS y2, ring[i % 4 + 1].lon AS x2 FROM c, (SELECT unnest([1, 2, 3, 4]) AS i)),
p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings)
SELECT vec_id, area FROM p, e WHERE ((y1 > lat) <> (y2 > lat)) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1
""")
def points_in_areas(t):
    """Vectors as points within an area of each supplier; the areas have many sizes, overlap and are not convex."""
    key, r = F.col("s_suppkey"), F.col("r")
    y, x = (key * 37) % 101 / F.lit(250.0) - 0.2, (key * 53) % 97 / F.lit(250.0) - 0.2
    sized = t.supplier.select(key, y.alias("y"), x.alias("x"), ((1 + key % 7) * (key % 3 + 0.5) / F.lit(64.0)).alias("r"))
    corners = F.array(*[F.struct((F.col("y") + F.lit(a) * r).alias("lat"), (F.col("x") + F.lit(b) * r).alias("lon")) for a, b in CORNERS])
    points = t.embeddings.select(
        "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("lat"), F.get("embedding", F.lit(1)).cast("double").alias("lon")
    )
    return areas.within_areas(points, "lat", "lon", sized.select("s_suppkey", corners.alias("ring")), "s_suppkey", "ring").select("vec_id", "area")


@query("""
WITH p AS (SELECT p_partkey, [p_type, p_brand] AS old, [CASE p_type WHEN 'ECONOMY' THEN 'STANDARD' WHEN 'SMALL' THEN 'MEDIUM' ELSE p_type END,
  CASE p_brand WHEN 'Brand#1' THEN 'Brand#2' ELSE p_brand END] AS new FROM part)
SELECT p_partkey, array_to_string(new, '|') AS notations FROM p WHERE new <> old
""")
def replaced_notations(t):
    """Outdated types and brands replaced, changed parts only."""
    table = inline_lookup(t.spark, {"ECONOMY": "STANDARD", "SMALL": "MEDIUM", "Brand#1": "Brand#2"})
    parts = t.part.select("p_partkey", F.array("p_type", "p_brand").alias("notations"))
    return lookup.replace_notation(parts, "p_partkey", "notations", table).withColumn("notations", F.array_join("notations", "|"))


@query("""
WITH n AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'),
c AS (SELECT c_custkey, n.n_name AS place, c_mktsegment FROM customer JOIN nation n ON c_nationkey = n_nationkey)
SELECT c_custkey, r_name || '|World|Earth' AS places,
  CASE WHEN r_name = 'EUROPE' OR place = 'NATION_1' THEN place || '|' ELSE '' END || c_mktsegment AS headings
FROM c JOIN n ON n.n_name = place
""")
def broadened_places(t):
    """Nations to regions; European ones also become headings."""
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    broader = nations.where("r_name <> 'ASIA'").select(
        F.col("n_name").alias("k"), F.concat("r_name", F.lit(" ; World")).alias("v")
    )
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.array(F.col("n_name"), F.lit("Earth")).alias("places"), F.array("c_mktsegment").alias("headings")
    )
    out = lookup.broaden_places(customers, "c_custkey", "places", "headings", broader, "EUROPE", ["NATION_1"])
    return out.select("c_custkey", F.array_join("places", "|").alias("places"), F.array_join("headings", "|").alias("headings"))


@query("""
SELECT 'o' || o_orderkey AS rec_id, '245' AS tag, 'Order <' || o_orderpriority || '> & more /' AS value, '(N' AS script, 'Kyr ' || substr(o_orderpriority, 1, 1) AS other_value FROM orders
""")
def script_twins(t):
    """Fields with a twin in another script, joined in long form."""
    rows = marc_rows(t).select("rec_id", F.explode("data").alias("d")).select(
        "rec_id", "d.tag",
        F.get(F.filter("d.subs", lambda s: s["code"] == "6"), F.lit(0))["value"].alias("link"),
        F.get(F.filter("d.subs", lambda s: s["code"] == "a"), F.lit(0))["value"].alias("value"),
    )
    return lookup.link_scripts(rows)


@query("""
SELECT 'o' || o_orderkey AS rec_id, '(N' AS script, '245' AS tags, 'Kyr ' || substr(o_orderpriority, 1, 1) AS texts FROM orders
""")
def scripts_in_rows(t):
    """The same inside the MARC row, grouped by script."""
    rows = prepared(marc_rows(t)).withColumn("links", marc_titles.script_links())
    rows = rows.select("rec_id", F.explode(marc_titles.by_script(F.col("links"))).alias("s"))
    return rows.select(
        "rec_id", "s.script", F.array_join(F.transform("s.fields", lambda f: f["tag"]), " ").alias("tags"),
        F.array_join(F.transform("s.fields", lambda f: f["other_value"]), " ").alias("texts"),
    )


@query("""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> CASE WHEN o_totalprice > 300000 THEN 'P' ELSE 'O' END
""")
def changed_records(t):
    old = t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "P").otherwise("O").alias("o_orderstatus"))
    return changes.changed_only(old, t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"])


@query("""
SELECT doc_id AS id, text, lang, NULL AS role FROM documents
UNION ALL SELECT conv_id, text, NULL, role FROM conversations
""")
def united_sources(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", "lang")
    return sets.union_sources(docs, t.conversations.select(F.col("conv_id").alias("id"), "text", "role"))
