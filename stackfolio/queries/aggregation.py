"""Counts, facets, histograms, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, quality, search
from .bindings import TREE, concepts, text
from .registry import query


def _parts(t):
    """Parts as records: subjects are type, brand and the words of the name."""
    return t.part.select(
        "p_partkey", "p_type", "p_brand", "p_size",
        F.array(F.concat(F.lit("types#"), "p_type"), F.concat(F.lit("brands#"), "p_brand"), F.concat(F.lit("types#"), "p_type")).alias("subjects"),
        F.split("p_name", " ").alias("words"),
    )


WORDS = "(SELECT p_partkey, p_type, p_brand, p_size, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part)"


@query(f"SELECT w AS key, count(*) AS doc_count FROM {WORDS} GROUP BY w")
def facet_words(t):
    return aggregates.facet(_parts(t), "words")


@query(f"SELECT w AS key, count(*) AS doc_count FROM {WORDS} GROUP BY w ORDER BY 2 DESC, 1 LIMIT 5")
def facet_top(t):
    return aggregates.facet(_parts(t), "words", 5)


@query("SELECT 'brands#' || p_brand AS key, count(*) AS doc_count FROM part GROUP BY 1")
def facet_scoped(t):
    return aggregates.facet_scoped(_parts(t), "subjects", "brands#")


@query("""
SELECT CAST(c_nationkey AS VARCHAR) AS key, count(*) AS doc_count, n_name AS label, c_nationkey = 3 AS selected
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 GROUP BY c_nationkey, n_name
""")
def facet_with_labels(t):
    """Labels of one region are URIs here, so its buckets go."""
    buckets = aggregates.facet(t.customer.select(F.col("c_nationkey").cast("string").alias("nation")), "nation")
    name = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("http://x/"), "n_name")).otherwise(F.col("n_name"))
    labels = t.nation.select(F.col("n_nationkey").cast("string").alias("k"), name.alias("v"))
    return aggregates.facet_labelled(buckets, labels, ["3"])


@query(f"""
SELECT 'type' AS facet, p_type AS key, count(*) AS doc_count FROM part GROUP BY 2
UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2
UNION ALL SELECT 'word', w, count(*) FROM {WORDS} GROUP BY 2
""")
def facet_panel(t):
    return aggregates.facet_panel(_parts(t), {"type": "p_type", "brand": "p_brand", "size": "p_size", "word": "words"})


@query("""
WITH e AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(user_id AS VARCHAR) AS usr FROM events),
a AS (SELECT 'type' AS facet, event_type AS key, count(*) AS doc_count FROM e GROUP BY 2
  UNION ALL SELECT 'day', day, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'user', usr, count(*) FROM e GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY doc_count DESC, key) AS rn FROM a)
SELECT facet, key, doc_count FROM r WHERE rn <= 10
""")
def facet_panel_top(t):
    """Ten most frequent values per facet of the events."""
    rows = t.events.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    return aggregates.facet_panel(rows, {"type": "event_type", "day": "day", "user": "user_id"}, 10)


@query(f"SELECT count(*) AS total FROM {WORDS} WHERE w = 'red'")
def hits_of_value(t):
    return aggregates.total_hits(_parts(t), "words", "red")


@query("""
WITH c AS (SELECT 'c' || c_custkey AS notation, c_custkey AS k FROM customer UNION ALL SELECT 'n' || n_nationkey, NULL FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
o AS (SELECT 'c' || o_custkey AS id FROM orders),
n AS (SELECT 'n' || s_nationkey AS id FROM supplier)
SELECT notation, coalesce((SELECT count(*) FROM o WHERE o.id = notation), 0) + coalesce((SELECT count(*) FROM n WHERE n.id = notation), 0) AS hits FROM c
""")
def hits_per_node(t):
    """Orders name their customer, suppliers their nation as concept."""
    orders = t.orders.select(F.array(text(TREE + "c", "o_custkey")).alias("subject"), F.array().cast("array<string>").alias("spatial"))
    suppliers = t.supplier.select(F.array().cast("array<string>").alias("subject"), F.array(text(TREE + "n", "s_nationkey")).alias("spatial"))
    counted = aggregates.node_hits(concepts(t), orders.unionByName(suppliers), ["subject", "spatial"])
    return counted.select("notation", "hits")


@query("""
WITH l AS (SELECT p_partkey, unnest([p_name || CASE WHEN p_size > 25 THEN '(12,3)' ELSE '' END, '.' || p_name]) AS key FROM part),
f AS (SELECT key, count(DISTINCT p_partkey) AS n FROM l GROUP BY key),
g AS (SELECT regexp_replace(key, '\\([\\d,]+\\)$', '') AS label, n FROM f)
SELECT label, max(n) AS doc_count FROM g WHERE (contains(label, 'red') OR contains(label, 'bolt')) AND label NOT LIKE '.%' GROUP BY label
""")
def topic_search(t):
    labels = F.array(
        F.concat("p_name", F.when(F.col("p_size") > 25, "(12,3)").otherwise("")), F.concat(F.lit("."), "p_name")
    )
    return aggregates.topics(t.part.select("p_partkey", labels.alias("label")), "label", "Red bolt")


@query("""
SELECT 'B' || p_brand AS id, p_brand AS label, count(*) AS doc_count FROM part
WHERE p_brand IN (SELECT p_brand FROM part WHERE p_type = 'PROMO') GROUP BY p_brand HAVING count(*) > 5 ORDER BY 3 DESC, 1 LIMIT 3
""")
def main_headings(t):
    """Brands are headings, the types of their parts are their variants."""
    headings = t.part.groupBy("p_brand").agg(F.collect_set("p_type").alias("variants")).select(
        F.concat(F.lit("B"), "p_brand").alias("id"), F.col("p_brand").alias("label"), "variants"
    )
    records = t.part.select(F.array(F.concat(F.lit("B"), "p_brand")).alias("headings"))
    return aggregates.main_headings(headings, records, "headings", "promo")


@query("""
WITH c AS (SELECT 2 * year(o_orderdate) - 2000 AS y, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(g AS INTEGER) AS year, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(y) FROM c), (SELECT max(y) FROM c) + 1)) AS g) LEFT JOIN c ON y = g
""")
def year_histogram(t):
    """Every second year has no orders."""
    return aggregates.year_histogram(t.orders, 2 * F.year("o_orderdate") - 2000, 1400, 2100)


@query("SELECT CAST(count(*) AS BIGINT) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def years_in_range(t):
    return aggregates.range_sum(aggregates.year_histogram(t.orders, F.year("o_orderdate"), 1400, 2100), 1996, 1998)


@query("""
SELECT CAST(c_nationkey AS DOUBLE) AS lat, round(c_acctbal / 1000) AS lon, count(*) AS n FROM customer GROUP BY 1, 2
""")
def counts_per_place(t):
    rows = t.customer.select(F.col("c_nationkey").cast("double").alias("lat"), F.round(F.col("c_acctbal") / 1000).alias("lon"))
    return aggregates.place_counts(rows, "lat", "lon")


@query("""
WITH w AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: 'http:x:' || x || ':' || p_size) AS us FROM part),
e AS (SELECT p_partkey, len(list_distinct(list_transform(us, lambda u: string_split(u, ':')[3]))) AS libraries, unnest(us) AS u FROM w)
SELECT p_partkey, string_split(u, ':')[3] AS isil, libraries, count(*) AS n_items, string_agg(u, ' ' ORDER BY u) AS items FROM e GROUP BY ALL
""")
def holdings_per_library(t):
    """Words of a part name stand for the libraries that hold it."""
    uris = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("http:x:"), w, F.lit(":"), F.col("p_size").cast("string")))
    rows = aggregates.holdings_by_library(t.part.select("p_partkey", uris.alias("has_item")), "p_partkey", "has_item")
    return rows.select(
        "p_partkey", "isil", F.col("libraries").cast("bigint").alias("libraries"), F.col("n_items").cast("bigint").alias("n_items"),
        F.array_join(F.array_sort("items"), " ").alias("items"),
    )


@query("""
SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda l: l <> ''), ' | ')) AS chain FROM documents
""")
def chained_labels(t):
    """Paragraphs as the parts of a heading chain."""
    components = F.transform(F.split("text", "\n"), lambda p: F.struct(p.alias("label")))
    return t.documents.select("doc_id", F.md5(aggregates.chain_labels(components)).alias("chain"))


@query("""
SELECT p_partkey, array_to_string(CASE WHEN p_size > 25 THEN [p_brand] ELSE [] END || list_filter(
  CASE WHEN string_split(p_name, ' ')[1] = string_split(p_name, ' ')[2] THEN [string_split(p_name, ' ')[1]] ELSE string_split(p_name, ' ') END, lambda x: true), ', ') AS labels
FROM part
""")
def subject_label_lists(t):
    """Brand is a concept (coded for small parts), the name words are a chain."""
    none = F.lit(None).cast("string")
    concept = F.struct(
        F.lit("Concept").alias("type"), F.col("p_brand").alias("label"), F.when(F.col("p_size") <= 25, "x").alias("notation"),
        F.lit(None).cast("array<string>").alias("component_labels"),
    )
    chain = F.struct(
        F.lit("ComplexSubject").alias("type"), F.col("p_name").alias("label"), none.alias("notation"),
        F.split("p_name", " ").alias("component_labels"),
    )
    labels = aggregates.subject_labels(F.array(concept, chain))
    return t.part.select("p_partkey", F.array_join(labels, ", ").alias("labels"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_objects(t):
    return aggregates.distinct_rows(t.documents.select("lang", "source"))


@query("""
SELECT 'attributes.k' AS path, count(*) FILTER (json_extract(props, '$.k') IS NOT NULL) AS n FROM events
UNION ALL SELECT 'event_id', count(event_id) FROM events UNION ALL SELECT 'event_type', count(*) FILTER (event_type <> '') FROM events
UNION ALL SELECT 'lines[]', sum(len(list_filter(string_split(text, chr(10)), lambda l: l <> ''))) FROM documents
UNION ALL SELECT 'lang', count(*) FROM documents
UNION ALL SELECT 'words[].w', sum(len(string_split(p_name, ' '))) FROM part
""")
def structure_profile(t):
    """Flattened paths of three record sets with their number of values."""
    events = t.events.select("event_id", "event_type", F.from_json("props", "k bigint").alias("attributes"))
    docs = t.documents.select("lang", F.split("text", "\n").alias("lines"))
    parts = t.part.select(F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("w"))).alias("words"))
    profiles = [aggregates.profile_structure(x) for x in (events, docs, parts)]
    return profiles[0].unionByName(profiles[1]).unionByName(profiles[2])


@query("""
WITH s AS (SELECT role AS path, count(*) AS n FROM conversations GROUP BY 1), t AS (SELECT lang AS path, count(*) AS n FROM documents GROUP BY 1),
m AS (SELECT * FROM (VALUES ('user', 'de'), ('assistant', 'en'), ('nobody', 'fr')) v(a, b))
SELECT coalesce(a, s.path) AS source_path, s.n AS source_n, coalesce(b, t.path) AS target_path, t.n AS target_n
FROM m FULL JOIN s ON a = s.path FULL JOIN t ON b = t.path
""")
def mapping_coverage(t):
    """Which source paths are mapped to which target paths, and what is left over on both sides."""
    source = aggregates.facet(t.conversations, "role").toDF("path", "n")
    target = aggregates.facet(t.documents, "lang").toDF("path", "n")
    mapping = t.spark.createDataFrame([("user", "de"), ("assistant", "en"), ("nobody", "fr")], "source_path string, target_path string")
    return quality.coverage(source, target, mapping)


@query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS token FROM documents)
SELECT token, count(*) AS n FROM w GROUP BY 1
""")
def token_frequencies(t):
    index = search.token_index(t.wide("documents", "doc_id", "text"), "doc_id", "text")
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


