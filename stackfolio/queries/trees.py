"""Concept trees, routing and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, scan, sets, tree
from .bindings import TREE, concepts, text
from .registry import query


@query("""
SELECT NULL AS parent, 'http://example.org/tree#r' || r_regionkey AS id, r_name AS label, CAST(r_regionkey AS VARCHAR) AS notation, CAST(0 AS BIGINT) AS hits FROM region
UNION ALL SELECT 'http://example.org/tree#r' || n_regionkey, 'http://example.org/tree#n' || n_nationkey, n_name, CAST(n_nationkey AS VARCHAR),
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation
UNION ALL SELECT 'http://example.org/tree#n' || c_nationkey, 'http://example.org/tree#c' || c_custkey, c_name, CAST(c_custkey AS VARCHAR), 0 FROM customer
""")
def tree_edges(t):
    hits = aggregates.facet(t.supplier.select(text(TREE + "n", "s_nationkey").alias("spatial")), "spatial")
    return tree.build_tree(concepts(t), hits)


@query("""
SELECT 'http://example.org/tree#n' || c_nationkey AS parent, count(*) AS children FROM customer GROUP BY 1
UNION ALL SELECT 'http://example.org/tree#r' || n_regionkey, count(*) FROM nation GROUP BY 1
""")
def children_per_node(t):
    return tree.children_count(tree.build_tree(concepts(t)))


@query("""
WITH RECURSIVE c AS (
  SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS up FROM customer WHERE c_acctbal > -500
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region WHERE r_name <> 'ASIA'),
p AS (SELECT id, id AS path FROM c WHERE up IS NULL UNION ALL SELECT c.id, p.path || ' > ' || c.id FROM c JOIN p ON c.up = p.id)
SELECT c.id, coalesce(p.path, c.id) AS path FROM c LEFT JOIN p ON p.id = c.id
""")
def node_paths(t):
    """One region is missing, so its nations and their customers have only themselves as path."""
    nodes = concepts(t).where("pref_label <> 'ASIA'").select(
        F.col("notation").alias("id"), F.element_at(F.split("broader", "#"), -1).alias("parent")
    )
    poor = t.customer.where("c_acctbal <= -500").select(text("c", "c_custkey").alias("gone"))
    kept = nodes.join(poor, F.col("id") == F.col("gone"), "left_anti")
    return tree.paths(kept).select("id", F.array_join("path", " > ").alias("path"))


@query("""
SELECT 'http://example.org/tree#c' || c_custkey AS id,
  r_name || ' (n' || r_regionkey || ') > ' || n_name || ' (n' || n_nationkey || ') > ' || c_name || ' (n' || c_custkey || ')' AS text
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'http://example.org/tree#n' || n_nationkey, r_name || ' (n' || r_regionkey || ') > ' || n_name || ' (n' || n_nationkey || ')' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'http://example.org/tree#r' || r_regionkey, r_name || ' (n' || r_regionkey || ')' FROM region
""")
def path_texts(t):
    nodes = concepts(t)
    labels = nodes.select(F.col("id").alias("k"), F.col("pref_label").alias("v"))
    return tree.path_text(tree.paths(tree.build_tree(nodes)), labels)


CODES = """
WITH p AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 8, '1') AS code, CASE WHEN p_size > 30 THEN 'x' || p_size ELSE '' END AS part,
  CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN 'Kreis ' || substr(lpad(CAST(p_partkey AS VARCHAR), 8, '1'), 1, 3)
    ELSE 'Land' || substr(lpad(CAST(p_partkey AS VARCHAR), 8, '1'), 1, 3) END AS district,
  CASE WHEN p_size > 10 THEN 'VG' || substr(lpad(CAST(p_partkey AS VARCHAR), 8, '1'), 1, 5) END AS assoc FROM part)
"""


@query(CODES + """
SELECT DISTINCT * FROM (
  SELECT CASE WHEN part <> '' THEN 'n' || code WHEN district IS NOT NULL AND assoc IS NOT NULL THEN 'n' || substr(code, 1, 5)
    WHEN district IS NOT NULL THEN 'n' || substr(code, 1, 3) END AS parent, 'n' || code || part AS id, p_name AS label, code || part AS notation FROM p
  UNION ALL SELECT NULL, 'n' || substr(code, 1, 3), CASE WHEN p_type = 'SMALL' THEN district ELSE district || ', Landkreis' END, substr(code, 1, 3) FROM p WHERE part = '' AND district IS NOT NULL
  UNION ALL SELECT 'n' || substr(code, 1, 3), 'n' || substr(code, 1, 5), assoc || ', Verbandsgemeinde', substr(code, 1, 5) FROM p WHERE part = '' AND district IS NOT NULL AND assoc IS NOT NULL)
""")
def code_tree(t):
    """Part keys as commune codes."""
    code = F.lpad(F.col("p_partkey").cast("string"), 8, "1")
    district = F.when(F.col("p_type") == "PROMO", None).when(
        F.col("p_type") == "SMALL", F.concat(F.lit("Kreis "), F.substring(code, 1, 3))
    ).otherwise(F.concat(F.lit("Land"), F.substring(code, 1, 3)))
    communes = t.part.select(
        code.alias("code"), F.when(F.col("p_size") > 30, text("x", "p_size")).otherwise("").alias("part"), F.col("p_name").alias("label"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("VG"), F.substring(code, 1, 5))).alias("association"), district.alias("district"),
    )
    return tree.tree_from_codes(communes)


@query("""
WITH c AS (SELECT 'c' || c_custkey AS notation, c_name AS label FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region)
SELECT notation, label, row_number() OVER (ORDER BY label COLLATE de, label, notation) AS rank FROM c
""")
def concept_register(t):
    rows = tree.register(concepts(t)).select("id", "notation", "pref_label")
    return scan.ranked(rows, [], tree.register_order()).select("notation", F.col("pref_label").alias("label"), "rank")


@query("""
SELECT 'http://example.org/tree#n' || n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')
""")
def orphan_nodes(t):
    nodes = concepts(t).where(~F.col("pref_label").isin("ASIA", "EUROPE"))
    return tree.orphans(tree.build_tree(nodes)).select("id")


@query("""
SELECT event_id, 'first' AS collection FROM events WHERE event_type IN ('view', 'click', 'purchase')
UNION ALL SELECT event_id, 'second' FROM events WHERE event_type IN ('purchase', 'signup')
""")
def routed_records(t):
    """Purchases belong to both collections, errors to none."""
    kind = F.col("event_type")
    routes = {"first": kind.isin("view", "click", "purchase"), "second": kind.isin("purchase", "signup")}
    return sets.route_collections(t.events, routes).select("event_id", "collection")


@query("""
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def without_deleted(t):
    return sets.minus_deleted(t.documents.select("doc_id", "lang"), t.labels.where("toxic = 1"), "doc_id")


@query("""
WITH b AS (SELECT c_nationkey AS parent, c_mktsegment AS id, min(c_name) AS label FROM customer GROUP BY 1, 2),
e AS (SELECT c_nationkey + 1 AS parent, c_mktsegment AS id, 'extra' AS label FROM customer GROUP BY 1, 2)
SELECT * FROM b UNION ALL SELECT e.* FROM e LEFT JOIN b ON b.parent = e.parent AND b.id = e.id WHERE b.id IS NULL
""")
def overlaid_children(t):
    base = t.customer.groupBy(F.col("c_nationkey").alias("parent"), F.col("c_mktsegment").alias("id")).agg(F.min("c_name").alias("label"))
    extra = t.customer.select((F.col("c_nationkey") + 1).alias("parent"), F.col("c_mktsegment").alias("id"), F.lit("extra").alias("label")).distinct()
    return sets.overlay_children(base, extra)


@query("""
SELECT l_partkey AS child, max(l_suppkey) AS parent FROM lineitem GROUP BY 1
""")
def one_parent_each(t):
    """Suppliers as parents of their parts: the numerically last one stays."""
    edges = t.lineitem.select(F.col("l_suppkey").cast("string").alias("parent"), F.col("l_partkey").alias("child"))
    kept = sets.dedupe_across_parents(edges, "parent", "child", F.col("parent").cast("bigint"))
    return kept.select("child", F.col("parent").cast("bigint").alias("parent"))
