"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions.identifiers import AUTHORITY_ID
from ..operators import changes, tree
from ..session import scratch_path
from ..sources import (
    decode_tagged, marc_fields, mine_ids, parse_beacon, parse_lookup, parse_marcxml, parse_ndjson, parse_skos,
    register_entries, rejected_lines, select_entity, tagged_line, to_marcxml,
)
from .bindings import MARC_SUBFIELDS, concepts, marc_rows, text
from .registry import query


@query("""
WITH o AS (SELECT 'o' || o_orderkey AS rec_id, * FROM orders)
SELECT rec_id, CAST(1 AS BIGINT) AS seq, 'f00_' AS tag, rec_id AS value FROM o
UNION ALL SELECT rec_id, 2, 'f20_', o_orderpriority FROM o
UNION ALL SELECT rec_id, 3, 'f36_', 's' FROM o
UNION ALL SELECT rec_id, 4, 'f76b', CAST(year(o_orderdate) AS VARCHAR) FROM o
UNION ALL SELECT rec_id, 5, 'f983', o_orderstatus FROM o
""")
def tagged_roundtrip(t):
    lines = t.wide("orders", "o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus").select(
        tagged_line(
            text("o", "o_orderkey"), F.concat(F.lit("#20 "), "o_orderpriority"), F.lit("#36 s"),
            F.concat(F.lit("#76b"), F.year("o_orderdate")), F.concat(F.lit("#983"), "o_orderstatus"),
        ).alias("value")
    )
    return decode_tagged(lines).withColumn("seq", F.col("seq").cast("bigint"))


@query("""
SELECT text AS source, 'Can''t get ID from input' AS problem FROM conversations WHERE role <> 'assistant'
""")
def tagged_rejects(t):
    lines = t.conversations.select(
        F.when(F.col("role") == "assistant", tagged_line(F.col("turn").cast("string"), F.concat(F.lit("#20 "), "text")))
        .otherwise(F.col("text")).alias("value")
    )
    return rejected_lines(lines)


@query("""
WITH d AS (
  SELECT 'd' || doc_id AS rec, lang || ' ' || source AS title, lang, string_split(replace(text, '¬', ''), chr(10)) AS paras
  FROM documents),
parent AS (
  SELECT rec, [struct_pack(tag := 'f00_', value := rec), struct_pack(tag := 'f20_', value := title)]
    || CASE WHEN lang = 'de' THEN [struct_pack(tag := 'f88_', value := '1-x')] ELSE [] END
    || [struct_pack(tag := 'f36_', value := 'sm'),
        struct_pack(tag := 'f36t', value := CASE WHEN lang = 'de' THEN 'Periodical' ELSE 'MultiVolumeBook' END)] AS fs
  FROM d),
volume AS (
  SELECT rec || 'b' || n AS rec,
    [struct_pack(tag := 'f00_', value := rec || 'b' || n), struct_pack(tag := 'f20u', value := title),
     struct_pack(tag := 'f20_', value := title || ' : ' || paras[n]), struct_pack(tag := 'f01_', value := paras[n]),
     struct_pack(tag := 'f36_', value := 'sbd')] AS fs
  FROM d, LATERAL (SELECT unnest(range(1, len(paras) + 1)) AS n)),
every AS (SELECT * FROM parent UNION ALL SELECT * FROM volume)
SELECT rec AS rec_id, i AS seq, fs[i].tag AS tag, fs[i].value AS value
FROM every, LATERAL (SELECT unnest(range(1, len(fs) + 1)) AS i)
""")
def multivolume_split(t):
    """A document is a multi-volume record, its paragraphs are the volumes."""
    volumes = F.transform(
        F.split("text", "\n"), lambda p: F.concat(F.lit("#01 "), p, F.lit("[/]#36 sbd"))
    )
    lines = t.wide("documents", "doc_id", "text", "lang", "source").select(
        tagged_line(
            text("d", "doc_id"), F.concat(F.lit("#20 "), "lang", F.lit(" "), "source"),
            F.when(F.col("lang") == "de", "#88 1-x"), F.lit("#36 sm"), F.array_join(volumes, "[/]"),
        ).alias("value")
    )
    return decode_tagged(lines).withColumn("seq", F.col("seq").cast("bigint"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def json_payload(t):
    lines = t.events.select(
        F.concat(F.lit('{"data":{"id":'), "event_id", F.lit(',"attributes":'), "props", F.lit("}}")).alias("value")
    )
    rows = parse_ndjson(lines, F.col("value"), "id bigint, attributes struct<k:bigint>", "data")
    return rows.select(F.col("id").alias("event_id"), "attributes.k")


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)
SELECT p_partkey AS part, ws[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)
""")
def json_members(t):
    member = F.transform(
        F.split("p_name", " "), lambda w: F.struct(F.struct(F.col("p_partkey").alias("part"), w.alias("word")).alias("attributes"))
    )
    lines = t.part.select(F.to_json(F.struct(member.alias("member"))).alias("value"))
    return parse_ndjson(lines, F.col("value"), "part bigint, word string", "member[].attributes")


@query("""
SELECT event_id, user_id FROM events WHERE event_type = 'purchase'
""")
def entity_of_export(t):
    return select_entity(t.events, "purchase", "event_type").select("event_id", "user_id")


@query(f"""
WITH found AS (
  SELECT unnest(regexp_extract_all(text, '{AUTHORITY_ID}')) AS id FROM documents
  UNION ALL SELECT unnest(regexp_extract_all(html, '{AUTHORITY_ID}')) FROM pages)
SELECT id FROM found UNION SELECT translate(id, '-', 'n') FROM found
""")
def mined_ids(t):
    texts = t.wide("documents", "text").unionByName(t.pages.select(F.col("html").alias("text")))
    return mine_ids(texts, "text", AUTHORITY_ID)


@query("""
SELECT p_brand AS k, arg_max(p_name, p_partkey) AS v FROM part GROUP BY p_brand
""")
def lookup_from_lines(t):
    good = F.concat_ws("\t", "p_brand", F.col("p_size").cast("string"), "p_name")
    narrow = F.concat_ws("\t", "p_brand", "p_type")
    lines = t.part.select(F.explode(F.array(good, narrow)).alias("value"), "p_partkey")
    return parse_lookup(lines, 0, 2, expected_columns=3, order_col="p_partkey")


@query("""
SELECT 'http://example.org/tree#c' || c_custkey AS id, c_name AS pref_label,
  'http://example.org/tree#n' || c_nationkey AS broader, 'c' || c_custkey AS notation FROM customer
UNION ALL SELECT 'http://example.org/tree#n' || n_nationkey, n_name, 'http://example.org/tree#r' || n_regionkey,
  'n' || n_nationkey FROM nation
UNION ALL SELECT 'http://example.org/tree#r' || r_regionkey, r_name, NULL, 'r' || r_regionkey FROM region
""")
def skos_roundtrip(t):
    """Concept tree written as Turtle blocks and read back."""
    nodes = concepts(t).select(
        F.col("broader").alias("parent"), "id", F.col("pref_label").alias("label"), "notation"
    )
    blocks = sinks.skos_blocks(nodes, "http://example.org/tree")
    return parse_skos(blocks).select("id", "pref_label", "broader", "notation")


@query("""
SELECT source AS feed, CAST(doc_id AS VARCHAR) AS id, 'http://www.' || source || '.example/x/' || doc_id AS url,
  CASE WHEN lang = 'zz' THEN NULL WHEN length(source) = 4 THEN 'Feed ' || source ELSE source || '.example' END AS name
FROM documents
""")
def beacon_links(t):
    """Each document source is a feed; feeds with a two-digit number have no name in their header."""
    head = t.documents.select("source").distinct().select(
        F.col("source").alias("feed"),
        F.explode(
            F.array(
                F.concat(F.lit("#TARGET: http://www."), "source", F.lit(".example/x/{ID}")),
                F.when(F.length("source") == 4, F.concat(F.lit("#NAME:  Feed   "), "source")),
                F.lit("#FORMAT: BEACON"),
            )
        ).alias("value"),
    ).where("value IS NOT NULL")
    data = t.documents.select(F.col("source").alias("feed"), F.concat("doc_id", F.lit("|1|")).alias("value"))
    lines = head.unionByName(data)
    return parse_beacon(lines)


@query("""
SELECT 'Zeitschrift ''' || s_name || '''' AS label, 'http://example.org/' || s_suppkey AS value FROM supplier
""")
def register_csv_entries(t):
    rows = t.supplier.select(
        F.concat(F.lit('Zeitschrift "'), "s_name", F.lit('"')).alias("label"),
        F.concat(F.lit('"http://example.org/'), "s_suppkey", F.lit('"')).alias("value"),
    )
    return register_entries(rows)


@query(f"WITH {MARC_SUBFIELDS} SELECT * FROM subfields")
def marcxml_roundtrip(t):
    """MARC rows written as XML, parsed again, in long form: every subfield of every record."""
    return marc_fields(parse_marcxml(to_marcxml(marc_rows(t)), "xml")).select("rec_id", "tag", "code", "value")


@query("""
SELECT '{"index":{"_index":"titles","_type":"resource","_id":"' || n_nationkey || '"}}' || chr(10) ||
  '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation
""")
def bulk_lines(t):
    return sinks.bulk_lines(t.nation.select("n_nationkey", "n_name"), "n_nationkey", "titles", "resource")


@query("""
SELECT '{"key":' || c_custkey || ',"name":"' || c_name || '"' || CASE WHEN c_mktsegment <> 'MACHINERY' THEN ',"segments":["' || c_mktsegment || '"]' ELSE '' END
  || CASE WHEN c_nationkey % 2 = 0 THEN ',"nation":{"id":' || c_nationkey || '}' ELSE '' END || '}' AS value FROM customer
""")
def ndjson_written(t):
    """Records written as JSON lines and read back as text; absent fields are left out."""
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    rows = t.customer.select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.when(segment != "MACHINERY", F.array(segment)).alias("segments"),
        F.when(nation % 2 == 0, F.struct(nation.alias("id"))).alias("nation"),
    )
    path = scratch_path(t.spark, "ndjson")
    sinks.write_ndjson(rows, path)
    return t.spark.read.text(path)


@query("""
SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conv_id, role, replace(text, chr(10), ';') AS text FROM conversations
""")
def lookup_tsv_lines(t):
    return sinks.tsv_lines(t.conversations, ["conv_id", "role", "text"], distinct=True)


@query("""
SELECT 1 AS place, source AS v, CASE WHEN source = min(source) OVER () THEN '' ELSE ',' END || '"' || source || '"' AS value
FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT 0, NULL, '[' UNION ALL SELECT 2, NULL, ']'
""")
def json_value_list(t):
    return sinks.json_array_lines(t.documents, "source")


@query("""
SELECT c_custkey AS id, 'PUT' AS method, 'http://localhost/api/customers/' || c_custkey AS url,
  '{"data":{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}}' AS body
FROM customer WHERE c_acctbal < 0
""")
def update_requests(t):
    """Requests for the customers whose segment was another one before."""
    before = t.customer.withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, "none").otherwise(F.col("c_mktsegment")))
    changed = changes.changed_only(before, t.customer, "c_custkey", ["c_name", "c_mktsegment"])
    return sinks.build_updates(changed, "c_custkey", ["c_name", "c_mktsegment"], "http://localhost", "customers")


@query("""
SELECT 'POST' AS method, 'http://localhost/api/parts' AS url,
  '{"data":{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}}' AS body FROM part WHERE p_name LIKE '%bolt%'
""")
def create_requests(t):
    rows = t.part.select("p_partkey", "p_name")
    return sinks.build_creates(rows, F.col("p_name").contains("bolt"), "http://localhost", "parts")


@query("""
WITH v AS (SELECT source AS name, doc_id AS created, CAST(doc_id AS VARCHAR) AS version, lang = 'de' AS aliased FROM documents),
f AS (SELECT * FROM v WHERE NOT aliased)
SELECT name, version, created FROM f WHERE (name, created) NOT IN (SELECT name, max(created) FROM f GROUP BY name)
""")
def prunable_snapshots(t):
    """Documents stand for index versions of their source, German ones are in use."""
    versions = t.documents.select(
        F.col("source").alias("name"), F.col("doc_id").cast("string").alias("version"),
        F.col("doc_id").alias("created"), (F.col("lang") == "de").alias("aliased"),
    )
    return sinks.prune_snapshots(versions)


@query("""
WITH c AS (SELECT 'c' || c_custkey AS n, 'n' || c_nationkey AS up, c_name AS l FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, r_name FROM region)
SELECT 'http://example.org/tree#' || n AS id,
  '<http://example.org/tree#' || n || '>' || chr(10) || '    a skos:Concept ;' || chr(10) ||
  CASE WHEN up IS NULL THEN '' ELSE '    skos:broader <http://example.org/tree#' || up || '> ;' || chr(10) END ||
  '    skos:inScheme <http://example.org/tree> ;' || chr(10) || '    skos:notation "' || n || '" ;' || chr(10) ||
  '    skos:prefLabel "' || l || '"@de .' || chr(10) AS value
FROM c
""")
def skos_text(t):
    nodes = tree.build_tree(concepts(t))
    with_notation = nodes.withColumn("notation", F.element_at(F.split("id", "#"), -1))
    return sinks.skos_blocks(with_notation, "http://example.org/tree")
