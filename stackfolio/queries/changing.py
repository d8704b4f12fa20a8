"""Change logs, contracts, repairs of whole sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import changes, contract, lookup, quality
from ..session import scratch_path
from ..sinks import read_snapshot, swap_snapshot
from ..streaming.changes import read_log, replay_dedupe, replay_upserts
from .registry import query

LATEST = """
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS op, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1)
SELECT user_id, event_id, round(value, 2) AS value FROM l WHERE op <> 'error'
"""


def _log(rows):
    """Events as change log of users: an error deletes, anything else puts."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return rows.select("user_id", "event_id", F.round("value", 2).alias("value"), op.alias("op"))


@query(LATEST)
def changes_applied(t):
    return changes.apply_changes(None, _log(t.events), "user_id", "event_id")


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS op, max(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY 1),
b AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS event_id FROM events WHERE event_type = 'view')
SELECT user_id, event_id FROM l WHERE op <> 'error' UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM l)
""")
def changes_over_base(t):
    """Users seen in views are the base set, all other events the log."""
    base = t.events.where("event_type = 'view'").select("user_id", F.lit(-1).cast("bigint").alias("event_id")).distinct()
    log = _log(t.events.where("event_type <> 'view'")).drop("value")
    return changes.apply_changes(base, log, "user_id", "event_id")


@query(LATEST)
def stream_upserts(t):
    """The log as a stream into a snapshot; the same table as the batch."""
    stream = read_log(t.spark, t.path("events") + "*", t.events.schema)
    return replay_upserts(_log(stream), "user_id", "event_id")


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS op, max(event_id) AS event_id, arg_max(round(value, 2), event_id) AS value
  FROM events GROUP BY 1),
b AS (SELECT c_custkey AS user_id, CAST(-1 AS BIGINT) AS event_id, round(c_acctbal, 2) AS value, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS brand FROM customer)
SELECT l.user_id, event_id, value, c_name AS name, p_brand AS brand FROM l LEFT JOIN customer ON c_custkey = user_id
  LEFT JOIN part ON p_partkey = user_id WHERE op <> 'error'
UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM l)
""")
def stream_upserts_onto_base(t):
    """Users' events as a stream onto all customers, each new row merged with the foreign records of its id."""
    base = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), F.round("c_acctbal", 2).alias("value"))
    names = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    brands = t.part.select(F.col("p_partkey").alias("user_id"), F.col("p_brand").alias("brand"))

    def merge(rows):
        return lookup.merge_external(lookup.merge_external(rows, names, "user_id"), brands, "user_id")

    stream = _log(read_log(t.spark, t.path("events") + "*", t.events.schema))
    return replay_upserts(stream, "user_id", "event_id", base=base, merge=merge)


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(t):
    """First arrival per user; which event that is depends on arrival, so only the ids are compared."""
    return replay_dedupe(t.spark, t.path("events") + "*", t.events.schema, "user_id").select("user_id")


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'de'")
def swapped_snapshot(t):
    """Two versions written, the second one is read."""
    root = scratch_path(t.spark, "snapshots")
    swap_snapshot(t.documents.select("doc_id", "lang"), root, "docs")
    swap_snapshot(t.documents.where("lang <> 'de'").select("doc_id", "lang"), root, "docs")
    return read_snapshot(t.spark, root, "docs")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'o_totalprice' AS path, 'pattern' AS rule FROM orders WHERE NOT regexp_matches(CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR), '^[1-3]\\d+$')
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_orderstatus', 'enum' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'note', 'required' FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'link', 'uri' FROM orders WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'kind', 'const' FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def contract_violations(t):
    priority = F.col("o_orderpriority")
    rows = t.orders.select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"),
        F.when(priority != "5-LOW", priority).alias("note"),
        F.when(priority == "2-HIGH", "no uri").otherwise("http://example.org/x").alias("link"),
        F.when(priority == "1-URGENT", "other").when(priority == "5-LOW", None).otherwise("order").alias("kind"),
    ).withColumn("o_totalprice", F.round("o_totalprice", 0).cast("bigint"))
    checks = [
        quality.pattern("o_totalprice", r"^[1-3]\d+$"), quality.one_of("o_orderstatus", ["O", "F"]), quality.required("note"),
        quality.uri("link"), quality.constant("kind", "order"),
    ]
    return quality.validate(rows, "o_orderkey", checks)


CONTRACT_FILES = {
    "uri.json": {"type": "string", "format": "uri"},
    "agent.json": {
        "type": "object", "required": ["label"],
        "properties": {
            "label": {"type": "string", "pattern": "^Customer [0-9]"}, "id": {"$ref": "uri.json"},
            "type": {"type": "array", "minItems": 1, "items": {"type": "string", "enum": ["Person", "CorporateBody"]}},
        },
    },
}
CONTRACT = {
    "$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "required": ["id", "title", "contribution"],
    "properties": {
        "id": {"type": "string", "pattern": "^[0-9]+$"}, "title": {"type": "string"},
        "contribution": {"type": "array", "items": {"type": "object", "properties": {
            "agent": {"$ref": "agent.json"}, "role": {"type": "object", "properties": {"kind": {"const": "Role"}}},
        }}},
        "publication": {"oneOf": [{"required": ["year"]}, {"required": ["note"]}]},
        "place": {"anyOf": [{"required": ["label"]}, {"properties": {"id": {"$ref": "uri.json"}}, "required": ["id"]}]},
    },
}


@query("""
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS u, o_custkey AS c, o_totalprice > 200000 AS dear FROM orders)
SELECT id, 'title' AS path, 'required' AS rule FROM o WHERE u = '5'
UNION ALL SELECT id, 'contribution/0/agent/id', 'format' FROM o WHERE s = 'F'
UNION ALL SELECT id, 'contribution/0/agent/type/1', 'enum' FROM o WHERE s = 'P'
UNION ALL SELECT id, 'contribution/1/agent/label', 'required' FROM o WHERE u = '1'
UNION ALL SELECT id, 'contribution/1/agent/label', 'pattern' FROM o WHERE u = '2'
UNION ALL SELECT id, 'contribution/1/agent/type', 'minItems' FROM o WHERE dear
UNION ALL SELECT id, 'contribution/1/role/kind', 'const' FROM o WHERE u = '3'
UNION ALL SELECT id, 'publication', 'oneOf' FROM o WHERE (s = 'O') = (u <> '4')
UNION ALL SELECT id, 'place', 'anyOf' FROM o WHERE s <> 'F' AND c % 2 = 0
""")
def nested_contract_violations(t):
    """A contract of several schema files over nested records; each violation with its place in the lists."""
    s, u, c = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("o_custkey").cast("string")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    first = F.struct(
        text("Customer ", c).alias("label"), F.when(s == "F", "no address").otherwise(text("http://example.org/", c)).alias("id"),
        F.when(s == "P", F.array(F.lit("Person"), F.lit("Ghost"))).otherwise(F.array(F.lit("Person"))).alias("type"),
    )
    second = F.struct(
        F.when(u == "2", text("Body ", c)).when(u != "1", text("Customer ", c)).alias("label"), F.lit(None).cast("string").alias("id"),
        F.when(F.col("o_totalprice") > 200000, F.array().cast("array<string>")).otherwise(F.array(F.lit("CorporateBody"))).alias("type"),
    )
    role = lambda kind: F.struct(kind.alias("kind"))
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(u != "5", "T").alias("title"),
        F.array(
            F.struct(first.alias("agent"), role(F.lit("Role")).alias("role")),
            F.struct(second.alias("agent"), role(F.when(u == "3", "Rule").otherwise("Role")).alias("role")),
        ).alias("contribution"),
        F.struct(F.when(s == "O", 1999).alias("year"), F.when(u != "4", "n").alias("note")).alias("publication"),
        F.struct(F.when(s == "F", "Town").alias("label"), F.when(F.col("o_custkey") % 2 == 1, "http://example.org/p").otherwise("p").alias("id")).alias("place"),
    )
    return contract.contract_violations(rows, "id", CONTRACT, CONTRACT_FILES)


@query("""
SELECT 'lang' AS path, 'enum' AS rule, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT 'text', 'pattern', count(*) FROM documents WHERE NOT regexp_matches(text, '^\\p{Lu}') HAVING count(*) > 0
""")
def violations_per_rule(t):
    checks = [quality.one_of("lang", ["en", "de"]), quality.pattern("text", r"^\p{Lu}")]
    return quality.violation_counts(quality.validate(t.documents, "doc_id", checks))


@query("""
SELECT 'o' || o_orderkey AS rec_id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'
""")
def subset_of_records(t):
    """Records with a status and without a number field, from the long field table."""
    fields = t.orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("rec_id"),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("f36_").alias("tag"), F.col("o_orderstatus").alias("value")),
                    F.when(F.col("o_orderpriority") == "1-URGENT", F.struct(F.lit("f983").alias("tag"), F.lit("x").alias("value"))),
                ),
                lambda f: f.isNotNull(),
            )
        ).alias("f"),
    ).select("rec_id", "f.*")
    return quality.select_subset(fields, ("f36_", "O"), "f983")
