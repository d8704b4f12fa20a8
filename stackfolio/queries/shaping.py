"""Projections, predicates, repeated values, rules, triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.rules import Rule, all_outputs, apply_rules, rule_coverage
from ..functions.text import make_uri, paste, squeeze_spaces, words
from ..operators import aggregates, shape
from ..sources import decode_tagged, tagged_line
from .bindings import text
from .registry import query


def _order_fields(t):
    lines = t.orders.select(
        tagged_line(
            text("o", "o_orderkey"), F.concat(F.lit("#20 "), "o_orderpriority"), F.concat(F.lit("#700"), "o_orderstatus"),
            F.concat(F.lit("#701"), F.col("o_custkey").cast("string")), F.concat(F.lit("#70b"), F.year("o_orderdate")),
        ).alias("value")
    )
    return decode_tagged(lines)


@query("""
SELECT 'o' || o_orderkey AS rec_id, 'f700' AS tag, o_orderstatus AS value FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'f701', CAST(o_custkey AS VARCHAR) FROM orders
""")
def tags_by_pattern(t):
    return shape.select_tags(_order_fields(t), "f70[_123456789]|f700").select("rec_id", "tag", "value")


@query("""
WITH p AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls,
  CASE WHEN role = 'system' THEN '' ELSE role END AS r FROM conversations)
SELECT conv_id, turn, nullif(r, '') AS role, CASE WHEN len(ls) > 0 THEN len(ls) END AS lines, ls[1] AS first,
  CASE WHEN r = 'tool' OR r = 'user' THEN r END AS inner_role
FROM p
""")
def vacuumed_records(t):
    """Empty values at every depth become NULL."""
    role = F.when(F.col("role") == "system", "").otherwise(F.col("role"))
    nested = t.conversations.select(
        "conv_id", "turn", role.alias("role"), F.split("text", "\n").alias("lines"),
        F.struct(
            F.when(F.col("role").isin("tool", "user"), F.col("role")).otherwise("").alias("role"),
            F.array(F.lit("")).alias("none"),
        ).alias("inner"),
    )
    clean = shape.vacuum(shape.retain(nested, ["conv_id", "turn", "role", "lines", "inner", "absent"]))
    return clean.select(
        "conv_id", "turn", "role", F.size("lines").cast("bigint").alias("lines"), F.get("lines", F.lit(0)).alias("first"),
        F.col("inner.role").alias("inner_role"),
    ).withColumn("lines", F.when(F.col("lines") > 0, F.col("lines")))


@query("""
SELECT p_partkey FROM part WHERE p_size > 25 AND NOT (p_type = 'SMALL') AND p_brand LIKE 'Brand#1%'
""")
def kept_and_rejected(t):
    kept = shape.keep_where(t.part, (F.col("p_size") > 25) & F.col("p_brand").startswith("Brand#1"))
    return shape.reject_where(kept, F.col("p_type") == "SMALL").select("p_partkey")


@query("""
WITH w AS (SELECT p_partkey, p_brand, p_size, string_split(p_name, ' ') AS ws FROM part)
SELECT p_partkey, len(list_filter(ws, lambda x: regexp_full_match(x, 'r.*'))) > 0 AS any_match,
  len(list_filter(ws, lambda x: regexp_full_match(x, '[a-z]{3,5}'))) = len(ws) AS all_match,
  list_contains(ws, 'ring') AS any_equal, len(list_filter(ws, lambda x: contains(x, 'o'))) = len(ws) AS all_contain,
  len(list_filter(ws, lambda x: contains(x, 'e'))) = 0 AS none_contain,
  regexp_full_match(p_brand, 'Brand#[12]\\d?') AS text_match, p_size > 10 AS greater, list_has_any(ws, ['red', 'bolt']) AS overlaps
FROM w
""")
def value_predicates(t):
    ws = F.split("p_name", " ")
    return t.part.select(
        "p_partkey", P.any_match(ws, "r.*").alias("any_match"), P.all_match(ws, "[a-z]{3,5}").alias("all_match"),
        P.any_equal(ws, "ring").alias("any_equal"), P.all_contain(ws, "o").alias("all_contain"),
        P.none_contain(ws, "e").alias("none_contain"), P.text_match(F.col("p_brand"), r"Brand#[12]\d?").alias("text_match"),
        P.greater_than(F.col("p_size").cast("string"), 10).alias("greater"),
        P.overlaps(ws, F.array(F.lit("red"), F.lit("bolt"))).alias("overlaps"),
    )


@query("""
WITH d AS (
  SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents)
SELECT doc_id, len(ws) AS n_words, len(list_distinct(ws)) AS n_uniq, '<' || ws[1] || '>' AS first_edited,
  lang || ':' || ws[1] AS appended, ws[len(ws)] AS last_word,
  len(list_filter(ws, lambda w: regexp_matches(w, '^[aeiou]'))) AS vowel_words,
  len(list_filter(ws, lambda w: NOT regexp_matches(w, '^[aeiou]'))) AS other_words,
  md5(array_to_string(ws, ' | ')) AS joined
FROM d
""")
def edited_values(t):
    """Lists of words: edit, distinct, filter, append, prepend, join."""
    d = t.documents.select("doc_id", "lang", words(F.col("text")).alias("ws"))
    edited = shape.map_values(F.col("ws"), lambda w: F.concat(F.lit("<"), w, F.lit(">")))
    with_both = shape.prepended(shape.appended(F.col("ws"), F.col("lang")), F.col("lang"))
    return d.select(
        "doc_id", F.size("ws").cast("bigint").alias("n_words"), F.size(shape.uniq(F.col("ws"))).cast("bigint").alias("n_uniq"),
        F.get(edited, F.lit(0)).alias("first_edited"),
        F.concat_ws(":", F.element_at(with_both, -1), F.get(with_both, F.lit(1))).alias("appended"),
        F.try_element_at("ws", F.lit(-1)).alias("last_word"),
        F.size(shape.filter_values(F.col("ws"), "^[aeiou]")).cast("bigint").alias("vowel_words"),
        F.size(shape.filter_values(F.col("ws"), "^[aeiou]", invert=True)).cast("bigint").alias("other_words"),
        F.md5(shape.join_values(F.col("ws"), " | ")).alias("joined"),
    ).withColumn("appended", F.when(F.col("n_words") > 0, F.col("appended")))


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws, string_split(p_brand || '#' || p_type || '#' || p_size, '#') AS xs FROM part)
SELECT p_partkey, i AS pos, ws[i] AS word, xs[i] AS extra
FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws), len(xs)) + 1)) AS i)
""")
def zipped_lists(t):
    """Two lists of different length, item by item."""
    extra = F.split(F.concat_ws("#", "p_brand", "p_type", F.col("p_size").cast("string")), "#")
    pairs = shape.zip_lists(word=F.split("p_name", " "), extra=extra)
    rows = t.part.select("p_partkey", F.posexplode(pairs).alias("pos", "x"))
    return rows.select("p_partkey", (F.col("pos") + 1).cast("bigint").alias("pos"), "x.word", "x.extra")


@query("""
SELECT c_custkey, 'http://example.org/' || c_custkey AS uri, 'http://example.org/' || replace(c_name || ' & co/' || c_mktsegment, ' ', '%20') AS raw,
  'http://example.org/' || url_encode(c_name || ' & co/' || c_mktsegment) AS encoded, c_name || ', ' || c_mktsegment AS pasted
FROM customer
""")
def made_uris(t):
    label = F.concat("c_name", F.lit(" & co/"), "c_mktsegment")
    return t.customer.select(
        "c_custkey", make_uri(F.col("c_custkey").cast("string"), "http://example.org/").alias("uri"),
        make_uri(F.regexp_replace(label, " ", "%20"), "http://example.org/").alias("raw"),
        make_uri(label, "http://example.org/", encode=True).alias("encoded"),
        paste(F.col("c_name"), F.when(F.lit(False), "x"), F.col("c_mktsegment"), sep=", ").alias("pasted"),
    )


def _rules():
    size, kind, brand = F.col("p_size"), F.col("p_type"), F.col("p_brand")
    return [
        Rule((size > 40) & (kind == "PROMO"), "large promotion", "r1"),
        Rule(size > 40, "large", "r2"),
        Rule(kind.isin("ECONOMY", "SMALL"), "low", "r3"),
        Rule(brand.rlike("^Brand#2"), "second", "r4"),
    ]


@query("""
SELECT p_partkey, CASE WHEN p_size > 40 AND p_type = 'PROMO' THEN 'large promotion' WHEN p_size > 40 THEN 'large'
  WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'low' WHEN regexp_matches(p_brand, '^Brand#2') THEN 'second' ELSE 'other' END AS rule
FROM part
""")
def rules_first(t):
    return apply_rules(t.part, "rule", _rules(), "first", "other").select("p_partkey", "rule")


@query("""
SELECT p_partkey, concat_ws('|', CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'middle' END,
  CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'low' WHEN p_type = 'PROMO' AND p_size <= 40 THEN 'large' END,
  CASE WHEN p_name LIKE '%red%' THEN 'red' END) AS rules FROM part
""")
def rules_all(t):
    """Blocks add up, an output counts once."""
    size, kind = F.col("p_size"), F.col("p_type")
    blocks = [
        [Rule(size > 40, "large"), Rule(size > 20, "middle")],
        [Rule(kind.isin("ECONOMY", "SMALL"), "low"), Rule(kind == "PROMO", "large")],
        [Rule(F.col("p_name").contains("red"), "red")],
    ]
    return t.part.select("p_partkey", F.array_join(all_outputs(blocks), "|").alias("rules"))


@query("""
SELECT 'r1' AS rule, CAST(count(*) FILTER (p_size > 40 AND p_type = 'PROMO') AS BIGINT) AS rows FROM part
UNION ALL SELECT 'r2', count(*) FILTER (p_size > 40) FROM part
UNION ALL SELECT 'r3', count(*) FILTER (p_type IN ('ECONOMY', 'SMALL')) FROM part
UNION ALL SELECT 'r4', count(*) FILTER (regexp_matches(p_brand, '^Brand#2')) FROM part
""")
def rules_coverage(t):
    return rule_coverage(t.part, _rules())


@query("""
SELECT doc_id, quality IS NOT NULL AS labelled, coalesce(CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END,
  nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), 'N/A') AS status
FROM documents LEFT JOIN labels USING (doc_id)
""")
def filled_cascade(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    status = shape.fill_cascade(
        F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), default="N/A",
    )
    return rows.select("doc_id", shape.flag(F.col("quality")).alias("labelled"), status.alias("status"))


TRIPLES = """
SELECT CAST(p_partkey AS VARCHAR) AS s, 'p_brand' AS p, p_brand AS o FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_size', CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'words', unnest(string_split(p_name, ' ')) FROM part
"""


def _part_triples(t):
    record = t.part.select("p_partkey", "p_brand", "p_size", F.split("p_name", " ").alias("words"))
    return shape.unpivot_record(record, "p_partkey")


@query(TRIPLES)
def record_triples(t):
    return _part_triples(t)


@query(f"SELECT o AS key, count(*) AS n FROM ({TRIPLES}) GROUP BY o")
def triples_by_object(t):
    return aggregates.count_by(_part_triples(t), "o")


@query(f"SELECT p AS key, count(*) AS n FROM ({TRIPLES}) GROUP BY p")
def triples_by_predicate(t):
    return aggregates.count_by(_part_triples(t), "p")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS s, p_brand, CAST(p_size AS VARCHAR) AS p_size,
  array_to_string(list_sort(string_split(p_name, ' ')), '|') AS words FROM part
""")
def rebuilt_records(t):
    names = ["p_brand", "p_size", "words"]
    return shape.rebuild(_part_triples(t), names).select("s", *[F.array_join(c, "|").alias(c) for c in names])


@query("""
WITH x AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM conversations)
SELECT conv_id, turn, len(ws) AS n_words, md5(array_to_string(ws, ' ')) AS words FROM x
""")
def flattened_lists(t):
    """Words per line, flattened to one list, equal the words of the text."""
    per_line = F.transform(F.split("text", "\n"), lambda line: F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    ws = shape.flatten_lists(per_line)
    return t.conversations.select(
        "conv_id", "turn", F.size(ws).cast("bigint").alias("n_words"), F.md5(F.array_join(ws, " ")).alias("words")
    )


@query("""
SELECT doc_id, md5(regexp_replace(text, ' +', ' ', 'g')) AS squeezed FROM documents
""")
def squeezed_texts(t):
    return t.documents.select("doc_id", F.md5(squeeze_spaces(F.col("text"))).alias("squeezed"))
