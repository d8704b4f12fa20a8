"""One query per operator over its whole table; the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, filter_audit, html_text, language_id, licenses, ngram_join, packing, quality, search, sentence_pieces,
    sharding, simhash, suffix_dedup,
)
from .base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 24


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffled_shards(table(spark, sf_dir, "documents"), SHARDS)
    text, key = F.col("row.text"), F.col("row.doc_id")
    return out.select(
        key.alias("doc_id"), sharding.size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", sharding.shard_of(key, SHARDS + 1).alias("grown_shard"),
    )


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.measured(docs).drop("text")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.identified(docs.select("doc_id", "text"), language_id.learned(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.packed(docs, tokenizer_path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.deduplicated(docs)
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.license_scan(docs).drop("text", "detections")


@query
def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of every twentieth conversation against all turns."""
    turns = table(spark, sf_dir, "conversations")
    return search.top_k(turns, F.col("conv_id") % 20 == 0, ["conv_id", "turn"])


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.scored(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(filter_audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLES["op10_search"] = """
WITH rows AS (
  SELECT conv_id, turn, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM conversations
), lengths AS (SELECT conv_id, turn, len(words) AS n FROM rows),
facts AS (SELECT count(*)::DOUBLE AS n, avg(coalesce(n, 0)) AS mean FROM lengths),
tf AS (SELECT conv_id, turn, term, count(*)::DOUBLE AS tf FROM (SELECT conv_id, turn, unnest(words) AS term FROM rows) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (any_value(facts.n) - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM tf, facts GROUP BY term),
parts AS (
  SELECT tf.conv_id, tf.turn, term, w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / mean)) AS part
  FROM tf JOIN idf USING (term) JOIN lengths l ON l.conv_id = tf.conv_id AND l.turn = tf.turn, facts
), scored AS (
  SELECT q.conv_id AS query_conv_id, q.turn AS query_turn, r.conv_id AS row_conv_id, r.turn AS row_turn, round(sum(part), 6) AS score
  FROM tf q JOIN parts r USING (term) WHERE q.conv_id % 20 = 0 GROUP BY ALL
)
SELECT *, row_number() OVER (PARTITION BY query_conv_id, query_turn ORDER BY score DESC, row_conv_id, row_turn) AS rank
FROM scored QUALIFY rank <= 10
"""

ORACLES["op13_filter_audit"] = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY text), false)::INT AS failed
  FROM texts LEFT JOIN flags ON texts.doc_id = flags.doc_id
), counts AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS state
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), found AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN failed & (state | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & bit > 0 AND failed & state = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & bit > 0 AND failed & state > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & bit > 0 AND failed & state = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & bit > 0 AND failed & state = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM found
"""
