"""From documents to packed training sequences: five stages, each written as Parquet and read again.

Quality rules, language ID, n-gram Jaccard join, suffix-array dedup, packing. The first four return the
columns of ``documents``: rows that a filter rejects are gone, of near copies one stays, repeated
passages are cut out of the texts. The last returns one row per piece of a sequence, without its ids.

No stage but the first can be said in SQL whole (network, compression, token ids), so ORACLE_SQL is
None; tests/llm holds the result against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackfolio.llm import language_id, ngram_join, packing, quality, suffix_dedup
from stackfolio.llm.base import table
from stackfolio.llm.queries import tokenizer_path
from stackfolio.session import written

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_kept(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.language_kept(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.packed(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality rules", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
