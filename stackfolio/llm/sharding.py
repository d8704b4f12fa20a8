"""Sharding: a two-pass external shuffle under the law ``key``.

Pass one scatters whole records: the shard of a row is the one of the largest seeded hash of
(shard, id), so that one more shard takes rows only into itself; inside a shard, another seeded hash
deals rows into buckets that fit into memory. Pass two shuffles each bucket by Fisher-Yates with a
generator seeded by (seed, shard, bucket). Both passes depend on the rows alone: a task that is run
again gives the same order.

Cases: a null id is an id like another, a null text has no bytes; an empty table gives no rows; rows
equal in every column are kept as they are and share a bucket; records travel as one struct, so no
column of theirs can clash. Columns of a map type are not supported (they have no hash).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SEED = 20240229
BUCKET_BYTES = 16 << 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is largest."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("s")) for i in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0])["s"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _shuffler(seed: int):
    def shuffle(key: tuple, rows: pa.Table, start: pa.Table) -> pa.Table:
        shard, bucket = key[0].as_py(), key[1].as_py()
        order = rows.column("place").to_numpy().argsort(kind="stable")
        np.random.default_rng([seed, shard, bucket]).shuffle(order)  # Fisher-Yates
        first = start.column("first")[0].as_py()
        out = rows.take(pa.array(order)).drop_columns(["place"])
        return out.append_column("slot", pa.array(np.arange(first, first + len(order)), pa.int64()))

    return shuffle


def shuffled_shards(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
    seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Columns: shard, bucket, row (the whole record), slot (its place in the shard, gapless from 0).

    Two passes over the input: sizes and counts first (ids and sizes only, partly summed before the
    exchange), then one exchange of the records by (shard, bucket).
    """
    total = docs.agg(F.sum(size_of(docs[text]))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    place = F.xxhash64(F.lit(seed + 1), *[docs[c] for c in docs.columns])
    dealt = docs.select(
        shard_of(docs[key], shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 2), docs[key], docs[text]), F.lit(buckets)).cast("int").alias("bucket"),
        place.alias("place"),
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
    )
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    schema = T.StructType([f for f in dealt.schema if f.name != "place"]).add("slot", T.LongType())
    return (
        dealt.groupBy("shard", "bucket").cogroup(starts.groupBy("shard", "bucket")).applyInArrow(_shuffler(seed), schema)
    )


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Parquet folders by shard and bucket; rows of a file lie in slot order."""
    out = shuffled_shards(docs, shards, **options)
    out.sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard", "bucket").parquet(path)
