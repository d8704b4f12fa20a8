"""Change feeds with Structured Streaming. Each job gives the same table as its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.changes import final_versions
from ..session import scratch_path
from ..tables import BUCKET, BUCKETS, KeyedTable, path_exists, read_table, write_whole


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_dedupe(
    log: DataFrame, key: str, target: str, checkpoint: str, event_time: str | None = None, within: str | None = None, buckets: int = BUCKETS
):
    """First arrival per id into ``target``, whole rows.

    With an event time, duplicates come within ``within`` of each other and state older than that is let
    go. Without one there is no state at all: what has arrived is the target, dealt into hash buckets of
    the id (column ``_bucket``), and a micro-batch is anti-joined with the ids of the buckets that it
    touches. A batch that is repeated, after a failure or under a new checkpoint, adds nothing.

    First arrival is not the newest version; for that see ``upsert_stream``.
    """
    rows = log.where(F.col(key).isNotNull())
    if event_time and within:
        rows = rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key])
        writer = rows.writeStream.format("parquet").option("path", target)
    else:
        writer = rows.writeStream.foreachBatch(lambda batch, _: add_unknown(batch, key, target, buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def add_unknown(batch: DataFrame, key: str, target: str, buckets: int = BUCKETS) -> None:
    """Append one row of each id that ``target`` does not have."""
    spark = batch.sparkSession
    new = batch.dropDuplicates([key]).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if path_exists(spark, target):
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most one a bucket
        there = spark.read.schema(new.schema).parquet(target).where(F.col(BUCKET).isin(touched))
        new = new.join(there.select(F.col(key).alias("_there")), F.col(key) == F.col("_there"), "left_anti")
    new.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(target)


def upsert_stream(
    log: DataFrame, root: str, name: str, key: str, version: str, checkpoint: str, op: str = "op", delete: str = "delete",
    merge=None, buckets: int = BUCKETS, fold: bool = True,
):
    """Apply puts and deletes to a keyed table as they arrive.

    A micro-batch is cut down to one row per id first (partial aggregate), then written as a delta to
    the buckets of its ids; the newer version wins even if it came earlier. Deleted ids stay as markers
    with their version, so a late older put cannot bring them back. A repeated batch, or one of a new
    checkpoint, is added like any other: taking the newest version once more changes nothing. The target
    may have been written whole before, with or without the ``_gone`` marker. ``merge`` may join foreign
    records to the new rows. Buckets are folded when they are due, unless another job does that.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        last = final_versions(batch, key, version, op, delete)
        table = KeyedTable(batch.sparkSession, root, name, key, version, buckets)
        table.append(last if merge is None else merge(last))
        if fold:
            table.fold()

    return (
        log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def live_records(snapshot: DataFrame, op: str = "op") -> DataFrame:
    return snapshot.where(~F.col("_gone")).drop("_gone", op)


def replay_dedupe(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """Run ``stream_dedupe`` over all files there are and give back the target."""
    work = scratch_path(spark, "dedupe")
    stream_dedupe(read_log(spark, path, schema), key, f"{work}/out", f"{work}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{work}/out")


def replay_upserts(
    log: DataFrame, key: str, version: str, op: str = "op", delete: str = "delete", base: DataFrame | None = None, merge=None
) -> DataFrame:
    """Run ``upsert_stream`` over all files there are, onto ``base`` if there is one, and give back the live records."""
    spark = log.sparkSession
    work = scratch_path(spark, "upserts")
    if base is not None:
        write_whole(base, work, "records")
    upsert_stream(log, work, "records", key, version, f"{work}/state", op, delete, merge).awaitTermination()
    return live_records(read_table(spark, work, "records"), op)
