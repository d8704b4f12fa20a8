"""What the operators share: reading tables, Arrow batch settings, word tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import tune

# Python sees texts in batches; a batch stays small whatever the length of the table.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
    # a small side with a filter also thins out the other before its exchange, whatever the table's size
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of a text column of a batch; a null text is empty."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def give_back() -> None:
    """Memory that Arrow's pool or malloc keeps without use goes back to the system.

    Python workers live on between tasks; what one of them keeps is missing to all later steps.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """``f`` on each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)
        batch = None
        give_back()

    return run


class WordTable:
    """Word → value, kept between batches of a worker.

    Two generations of at most ``size`` entries bound its memory: a word used again moves to the
    young one, and the old one goes when the young one is full. Words longer than ``longest`` are not
    kept. It only saves time; values depend on the word alone.
    """

    def __init__(self, make: Callable[[list], list], size: int = 300_000, longest: int = 64):
        self.make, self.size, self.longest = make, size, longest
        self.young: dict = {}
        self.old: dict = {}

    def values(self, words: list) -> list:
        young, old = self.young, self.old
        found = list(map(young.get, words))
        if None in found:
            missing = []
            for word in {w for w, v in zip(words, found) if v is None}:
                if (value := old.get(word)) is None:
                    missing.append(word)
                else:
                    young[word] = value
            if missing:
                young.update(zip(missing, self.make(missing)))
            found = list(map(young.get, words))
            for word in missing:
                if len(word) > self.longest:
                    del young[word]
            if len(young) > self.size:
                self.old, self.young = young, {}
        return found
