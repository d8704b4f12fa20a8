"""Quality rules: compression bands.

The zstandard ratio (compressed to raw bytes) of a whole text must lie in a band for its length, and
so must the ratios of most of its fixed chunks: repeated or templated text compresses too well,
random strings too badly. Short texts compress less, so the limits go by length. The ratio goes on
falling with length, so texts of two windows and more are judged by the pooled ratio of all their
windows, each one to two ``window`` bytes long, and by the share of their bytes in copies of earlier
content-cut chunks; ``ratio`` stays that of the whole text.

Cases: a null or empty text has no words and fails the base rules; texts of any length are measured
whole; repeated rows are measured each; columns of the input stay, ``measured`` adds its own and takes
the place of input columns with their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import per_batch, prepare, texts_of, with_columns

SYMBOLS = b"#*$%&|<>"
MEASURES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "ratio": pa.float64(), "bad_chunks": pa.float64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(),
}
SPARK_TYPES = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.bool_(): T.BooleanType()}


@dataclass(frozen=True)
class Bands:
    """(bytes from, least ratio, largest ratio) by length; limits and length of chunks; windows of long texts.

    The defaults were read off labelled texts: a little outside the ratios of good ones.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 2.0), (256, 0.525, 0.80), (512, 0.495, 0.75), (1024, 0.455, 0.65), (2048, 0.44, 0.58),
        (4096, 0.418, 0.53), (8192, 0.405, 0.50), (16384, 0.392, 0.48), (65536, 0.37, 0.46),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.41, 0.56)
    bad_share: float = 0.5
    level: int = 3
    window: int = 65536
    copied: float = 0.1  # clean long texts have up to .015


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    twice = set()
    for w in windows:
        if w in seen:
            twice.add(w)
        seen[w] = True
    total = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


GRAM, CUT_BITS, LEAST = 16, 7, 48  # a cut after one in 128 grams; shorter chunks may be equal by chance
PIECE = 1 << 20


def cuts(text: bytes) -> list[int]:
    """Places after the 16-grams whose hash begins with zeros: the same in each copy of a passage."""
    found = []
    for at in range(0, len(text) - GRAM + 1, PIECE):
        part = np.frombuffer(text[at : at + PIECE + GRAM - 1], np.uint8).astype(np.uint64)
        h = np.zeros(len(part) - GRAM + 1, np.uint64)
        for j in range(GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15) + part[j : j + len(h)]
        found += (np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + at + GRAM).tolist()
    return found


def copied_share(text: bytes) -> float:
    """Share of chunks equal to an earlier one, in bytes; the short ones count on neither side."""
    seen, copied, total, inner = set(), 0, 0, cuts(text)
    for a, b in zip([0, *inner], [*inner, len(text)]):
        if b - a >= LEAST:
            digest = blake2b(text[a:b], digest_size=8).digest()
            total += b - a
            copied += b - a if digest in seen else 0
            seen.add(digest)
    return copied / total if total else 0.0


class Meter:
    def __init__(self, bands: Bands):
        self.bands = bands
        self.compressor = zstandard.ZstdCompressor(level=bands.level)

    def ratio(self, data: bytes) -> float:
        return len(self.compressor.compress(data)) / len(data) if data else 0.0

    def pooled(self, text: bytes, n: int) -> float:
        """Ratio of n windows together, of equal length but for a byte."""
        ends = [len(text) * i // n for i in range(n + 1)]
        return sum(len(self.compressor.compress(text[a:b])) for a, b in zip(ends, ends[1:])) / len(text)

    def measure(self, text: bytes) -> tuple:
        b = self.bands
        words = text.split()  # splits at exactly the six ASCII white-space bytes
        n, repeats = len(words), repeated_words(words)
        failed = n < 50 or 100 * repeats > 50 * n
        ratio = self.ratio(text)
        n_windows = max(1, len(text) // b.window)
        least, most = next((x, y) for size, x, y in reversed(b.whole) if len(text) // n_windows >= size)
        chunks = [self.ratio(text[i : i + b.chunk_bytes]) for i in range(0, len(text) - b.chunk_bytes + 1, b.chunk_bytes)]
        bad = sum(not b.chunk[0] <= r <= b.chunk[1] for r in chunks) / len(chunks) if chunks else 0.0
        kept = not failed and bad <= b.bad_share
        if n_windows == 1:
            kept = kept and least <= ratio <= most
        else:
            kept = kept and least <= self.pooled(text, n_windows) <= most and copied_share(text) <= b.copied
        return (
            n, code_points(b"".join(words)), len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text),
            repeats, ratio, bad, failed, kept,
        )


def measured(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The rows with MEASURES: counts, ratio, share of chunks outside their band, verdict."""
    prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in MEASURES if c != text])
    schema = T.StructType([*docs.schema, *(T.StructField(n, SPARK_TYPES[t]) for n, t in MEASURES.items())])

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        meter = Meter(bands)
        columns = zip(*map(meter.measure, texts_of(batch.column(text))))
        return with_columns(batch, {n: pa.array(v, t) for (n, t), v in zip(MEASURES.items(), columns)})

    return docs.mapInArrow(per_batch(add), schema)


def quality_kept(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Rows that pass the base rules and the bands, with the columns they came with."""
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    whole = docs.select(docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return measured(whole, bands).where("kept").select(*columns)
