"""Suffix-array dedup: repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``span`` bytes that covers it also starts anywhere else. Sorting all
suffixes of a corpus moves many times its size, so only suffixes that can have an equal are sorted:

1. Initial buckets. Each window of ``span`` bytes names one of its q-grams (the leftmost of least hash),
   so equal windows name the same q-gram at the same offset. Neighbouring windows that name the same
   place make one stretch; a bucket holds the stretches that name the same q-gram.
2. A bucket with one stretch has no repeat; in one whose stretches are all alike, everything is
   repeated. Both are seen by sums made before the exchange, so copies cost a row a task.
3. The different stretches of the other buckets are refined by bytes: positions get bucket numbers by
   4-gram (per bucket and offset), then by pairs of the numbers at i and i + 4, i + 8, ... up to the
   span, each round reusing the numbers of the one before. Windows that share a last number are equal.
4. A bucket of more than ``chunk`` different stretches (a passage with that many surroundings) is not
   gathered: its windows are counted by a digest of 128 bits, one key a window.

Cases: a null text is empty; texts shorter than a span keep all; a text that occurs twice repeats
itself wholly; overlaps inside a text count; repeated rows and null ids are rows like others (texts
are known by a digest, not by id); only id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .base import per_batch, prepare, texts_of

SPAN = 200
Q = 32
SEGMENT = 2 << 20
CHUNK = 4096
PLACE = np.uint64((1 << 24) - 1)  # low bits of a sort key hold the place in a segment

RANDOM = np.random.default_rng(7)
BYTE_HASH = RANDOM.integers(0, 1 << 64, 256, np.uint64)
STEP_HASH = RANDOM.integers(0, 1 << 63, 6, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the Q = 32 bytes from each place, by doubling."""
    h = BYTE_HASH[buf]
    for k, step in enumerate((1, 2, 4, 8, 16)):
        h = h[:-step] * STEP_HASH[k] + h[step:]
    h ^= h >> np.uint64(29)
    h *= STEP_HASH[5]
    h ^= h >> np.uint64(32)
    return h


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of each ``width`` neighbouring values (their upper 40 bits)."""
    m = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    return (m & PLACE).astype(np.int64)


def stretches(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, offset of the q-gram, its hash, digest) of all stretches."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    parts: list[tuple] = []
    for g in range(0, max(0, len(data) - span + 1), SEGMENT):
        buf = np.frombuffer(data, np.uint8, min(SEGMENT + span - 1, len(data) - g), g)
        windows = len(buf) - span + 1
        mark = np.zeros(windows + 1, np.int32)
        lo = np.clip(starts - g, 0, windows)
        hi = np.clip(ends - span + 1 - g, 0, windows)
        some = hi > lo
        np.add.at(mark, lo[some], 1)
        np.add.at(mark, hi[some], -1)
        valid = np.cumsum(mark[:-1]) > 0
        if not valid.any():
            continue
        h = gram_hashes(buf)
        p = least_places(h, span - Q + 1)
        new = np.ones(windows, bool)
        new[1:] = p[1:] != p[:-1]
        before = np.zeros(windows, bool)
        before[1:] = valid[:-1]
        first = np.flatnonzero(valid & (new | ~before))
        last_of = np.zeros(windows, bool)
        last_of[:-1] = new[1:] | ~valid[1:]
        last_of[-1] = True
        last = np.flatnonzero(valid & last_of)
        of = np.searchsorted(ends, first + g, side="right")
        at = p[first]
        digest = [xxhash.xxh3_64_intdigest(data[g + s : g + e + span], seed=o) for s, e, o in zip(first.tolist(), last.tolist(), (at - first).tolist())]
        base = g - starts[of]
        parts.append((of, first + base, last + base, at - first, h[at].astype(np.int64), np.array(digest, np.uint64).astype(np.int64)))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*parts))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense number of each key and how often it occurs."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number, count[number] > 1


def repeated_windows(bucket: np.ndarray, offset: np.ndarray, parts: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each stretch, which of its windows another stretch of its bucket has too (at its offset)."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    first = ends - sizes
    total = int(ends[-1])
    buf = np.frombuffer(b"".join(parts) + bytes(4), np.uint8)
    of = np.repeat(np.arange(len(parts)), sizes)
    # column: place relative to the q-gram, with the bucket, so that only like places compare
    column = np.arange(total) - np.repeat(first + offset, sizes)
    _, bucket = np.unique(bucket, return_inverse=True)
    width = 4 * span
    lane = bucket[of] * width + column + 2 * span
    gram = np.zeros(total, np.int64)
    for k in range(4):
        gram |= buf[k : k + total].astype(np.int64) << (8 * k)
    number, twice = numbered((lane << 32) | gram)
    del of, column, lane, gram
    depth = 4
    # a window lives while all its parts have an equal somewhere
    live = np.arange(total) <= np.repeat(ends - span, sizes)
    while True:
        alone = np.concatenate([[0], np.cumsum(~twice)])
        reach = span - depth + 1
        w = np.flatnonzero(live)
        w = w[alone[w + reach] == alone[w]]
        live = np.zeros(total, bool)
        live[w] = True
        if depth == span or not len(w):
            break
        step = min(depth, span - depth)
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, w, 1)
        np.add.at(cover, w + reach - step, -1)
        i = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        pairs, equal = numbered(number[i] * (int(number.max()) + 1) + number[i + step])
        number, twice = np.zeros(total, np.int64), np.zeros(total, bool)
        number[i], twice[i] = pairs + 1, equal
        depth += step
    return [live[a : b - span + 1] for a, b in zip(first, ends)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the stretches of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _bucket_rows(docs: DataFrame, span: int) -> DataFrame:
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, s, e, o, a, t = stretches(texts_of(batch.column("text")), span)
        keys = batch.column("key").take(pa.array(of, pa.int64()))
        return pa.record_batch({"key": keys, **{n: pa.array(v, pa.int64()) for n, v in zip("seoat", (s, e, o, a, t))}})

    return docs.select("key", "text").mapInArrow(per_batch(cut), "key binary, s long, e long, o long, a long, t long")


def _with_bytes(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes of each wanted stretch, cut from one text that has it."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("s", "e", "o", "a", "t", "c", "k")).alias("cuts"))
    both = docs.join(written(lists, "dedup-cuts").where("size(cuts) > 0"), "key").select("key", "text", "cuts")
    names = ["s", "e", "o", "a", "t", "c", "k"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ["key", "part", *names]}
            for key, text, cuts in zip(batch.column("key").to_pylist(), texts_of(batch.column("text")), batch.column("cuts").to_pylist()):
                for x in cuts:
                    out["key"].append(key)
                    out["part"].append(text[x["s"] : x["e"] + span])
                    for n in names:
                        out[n].append(x[n])
            kinds = {"key": pa.binary(), "part": pa.binary()}
            yield pa.record_batch({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})

    rows = both.mapInArrow(cut, "key binary, part binary, " + ", ".join(f"{n} long" for n in names))
    return rows.dropDuplicates(["a", "t", "o"])  # copies of a text give the same stretch


def _refine(span: int, limit: int = 1 << 20):
    """Stream sorted by bucket: whole buckets, some megabytes at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], span)
        out = [(r[3], r[4] + x, r[4] + y + span) for r, f in zip(rows, flags) if r[5] == 1 for x, y in runs(f)]
        return pa.record_batch(
            {"key": pa.array([x[0] for x in out], pa.binary()), "x": pa.array([x[1] for x in out], pa.int64()), "y": pa.array([x[2] for x in out], pa.int64())}
        )

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("a", "o", "part", "key", "s", "c"))):
                if size > limit and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield solve(rows)

    return refine


def _counted_windows(large: DataFrame, span: int) -> DataFrame:
    """Windows of very large buckets, counted by digest."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, o, part, key, s, c in zip(*(batch.column(n).to_pylist() for n in ("a", "o", "part", "key", "s", "c"))):
                n = len(part) - span + 1
                yield pa.record_batch(
                    {
                        "key": pa.array([key] * n, pa.binary()), "x": pa.array(range(s, s + n), pa.int64()),
                        "digest": pa.array([xxhash.xxh3_128_digest(part[i : i + span], seed=abs(a)) for i in range(n)], pa.binary()),
                        "c": pa.array([c] * n, pa.int64()),
                    }
                )

    rows = written(large.select("a", "o", "part", "key", "s", "c").mapInArrow(digests, "key binary, x long, digest binary, c long"), "dedup-windows")
    twice = rows.groupBy("digest").agg(F.sum("c").alias("n")).where("n > 1").select("digest")
    return rows.where("c = 1").join(twice, "digest").select("key", "x", (F.col("x") + span).alias("y"))


def repeated_spans(docs: DataFrame, span: int = SPAN, chunk: int = CHUNK) -> DataFrame:
    """(key, spans) of texts with repeated windows; spans may overlap. ``docs`` has key and text."""
    rows = written(_bucket_rows(docs, span), "dedup-stretches")
    shared = rows.groupBy("a").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("n > 1")
    shared = written(rows.join(shared.select("a", (F.col("lo") == F.col("hi")).alias("alike")), "a"), "dedup-shared")
    alike = shared.where("alike").select("key", "s", "e")
    mixed = shared.where("NOT alike")
    kinds = mixed.groupBy("a", "t").agg(F.count("*").alias("c"), F.min(F.struct("key", "s", "e", "o")).alias("r"))
    kinds = written(kinds.select("a", "t", "c", "r.*"), "dedup-kinds")
    sizes = kinds.groupBy("a").agg(F.count("*").alias("k"))
    twice = mixed.join(kinds.where("c > 1").select("a", "t"), ["a", "t"]).select("key", "s", "e")
    parts = written(_with_bytes(docs, kinds.join(sizes, "a"), span), "dedup-parts")
    small = parts.where(F.col("k") <= chunk).select("a", "o", "part", "key", "s", "c")
    found = small.repartition("a").sortWithinPartitions("a").mapInArrow(_refine(span), "key binary, x long, y long")
    found = found.union(_counted_windows(parts.where(F.col("k") > chunk), span))
    whole = alike.union(twice).select("key", F.col("s").alias("x"), (F.col("e") + span).alias("y"))
    return whole.union(found).groupBy("key").agg(F.collect_set(F.struct("x", "y")).alias("spans"))


def deduplicated(docs: DataFrame, span: int = SPAN, chunk: int = CHUNK, text: str = "text") -> DataFrame:
    """row (the whole record), kept (binary), cut_text, n_bytes, removed (merged spans), n_removed, kept_sha256.

    ``cut_text`` is ``kept`` without characters of which a part was removed; null where nothing was.
    """
    prepare(docs.sparkSession)
    keyed = docs.select(text_key(docs[text]).alias("key"), docs[text].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    spans = written(repeated_spans(keyed.select("key", "text"), span, chunk), "dedup-spans")
    both = keyed.join(spans, "key", "left").select("row", "text", "spans")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data, found in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist()):
            gone = merged([(x["x"], x["y"]) for x in found or []])
            edges = [0, *(p for g in gone for p in g), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((kept, kept.decode("utf-8", "ignore") if gone else None, len(data), [{"start": a, "end": b} for a, b in gone], len(data) - len(kept), hashlib.sha256(kept).hexdigest()))
        names = [("kept", pa.binary()), ("cut_text", pa.string()), ("n_bytes", pa.int64()), ("removed", SPANS), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
        new = {n: pa.array(v, t) for (n, t), v in zip(names, zip(*out))}
        return pa.RecordBatch.from_arrays([batch.column("row"), *new.values()], names=["row", *new])

    row = both.schema["row"].dataType.simpleString()
    return both.mapInArrow(
        per_batch(cut),
        f"row {row}, kept binary, cut_text string, n_bytes long, removed array<struct<start:long,end:long>>, n_removed long, kept_sha256 string",
    )


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows with the repeated bytes cut out of their texts (characters cut in two go wholly).

    Rows whose text was all repeats go; texts that were empty before stay. ``n_chars``, where there is
    such a column, is counted anew.
    """
    out = deduplicated(docs, span).where("n_removed < n_bytes OR n_bytes = 0")
    text = F.coalesce("cut_text", "row.text")
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length(text))
    return out.select(*[(columns[c] if c in columns else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
