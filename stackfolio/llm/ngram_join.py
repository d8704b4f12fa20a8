"""N-gram Jaccard join: a grouped prefix join.

Shingles are ordered by a global order, rare ones first. Documents whose sets are equal are one class;
classes with the same size and the same prefix are one group. Two sets of similarity t share a shingle
among the first n - ceil(t n) + 1 of each, so groups are joined on the shingles of their prefixes,
pruned by size and position, expanded to classes, and each pair is verified on its texts.

The order is (frequency class, hash). Frequencies over all documents are counted in a sketch of
``2 ** SKETCH_BITS`` counters, the only thing broadcast and of a fixed size; the result does not depend
on it, any order is exact. A shingle whose counter is in the lowest class has few documents, which
bounds its block; the others are never gathered by key but only joined.

A block of m groups has m² pairs; they are not made. First each member is verified against the
member with the earliest position of the shingle (of each of a few slices of the block), which joins
most copies into components, and then only pairs of different components that pass the filters are
made. A pair inside a component could not change it.

Cases: a null or empty text, or one without words, has an empty set and is alone; a text with fewer
words than a shingle is one shingle; ties of the order go by hash; repeated rows and copies are one
class and each row is returned; a null id stays null and its row has the component of its class;
only id and text are read, so no other column can clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .base import per_batch, prepare, texts_of
from .components import components

WORDS = 5
PERCENT = 80
SKETCH_BITS = 22
SLICES = 256
LEADERS = 2
TOKEN_BITS = 48  # of a shingle's hash in the candidate search; verification uses all 64

# odd multipliers of the words of a shingle and of the final mix
MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64
)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    parts = text.lower().split()  # both touch ASCII only
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    s = h[:n] * MIX[0]
    for k in range(1, words):
        s += h[k : n + k] * MIX[k % len(MIX)] + np.uint64(k // len(MIX))
    s ^= s >> np.uint64(32)
    s *= MIX[0]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def class_of(s: np.ndarray) -> bytes:
    """Name of the class of equal sets."""
    return xxhash.xxh3_128_digest(s.tobytes())


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def frequency_classes(docs: DataFrame, words: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Frequency class of each counter: 0 up to what chance puts there, then two a doubling."""
    width = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        rows = 0
        for batch in batches:
            for text in texts_of(batch.column("text")):
                np.add.at(counts, (shingles(text, words) >> np.uint64(64 - bits)).astype(np.int64), 1)
                rows += 1
        if rows:
            press = zstandard.ZstdCompressor(level=1)
            parts = [press.compress(counts[i * width : (i + 1) * width].astype("<u4").tobytes()) for i in range(SLICES)]
            yield pa.record_batch({"slice": pa.array(range(SLICES), pa.int32()), "part": pa.array(parts, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(open_.decompress(part), "<u4").astype(np.int64)
                sums[i] = sums[i] + counts if i in sums else counts
        if sums:
            logs = [np.round(8 * np.log2(1 + v)).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.record_batch(
                {"slice": pa.array(sums, pa.int32()), "logs": pa.array(logs, pa.binary()), "total": pa.array([int(v.sum()) for v in sums.values()], pa.int64())}
            )

    parts = docs.select("text").mapInArrow(count, "slice int, part binary")
    rows = parts.repartition(SLICES, "slice").mapInArrow(add, "slice int, logs binary, total long").collect()
    logs = np.zeros((SLICES, width), np.uint8)
    for r in rows:
        logs[r["slice"]] = np.frombuffer(r["logs"], np.uint8)
    mean = sum(r["total"] for r in rows) / (1 << bits)
    counts = np.exp2(logs.ravel() / 8) - 1
    usual = mean + 6 * np.sqrt(mean) + 8
    return np.where(counts <= usual, 0, 1 + 2 * np.log2(np.maximum(counts, 1) / usual)).astype(np.uint8)


def described(docs: DataFrame, words: int, percent: int, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, text_key, n, cls (hash of the set), gid (hash of size and prefix), prefix, heavy (by token)."""
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, words, bits).tobytes())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = np.frombuffer(classes.value, np.uint8)
        ns, cls, gids, prefixes, heavy, ends = [], [], [], [], [], [0]
        for text in texts_of(batch.column("text")):
            s = shingles(text, words)
            n = len(s)
            level = order[(s >> np.uint64(64 - bits)).astype(np.int64)]
            first = np.lexsort((s, level))[: n - -(-percent * n // 100) + 1 if n else 0]
            prefix = (s[first] >> np.uint64(64 - TOKEN_BITS)).astype(np.int64)
            ns.append(n)
            cls.append(class_of(s))
            gids.append(np.uint64(xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n)).astype(np.int64))
            prefixes.append(prefix)
            heavy.append(level[first] > 0)
            ends.append(ends[-1] + len(prefix))
        lists = lambda v, t: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(v), t))
        return pa.record_batch(
            {
                "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n": pa.array(ns, pa.int32()),
                "cls": pa.array(cls, pa.binary()), "gid": pa.array(gids, pa.int64()),
                "prefix": lists(prefixes, pa.int64()), "heavy": lists(heavy, pa.bool_()),
            }
        )

    schema = f"doc_id {kind}, text_key long, n int, cls binary, gid long, prefix array<long>, heavy array<boolean>"
    return docs.mapInArrow(per_batch(describe), schema)


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """gid, n, token, pos: the prefix shingles that another group may have as well."""
    zipped = F.posexplode(F.arrays_zip("prefix", "heavy")).alias("pos", "item")
    posts = rows.where("n > 0").select("gid", "n", zipped).select("gid", "n", "pos", "item.prefix", "item.heavy")
    posts = posts.withColumnRenamed("prefix", "token")
    # light shingles have few documents, by their counter: their window is small
    block = Window.partitionBy("token")
    light = posts.where("NOT heavy").select("token", "gid", "n", "pos")
    light = light.withColumn("lo", F.min("gid").over(block)).withColumn("hi", F.max("gid").over(block)).where("lo <> hi")
    names = ["token", "gid", "n", "pos"]
    return light.select(names).distinct().union(posts.where("heavy").select(names).distinct())


def possible(a: str, b: str, percent: int):
    """Size and position filter for the first common shingle of two ordered sets.

    100 o >= percent (n + m - o) for an overlap o of at most min(n - i, m - j).
    """
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return F.lit(100 + percent) * most >= F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (u, v) of classes that are similar enough; ``v`` should be the more frequent side."""
    both = (
        pairs.join(texts.select(F.col("cls").alias("u"), F.col("text").alias("u_text")), "u")
        .join(texts.select(F.col("cls").alias("v"), F.col("text").alias("v_text")), "v")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        whole = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            good = []
            for i, (v, x, y) in enumerate(zip(batch.column("v").to_pylist(), texts_of(batch.column("u_text")), texts_of(batch.column("v_text")))):
                if v != last:
                    last, kept = v, shingles(whole(y), words)
                if similar(shingles(whole(x), words), kept, percent):
                    good.append(i)
            yield batch.select(["u", "v"]).take(pa.array(good, pa.int64()))

    return both.select("u", "v", "u_text", "v_text").mapInArrow(check, "u binary, v binary")


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, cls, component (hash), component_id."""
    prepare(docs.sparkSession)
    docs = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("text_key"))
    rows = written(described(docs, words, percent), "ngram-rows")
    posts = written(shared_prefixes(rows), "ngram-prefixes")
    groups = posts.select("gid", "n").union(several_classes(rows)).distinct()
    members = rows.where("n > 0").select("gid", "n", "cls").distinct().join(groups, ["gid", "n"], "left_semi")
    members = written(members, "ngram-members")
    texts = written(class_texts(docs, members, words), "ngram-texts")

    # every member against the leaders of its blocks, and the classes of a group against one of them
    first = members.groupBy("gid", "n").agg(F.min("cls").alias("first"))
    slot = F.pmod(F.xxhash64("gid"), F.lit(LEADERS)).alias("slot")
    leaders = posts.groupBy("token", slot).agg(F.min(F.struct("pos", "n", "gid")).alias("l")).select("token", "l.*")
    near = posts.alias("x").join(
        leaders.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") != F.col("y.gid")) & possible("x", "y", percent)
    )
    near = near.select(F.col("x.gid").alias("gx"), F.col("x.n").alias("nx"), F.col("y.gid").alias("gy"), F.col("y.n").alias("ny")).distinct()
    star = (
        near.join(first.toDF("gx", "nx", "u"), ["gx", "nx"]).join(first.toDF("gy", "ny", "v"), ["gy", "ny"]).select("u", "v")
        .union(members.join(first, ["gid", "n"]).where("cls <> first").select(F.col("cls").alias("u"), F.col("first").alias("v")))
    )
    edges = written(verified(star.distinct(), texts, words, percent), "ngram-star")
    joined = components(edges)

    # what is left: pairs of groups that are not in one component altogether
    placed = members.join(joined, members["cls"] == joined["node"], "left").select(
        "gid", "n", "cls", F.coalesce("label", "cls").alias("label")
    )
    placed = written(placed, "ngram-placed")
    whole = placed.groupBy("gid", "n").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"))
    whole = whole.select("gid", "n", "lo", "hi", "m")
    sides = posts.join(whole, ["gid", "n"])
    apart = ~((F.col("x.lo") == F.col("x.hi")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("y.lo") == F.col("y.hi")))
    far = sides.alias("x").join(
        sides.alias("y"),
        (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid")) & apart & possible("x", "y", percent),
    )
    far = far.select(F.col("x.gid").alias("gx"), F.col("x.n").alias("nx"), F.col("y.gid").alias("gy"), F.col("y.n").alias("ny")).distinct()
    inside = whole.where("lo <> hi").select(F.col("gid").alias("gx"), F.col("n").alias("nx"), F.col("gid").alias("gy"), F.col("n").alias("ny"))
    pairs = (
        far.union(inside)
        .join(placed.toDF("gx", "nx", "u", "lu"), ["gx", "nx"])
        .join(placed.toDF("gy", "ny", "v", "lv"), ["gy", "ny"])
        .where("lu <> lv AND (gx <> gy OR u < v)").select("u", "v")
    )
    rest = verified(pairs.distinct(), texts, words, percent)
    label = components(edges.union(rest))
    classes = rows.groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = classes.join(label, classes["cls"] == label["node"], "left").select("cls", "least", F.coalesce("label", "cls").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    found = rows.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "cls")
    found = found.join(named.select("cls", "component", "component_id"), "cls")
    alone = F.col("n_shingles") == 0
    return found.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))


def several_classes(rows: DataFrame) -> DataFrame:
    """Groups with more than one class."""
    return rows.where("n > 0").groupBy("gid", "n").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("gid", "n")


def class_texts(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(cls, text) of some document of each class that may have a link; the sets of a class are equal.

    Texts are read again rather than joined to their class, so that each is dealt out once, compressed,
    and copies within a task not at all.
    """

    def press(batch: pa.RecordBatch) -> pa.RecordBatch:
        small = zstandard.ZstdCompressor(level=3)
        texts = texts_of(batch.column("text"))
        names = pa.array([class_of(shingles(t, words)) for t in texts], pa.binary())
        return pa.record_batch({"cls": names, "text": pa.array([small.compress(t) for t in texts], pa.binary())})

    pressed = docs.select("text").mapInArrow(per_batch(press), "cls binary, text binary")
    return pressed.dropDuplicates(["cls"]).join(members.select("cls"), "cls", "left_semi")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: the least (id, text hash) stays.

    Rows with an empty set all stay. Of rows equal in id and text that would stay, one does.
    """
    spark = docs.sparkSession
    found = written(linked(docs, words, percent), "ngram-linked")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    best = found.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("b")).select("b.doc_id", "b.text_key")
    best = best.toDF("best_id", "best_key")
    prepare(spark)
    whole = docs.select(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    alone = found.where("n_shingles = 0").select(F.col("doc_id").alias("best_id"), F.col("text_key").alias("best_key")).distinct()
    match = lambda t: (F.col("key") == t["best_key"]) & F.col("id").eqNullSafe(t["best_id"])
    kept = whole.join(best, match(best), "left_semi").dropDuplicates(["id", "key"])
    empty = whole.join(alone, match(alone), "left_semi")
    return kept.unionByName(empty).select(*[F.col(f"row.`{c}`") for c in docs.columns])
