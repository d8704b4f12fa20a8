"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's fingerprint has a bit where more than half of its shingles' hashes have it. Two fingerprints
link when they differ in at most ``radius`` bits. Every different fingerprint emits the variants within
half the radius of it, rounded down if its number of ones is even and up if it is odd: fingerprints at
an odd distance have different parities, so each pair within the radius has a variant in common. Of
three different bits two lie in the same half of the word, so of the variants with two changed bits
those with both in one half are enough (992 of 2016).

Variants are shuffled by cells. For each half there is a view of the variants in which cells are made of
the other half and four more bits: two-bit changes of the half leave most variants in a few cells, so a
fingerprint is sent once to each of its cells (64 rows on average) and its variants (some 600) are made
behind the exchange. A variant is in one cell of a view, so all who emit it there meet.

A variant has at most 1 + 64 + 992 fingerprints that emit it, whatever the table. All of them that are
within the radius of each other by way of the variant are linked to the smallest of the nearest ones:
a bucket gives one link a member, never a pair for two of them. Each link is verified by its bits.

Copies are one fingerprint until the last join, which adaptive execution splits where a fingerprint is
hot.

Cases: a null or empty text, or one without words, has the fingerprint zero and is linked like any
other; a text with fewer words than a shingle is one shingle; a bit set in exactly half the hashes is
zero; repeated rows are returned each; a null id is never a component's smallest and its row has the
component of its fingerprint; very long texts are hashed in slices; only id and text are read, so no
other column can clash; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .base import per_batch, prepare, texts_of
from .components import components

WORDS = 3
RADIUS = 3
SEED = 42
BITS = 64
SLICE = 1 << 16  # hashes whose bits are counted at once


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    parts = text.lower().split()  # both touch ASCII only
    if not parts:
        return np.empty(0, np.uint64)
    n = max(1, len(parts) - words + 1)
    joined = map(b" ".join, zip(*(parts[k:] for k in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as a signed number."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), SLICE):
        part = hashes[i : i + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (signed 64-bit) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(shingle_hashes(t, words)) for t in texts_of(batch.column("text"))]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fps, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(per_batch(describe), f"doc_id {kind}, fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


LOW, HIGH = (1 << 32) - 1, ((1 << 32) - 1) << 32
# of each view: the half in which two bits change, and the bits that make a cell
VIEWS = {"low": (LOW, HIGH | 0xF), "high": (HIGH, LOW | 0xF << 60)}


def changes(view: str, flips: int, radius: int) -> dict[int, list[int]]:
    """What fingerprints that change up to ``flips`` bits emit in a view: change of the cell → changes of the variant."""
    half, cell = VIEWS[view]
    one = [1 << i for i in range(BITS)]
    inside = [x for x in one if x & half]
    found = []
    if view == "low":  # every pair within two bits meets here
        found += [0, *(one if flips > 0 else [])]
    elif radius == 3 and flips == 1:  # those who meet the two-bit changes of the high half
        found += one
    if flips > 1:
        found += [a | b for i, a in enumerate(inside) for b in inside[i + 1 :]]
    cells: dict[int, list[int]] = {}
    for change in found:
        cells.setdefault(signed(change & cell), []).append(signed(change))
    return cells


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def emissions(fps: DataFrame, radius: int) -> DataFrame:
    """fp, variant, cell: dealt out by cell."""
    down, up = radius // 2, radius - radius // 2
    odd = F.bit_count("fp") % 2 == 1
    kinds = [(view, many, changes(view, up if many else down, radius)) for view in VIEWS for many in (False, True)]
    kinds = [(view, many, cells) for view, many, cells in kinds if cells]
    to = F.concat(*[
        F.when(odd == many, F.transform(F.lit(list(cells)), _sent(VIEWS[view][1], i))).otherwise(F.array().cast("array<struct<cell:bigint,step:bigint,kind:int>>"))
        for i, (view, many, cells) in enumerate(kinds)
    ])
    sent = fps.select("fp", F.inline(to)).repartition("cell")
    made = F.lit(None).cast("array<bigint>")
    for i, (_, _, cells) in reversed(list(enumerate(kinds))):
        table = F.create_map(*[x for step, found in cells.items() for x in (F.lit(step), F.lit(found))])
        made = F.when(F.col("kind") == i, F.element_at(table, F.col("step"))).otherwise(made)
    return sent.select("fp", "cell", F.explode(made).alias("change")).select(
        "fp", "cell", F.col("fp").bitwiseXOR(F.col("change")).alias("variant")
    )


def _sent(cell: int, kind: int):
    return lambda step: F.struct(
        F.col("fp").bitwiseAND(F.lit(signed(cell))).bitwiseXOR(step).alias("cell"), step.alias("step"), F.lit(kind).alias("kind")
    )


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between different fingerprints ``fp`` that give the components of all pairs within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError(f"a radius of {radius} bits: variants are made for 0 to 3")
    near = F.when(distance(F.col("variant"), F.col("fp")) <= radius // 2, F.col("fp"))
    bucket = emissions(fps, radius).withColumn("u", F.min(near).over(Window.partitionBy("cell", "variant")))
    met = bucket.where("u <> fp").select("u", F.col("fp").alias("v"))
    return met.where(distance(F.col("u"), F.col("v")) <= radius).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest id reachable by links)."""
    prepare(docs.sparkSession)
    rows = written(fingerprints(docs.select(docs["doc_id"], docs["text"]), words), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    label = components(written(ball_links(classes.select("fp"), radius), "simhash-links"))
    named = classes.join(label, classes["fp"] == label["node"], "left")
    named = named.select("fp", "least", F.coalesce("label", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(smallest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
