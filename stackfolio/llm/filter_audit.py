"""Filter interaction audit: what each filter removes in every order, by forward-backward path counting.

A document fails a set of the filters, and only that set matters: documents are counted per part and
set, and everything else is read off these at most 2**k counts. The states of the lattice are the sets
of filters applied so far; an edge applies one more. The documents that an edge removes fail its filter
and none of its state. An order is a path through the lattice: the number of orders through an edge is
the number of paths that reach its state (counted forward) times the number that leave its end (counted
backward), and an edge's removals with this weight, summed over the edges of a filter, are its Shapley
sum over all k! orders. The steps of an order are read from the same edges.

Cases: a null text is empty; a null part is the empty string; equal texts share their smallest id, and
rows that repeat it are all first; a row without an id is never called a copy and has no labels; labels
that repeat an id count as set if any of them is; a part without failures has all its rows with zeros;
texts of any length are read whole; columns of ``docs`` other than those named are not read, so they
cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .base import prepare

BLANKS = r"[\x20\x09-\x0D]+"
COUNTS = ["n", "good", "toxic"]
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failures(text: Column) -> dict[str, Column]:
    """Conditions of the filters that a text fails by itself."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def described(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_key (of equal texts) and failed (a bit for each filter that reads the text alone)."""
    text = F.coalesce(docs["text"], F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(F.col("text")).values())]
    rows = docs.select(docs["doc_id"], F.coalesce(docs["source"], F.lit("")).alias("part"), text.alias("text"))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), sum(bits).cast("int").alias("failed"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (set of A to E as bits), n, good, toxic: the documents of each part and set."""
    prepare(docs.sparkSession)
    rows = written(described(docs), "audit-rows")
    # the copies of a text are no hot key: its smallest id is a partial aggregate, joined back by (text, id)
    first = rows.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    copy = F.when(F.col("first").isNull(), 1 << len("ABCD")).otherwise(0)
    known = rows.where("doc_id IS NOT NULL").join(first, ["text_key", "doc_id"], "left").join(flags, "doc_id", "left")
    known = known.select("part", (F.col("failed") + copy).alias("failed"), "good", "toxic")
    nameless = rows.where("doc_id IS NULL").select("part", "failed", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return known.union(nameless).groupBy("part", "failed").agg(F.count("*").alias("n"), some("good"), some("toxic"))


class Lattice:
    """States (sets of filters as bits), edges (state, filter) and the number of orders through each."""

    def __init__(self, k: int):
        self.k, self.states = k, 1 << k
        self.edges = [(s, f) for s in range(self.states) for f in range(k) if not s >> f & 1]
        self.edge_at = {e: i for i, e in enumerate(self.edges)}
        reaching, leaving = [0] * self.states, [0] * self.states
        reaching[0] = leaving[-1] = 1
        for s, f in self.edges:  # an edge leads to a larger number, so states come in a right order
            reaching[s | 1 << f] += reaching[s]
        for s, f in reversed(self.edges):
            leaving[s] += leaving[s | 1 << f]
        self.orders = [reaching[s] * leaving[s | 1 << f] for s, f in self.edges]

    def removed(self, counts: np.ndarray) -> list[int]:
        """Documents that each edge removes, from the count of documents of each failed set."""
        return [sum(int(n) for m, n in enumerate(counts) if m >> f & 1 and not m & s) for s, f in self.edges]

    def kept(self, counts: np.ndarray) -> list[int]:
        """Documents that are left in each state."""
        return [sum(int(n) for m, n in enumerate(counts) if not m & s) for s in range(self.states)]

    def shapley(self, removed: list[int]) -> list[int]:
        """Removals of each filter summed over all orders."""
        sums = [0] * self.k
        for (_, f), n, orders in zip(self.edges, removed, self.orders):
            sums[f] += n * orders
        return sums

    def paths(self, orders: Iterable[tuple[int, ...]]):
        """(order, step, edge, state after it) of each step of each order."""
        for order in orders:
            state = 0
            for step, f in enumerate(order, 1):
                edge = self.edge_at[state, f]
                state |= 1 << f
                yield order, step, edge, state


def audited(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from ``failure_counts``.

    A part has at most 2**k rows, so a part is one small group; the k! orders are what is asked for.
    """

    def audit(key: tuple, rows: pa.Table) -> pa.Table:
        lattice = Lattice(len(filters))
        sets = rows.column("failed").to_numpy()
        table = {}
        for name in COUNTS:
            table[name] = np.zeros(lattice.states, np.int64)
            np.add.at(table[name], sets, rows.column(name).to_numpy())
        failing = [sum(int(n) for m, n in enumerate(table["n"]) if m >> f & 1) for f in range(lattice.k)]
        removed = {name: lattice.removed(table[name]) for name in COUNTS}
        kept, shapley = lattice.kept(table["n"]), lattice.shapley(removed["n"])
        out = []
        for order, step, edge, state in lattice.paths(permutations(range(lattice.k))):
            f = lattice.edges[edge][1]
            gone = removed["n"][edge]
            out.append((
                key[0].as_py(), "".join(filters[g] for g in order), step, kept[state], gone, failing[f] - gone,
                int(table["n"][1 << f]), removed["good"][edge], removed["toxic"][edge], shapley[f],
            ))
        names = [c.split()[0] for c in STEPS.split(", ")]
        types = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return counts.groupBy("part").applyInArrow(audit, STEPS)
