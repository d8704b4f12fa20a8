"""Exact top-k search: inverted index with block-max WAND for BM25.

Rows are dealt into shards of about ``SHARD_ROWS``. A task indexes one shard: postings by term, in
blocks of ``BLOCK`` neighbouring rows with the largest contribution of the term in each block. A query
takes its terms rare first. The rows best by the rarest give a threshold; the pivot is the term after
which the bounds of all terms together stay below it, so a row without a term before the pivot is
never looked at; the rows best by all terms up to the pivot raise the threshold, and a row is skipped
if its sum so far and the bounds of its block stay below it; what is left is scored whole. This is
WAND's test, made for all rows of a list at a time. Lists after the pivot are not gone through: the
rows left look their contributions up, which frequent terms also have by row.
Term weights and the mean length come from all rows, so scores of different shards compare and the
best k of each shard's best k are the exact answer.

Queries meet shards block by block: a group is one shard and at most about ``QUERY_ROWS`` queries.

Cases: a null or empty text has no terms: as a query it finds nothing, as a row it is never found; a
query finds itself if it is among the rows; scores are rounded to six decimals, so that equal texts
tie, and ties go by id (nulls first); repeated rows are found each; only the id columns and the text
are read, so other columns cannot clash; an empty side gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .base import per_batch, prepare, texts_of, with_columns
from .licenses import WORD_BYTES

K1, B = 1.2, 0.75
BLOCK = 64
SHARD_ROWS = 32768
QUERY_ROWS = 16384
FEW = 8  # so many rows for each one wanted are scored at once
MORE = 8  # terms that are looked up together
TINY = 1e-300  # no contribution is smaller
FREQUENT = 256  # so many terms of a shard also have their contributions by row
DIGITS = 6


def terms(text: bytes) -> list[bytes]:
    """Lower-case (ASCII) runs of letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


class Index:
    """One shard. Contributions are tf parts of BM25; a query brings the weights of its terms."""

    def __init__(self, texts: list[bytes], mean: float):
        words = [terms(text) for text in texts]
        numbers = {t: i for i, t in enumerate(dict.fromkeys(w for found in words for w in found))}
        length = np.array([len(w) for w in words], np.float64)
        term = np.fromiter((numbers[w] for found in words for w in found), np.int64, int(length.sum()))
        key, f = np.unique(term * len(texts) + np.repeat(np.arange(len(texts)), length.astype(np.int64)), return_counts=True)
        t, self.row, f = key // max(1, len(texts)), key % max(1, len(texts)), f.astype(np.float64)
        self.part = f * (K1 + 1) / (f + K1 * (1 - B + B * length[self.row] / mean)) if len(f) else f
        self.terms, self.rows = pa.array(list(numbers), pa.binary()), len(texts)
        # blocks of a term's postings: block number, largest contribution
        by_row = np.argsort(self.row, kind="stable")
        self.row_term, self.row_part = t[by_row], self.part[by_row]
        self.row_start = np.searchsorted(self.row[by_row], np.arange(len(texts) + 1))
        self.weight, self.last = np.zeros(len(numbers)), np.zeros(len(texts), np.int64)
        key = t * (len(texts) // BLOCK + 1) + self.row // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.block = self.row[first] // BLOCK
        self.most = np.maximum.reduceat(self.part, first) if len(key) else self.part
        self.of_term = np.searchsorted(t[first], np.arange(len(numbers) + 1))
        self.start = np.searchsorted(t, np.arange(len(numbers) + 1))
        self.top = np.maximum.reduceat(self.most, self.of_term[:-1]) if len(key) else self.most
        # frequent terms: number among them (else -1), contributions by row
        frequent = np.zeros(len(numbers), bool)
        frequent[np.argsort(-np.diff(self.start), kind="stable")[:FREQUENT]] = True
        self.place = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.by_row = np.zeros((int(frequent.sum()), len(texts)))
        self.by_row[self.place[t[frequent[t]]], self.row[frequent[t]]] = self.part[frequent[t]]

    def known(self, queries: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query, the terms that the shard has and their weights, rare terms first."""
        flat = pc.list_flatten(queries)
        names = pc.fill_null(pc.index_in(flat.field("term"), self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        weights = flat.field("weight").to_numpy(zero_copy_only=False)
        query = pc.list_parent_indices(queries).to_numpy(zero_copy_only=False)
        order = np.lexsort((names, -weights, query))
        order = order[names[order] >= 0]
        names, weights = names[order], weights[order]
        cuts = np.searchsorted(query[order], np.arange(len(queries) + 1)).tolist()
        return [(names[a:b], weights[a:b]) for a, b in zip(cuts, cuts[1:])]

    def lists(self, names: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and contributions of whole posting lists."""
        spans = list(zip(self.start[names].tolist(), self.start[names + 1].tolist()))
        values = np.concatenate([self.part[a:b] for a, b in spans])
        values *= np.repeat(weights, [b - a for a, b in spans])
        return np.concatenate([self.row[a:b] for a, b in spans]), values

    def of(self, names: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Contributions of some terms to some rows, which are in order."""
        place = self.place[names]
        sums = weights[place >= 0] @ self.by_row[place[place >= 0][:, None], rows]
        for n, w in zip(names[place < 0].tolist(), weights[place < 0].tolist()):
            a, b = self.start[n], self.start[n + 1]
            at = np.minimum(np.searchsorted(self.row[a:b], rows), b - a - 1) + a
            sums += w * self.part[at] * (self.row[at] == rows)
        return sums

    def bounds(self, names: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """By block, the sum of the largest contributions of some terms."""
        if not len(names):
            return np.zeros(self.rows // BLOCK + 1)
        spans = list(zip(self.of_term[names].tolist(), self.of_term[names + 1].tolist()))
        blocks = np.concatenate([self.block[a:b] for a, b in spans])
        values = np.concatenate([self.most[a:b] for a, b in spans])
        return np.bincount(blocks, values * np.repeat(weights, [b - a for a, b in spans]), self.rows // BLOCK + 1)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """Whole scores of some rows, from the terms of each and the weights of the query."""
        start = self.row_start[rows]
        size = self.row_start[rows + 1] - start
        ends = np.cumsum(size)
        at = np.repeat(start - ends + size, size) + np.arange(ends[-1])
        values = self.weight[self.row_term[at]] * self.row_part[at]
        return np.round(np.bincount(np.repeat(np.arange(len(rows)), size), values, len(rows)), DIGITS)

    def reached(self, rows: np.ndarray, sums: np.ndarray, k: int) -> float:
        """A score that k rows reach, seen on those with the largest sums."""
        if len(rows) < k:
            return 0.0
        if len(rows) > 2 * k:
            rows = rows[np.argpartition(sums, len(sums) - 2 * k)[len(sums) - 2 * k :]]
        return float(np.partition(self.exact(rows), len(rows) - k)[len(rows) - k])

    def best(self, names: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the best k, and all that tie with the last of them, for terms and weights, rare first."""
        if not len(names):
            return np.empty(0, np.int64), np.empty(0)
        total, bound = np.cumsum(self.start[names + 1] - self.start[names]), weights * self.top[names]
        self.weight[names] = weights
        # a first threshold: rows that are best by the rare terms, scored whole
        rare = min(int(np.searchsorted(total, 8 * k + self.rows // 16, side="right")) + 1, len(names))
        rows, values = self.lists(names[:rare], weights[:rare])
        partial = np.bincount(rows, values, self.rows)
        number = np.arange(len(rows))  # a row is there for each of its terms; the last one stays
        self.last[rows] = number
        rows = rows[self.last[rows] == number]
        least = self.reached(rows, partial[rows], k)
        slack = 10.0**-DIGITS
        # pivot term: the bounds of the terms after it do not reach the threshold, a row needs one before it
        below = np.flatnonzero(np.append(np.cumsum(bound[:0:-1])[::-1], 0.0) < least - slack)
        pivot = int(below[0]) + 1 if len(below) else len(names)
        if pivot < rare:
            partial = np.bincount(*self.lists(names[:pivot], weights[:pivot]), self.rows)
        elif pivot > rare:
            partial += np.bincount(*self.lists(names[rare:pivot], weights[rare:pivot]), self.rows)
        # block bounds of the rest: a row whose sum with that of its block stays below is skipped
        rest = self.bounds(names[pivot:], weights[pivot:])
        found = np.flatnonzero(partial >= max(least - slack - rest.max(), TINY))
        # a second threshold: rows that are best by all terms up to the pivot
        sums = partial[found]
        least = max(least, self.reached(found, sums, k))
        keep = sums + rest[found // BLOCK] >= least - slack
        found, sums = found[keep], sums[keep]
        # still many: some more terms for them alone, whose bounds are then known sums
        while len(found) > FEW * k and pivot < len(names):
            sums += self.of(names[pivot : pivot + MORE], weights[pivot : pivot + MORE], found)
            pivot += MORE
            keep = sums + self.bounds(names[pivot:], weights[pivot:])[found // BLOCK] >= least - slack
            found, sums = found[keep], sums[keep]
        values = self.exact(found) if len(found) else np.empty(0)
        self.weight[names] = 0
        keep = values >= least
        return found[keep], values[keep]


def _search(mean: float, k: int, ids: Sequence[str]):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = [rows.column(f"row_{c}").to_pylist() for c in ids]
        order = sorted(range(rows.num_rows), key=lambda r: tuple((n[r] is not None, n[r]) if n[r] is not None else (False, 0) for n in names))
        rows = rows.take(pa.array(order, pa.int64()))
        index = Index(texts_of(rows.column("text").combine_chunks()), mean)
        at, hit, score = [], [], []
        for q, (names, weights) in enumerate(index.known(queries.column("terms").combine_chunks())):
            r, s = index.best(names, weights, k)
            top = np.lexsort((r, -s))[:k]  # rows lie in the order of their ids
            at += [q] * len(top)
            hit += r[top].tolist()
            score += s[top].tolist()
        q, r = queries.take(pa.array(at, pa.int64())), rows.take(pa.array(hit, pa.int64()))
        out = {"query": q.column("query")} | {f"query_{c}": q.column(f"query_{c}") for c in ids} | {f"row_{c}": r.column(f"row_{c}") for c in ids}
        return pa.table(out | {"score": pa.array(score, pa.float64())})

    return run


def top_k(
    rows: DataFrame, is_query: Column, ids: Sequence[str], text: str = "text", k: int = 10,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Best k rows of each query (the rows where ``is_query`` holds): query_<id>, row_<id>, rank, score."""
    prepare(rows.sparkSession)
    rows = rows.select(*[rows[c] for c in ids], rows[text].alias("text"), F.coalesce(is_query, F.lit(False)).alias("asks"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [terms(t) for t in texts_of(batch.column("text"))]
        new = {"length": pa.array([len(f) for f in found], pa.int64()), "terms": pa.array([sorted(set(f)) for f in found], pa.list_(pa.binary()))}
        return with_columns(batch.select([*ids, "asks"]), new)

    from pyspark.sql import types as T

    schema = T.StructType([f for f in rows.schema if f.name != "text"]).add("length", T.LongType()).add("terms", T.ArrayType(T.BinaryType()))
    counted = written(rows.mapInArrow(per_batch(count), schema), "search-terms")
    total = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.sum(F.col("asks").cast("long")).alias("q")).first()
    n, mean = total["n"], total["mean"] or 1.0
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-(total["q"] or 0) // query_rows))

    # one number for each query row; repeated rows are queries each
    asked = counted.where("asks").select(*ids, "terms", F.monotonically_increasing_id().alias("query"))
    asked = written(asked, "search-queries")
    by_term = asked.select("query", F.explode("terms").alias("term"))
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = (
        by_term.join(frequency, "term").groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("weight")))).alias("terms"))
    )
    names = asked.select("query", *[F.col(c).alias(f"query_{c}") for c in ids])
    asks = weighted.join(names, "query").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    asks = written(asks, "search-weights").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = rows.select(
        *[F.col(c).alias(f"row_{c}") for c in ids], "text",
        F.pmod(F.xxhash64("text", *ids), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType().add("query", T.LongType())
    for side in ("query", "row"):
        for c in ids:
            out = out.add(f"{side}_{c}", kinds[c])
    out = out.add("score", T.DoubleType())
    found = dealt.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(_search(mean, k, ids), out)
    best = Window.partitionBy("query").orderBy(F.desc("score"), *[F.asc_nulls_first(f"row_{c}") for c in ids])
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.drop("query")
