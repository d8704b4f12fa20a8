"""Cross-tokenizer alignment by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the token of the other side that overlaps it
and reaches farthest right; a token of A that ends where a token of B ends points to itself. The
pointers of many texts are doubled together (each takes its target's target) until none moves: then
every token points to the terminal token of its component, which labels its group. That takes as many
rounds as the logarithm of the longest chain.

A text is cut into units at each single blank between two other characters. Neither tokenizer can have
a token across such a cut (A splits there before merging, and B has no piece with a blank after another
character, which is checked when it is loaded), so tokens, groups and links of a text are those of its
units one after another, and each different unit is aligned once.

Links are the pairs of tokens that end together. Each link counts its id pair over all documents: the
units are counted first, in the JVM, then each different unit is aligned and its pairs are added with its
count. Pairs that hold at least one in ``HEAVY`` of all links are at most ``HEAVY``, so their counts are
broadcast; the other pairs of a document are no hot keys and are joined. The highest count of each B id
has a row per entry of B's vocabulary.

Cases: a null or empty text, one that is not valid UTF-8, and one with U+2581, which B turns into a
blank, has tokens whose bytes are not those of blank plus text: it has no tokens, zeros and an empty
digest; ties for the highest count all count; repeated rows count and are returned each; a null id stays
null; a very long text is cut into units like any other, and units without a blank, however long, are
aligned whole and not kept between batches; only id and text are read, so no other column can clash; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import rows_of
from ..session import written
from .base import WordTable, per_batch, prepare, texts_of

HEAVY = 1 << 16
CHUNK = 1 << 12  # characters of units that are encoded as one text
TOGETHER = 1 << 15  # units that are aligned at once
KEPT_UNIT, KEPT_UNITS = 64, 300_000  # characters of a unit, and units of a worker, kept between batches
BLANK = "▁"  # fixed value: the piece model's mark for a blank
WHITE = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + BLANK
CUT = f"(?<=[^{WHITE}]) (?=[^{WHITE}])"
MARGINS = {c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c)}


def byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def has_tokens(text: Column) -> Column:
    return F.coalesce(F.is_valid_utf8(text) & (text != "") & ~text.contains(BLANK), F.lit(False))


def joined(ids: np.ndarray, entries: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The entries of the ids one after another, and where each begins."""
    found = entries.take(pa.array(ids))
    offsets = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    return memoryview(found.buffers()[2] or b"").cast("B"), offsets


class Tokens:
    """Ids and bytes of both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_of_char()
        words = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            a_bytes[i] = bytes(alphabet[c] for c in word) if set(word) <= alphabet.keys() else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("the piece model has pieces that go on after a blank: a text has no units")
        b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (a_bytes, b_bytes))
        digits = [str(i).encode() for i in range(max(len(a_bytes), len(b_bytes)))]
        self.width = len(digits)
        self.marked = pa.array([d + mark for mark in (b",", b"|", b";") for d in digits], pa.binary())

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units by A, how many each has, and the same by B.

        Units that may stand beside others are encoded together and told apart by their bytes.
        """
        texts, size = [], CHUNK
        for unit in units:
            alone = not unit or unit[0] in MARGINS or unit[-1] in MARGINS
            if alone or size >= CHUNK:
                texts.append([unit])
                size = 0
            else:
                texts[-1].append(unit)
            size = CHUNK if alone else size + len(unit) + 1
        whole = [" ".join(t) for t in texts]
        starts = np.frombuffer(pa.array(units, pa.large_string()).buffers()[1], np.int64)[: len(units) + 1]
        ends = starts[1:] + np.arange(1, len(units) + 1)
        text = (" " + " ".join(units)).encode()
        out = []
        for found, sizes, entries in (
            (self.encode_a(whole), self.a_size, self.a_bytes), (self.encode_b(whole), self.b_size, self.b_bytes),
        ):
            ids = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
            if joined(ids, entries)[0] != text:
                raise ValueError("a tokenizer does not give back the bytes of its text")
            out += [ids, np.diff(np.searchsorted(np.cumsum(sizes[ids]), ends, side="right"), prepend=0)]
        return tuple(out)


@cache
def tokens_from(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each token (A's, then B's) the position of its component's last A token.

    Ends are byte offsets, rising, over all texts one after another; both sides end at the same place.
    """
    n = len(a_ends)
    far_a = np.searchsorted(b_ends, a_ends)  # the first B token that ends at this end or behind it
    far_b = np.searchsorted(a_ends, b_ends)
    met = b_ends[far_a] == a_ends
    pointer = np.concatenate([np.where(met, np.arange(n), n + far_a), far_b])
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer
        pointer = further


class Aligned:
    """Alignment of units: tokens, links and groups of each."""

    def __init__(self, tokens: Tokens, units: list[str]):
        self.tokens = tokens
        self.a, self.n_a, self.b, self.n_b = tokens.ids(units)
        a_ends, b_ends = np.cumsum(tokens.a_size[self.a]), np.cumsum(tokens.b_size[self.b])
        label = terminals(a_ends, b_ends)
        self.a_label, self.b_label = label[: len(self.a)], label[len(self.a) :]
        # a link is a terminal A token and the B token that ends there
        link_a = np.flatnonzero(self.a_label == np.arange(len(self.a)))
        self.pair = self.a[link_a] << 32 | self.b[np.searchsorted(b_ends, a_ends[link_a])]
        self.n_links = np.bincount(np.repeat(np.arange(len(units)), self.n_a)[link_a], minlength=len(units))

    def groups(self) -> list[bytes]:
        """The groups of each unit, written ``a1,a2|b1;a3|b2,b3;``."""
        rank = np.concatenate([self.a_label, self.b_label])
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.lexsort((side, rank))  # stable: tokens of a side stay in order
        ids, rank, side = np.concatenate([self.a, self.b])[order], rank[order], side[order]
        mark = np.where(np.append(side[1:] != side[:-1], False) & (side == 0), 1, 0)
        mark[np.append(rank[1:] != rank[:-1], True)] = 2
        data, offsets = joined(ids + mark * self.tokens.width, self.tokens.marked)
        ends = np.cumsum(self.n_a + self.n_b)
        cuts = offsets[np.append(0, ends)].tolist()
        return [bytes(data[s:e]) for s, e in zip(cuts, cuts[1:])]


def unit_counts(docs: DataFrame) -> DataFrame:
    """unit, n: how often each unit stands in texts with tokens."""
    units = rows_of(docs.where(has_tokens(F.col("text"))), [], F.split("text", CUT), "unit")
    return units.groupBy("unit").agg(F.count("*").alias("n"))


def pair_counts(units: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair (a << 32 | b), links: over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(units: list[str], n: list[int]) -> pa.RecordBatch:
            found = Aligned(tokens_from(a_path, b_path), units)
            pair, at = np.unique(found.pair, return_inverse=True)
            links = np.zeros(len(pair), np.int64)
            np.add.at(links, at, np.repeat(n, found.n_links))
            return pa.record_batch({"pair": pa.array(pair, pa.int64()), "links": pa.array(links, pa.int64())})

        units, n, size = [], [], 0
        for batch in batches:
            units += batch.column("unit").to_pylist()
            n += batch.column("n").to_pylist()
            size += batch.nbytes
            if len(units) >= TOGETHER or size >= 1 << 20:
                yield some(units, n)
                units, n, size = [], [], 0
        if units:
            yield some(units, n)

    posts = units.mapInArrow(count, "pair long, links long")
    return posts.groupBy("pair").agg(F.sum("links").alias("links"))


def with_best(counts: DataFrame) -> DataFrame:
    """pair, links, best: no pair of its B id has more links."""
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b.alias("b")).agg(F.max("links").alias("highest"))
    return counts.withColumn("b", b).join(highest, "b").select("pair", "links", (F.col("links") == F.col("highest")).alias("best"))


class Scorer:
    """Tokens, groups and scores of texts; what a unit has is kept between batches."""

    def __init__(self, a_path: str, b_path: str, names: np.ndarray, links: np.ndarray, best: np.ndarray):
        self.paths, self.names, self.links, self.best = (a_path, b_path), names, links, best
        self.kept = WordTable(self.facts, KEPT_UNITS)

    def facts(self, units: list[str]) -> list[tuple]:
        """n_a, n_b, n_links, links that are best and sum of counts (frequent pairs), groups, other pairs."""
        out = []
        for i in range(0, len(units), TOGETHER):
            some = units[i : i + TOGETHER]
            found = Aligned(tokens_from(*self.paths), some)
            at = np.searchsorted(self.names, found.pair)
            known = at < len(self.names)
            known[known] = self.names[at[known]] == found.pair[known]
            unit = np.repeat(np.arange(len(some)), found.n_links)
            n_best, sums = np.zeros((2, len(some)), np.int64)
            np.add.at(n_best, unit[known], self.best[at[known]])
            np.add.at(sums, unit[known], self.links[at[known]])
            rare = found.pair[~known].tolist()
            ends = np.cumsum(np.bincount(unit[~known], minlength=len(some))).tolist()
            others = [rare[s:e] if s < e else () for s, e in zip([0, *ends], ends)]
            numbers = (x.tolist() for x in (found.n_a, found.n_b, found.n_links, n_best, sums))
            out += zip(*numbers, found.groups(), others)
        return out

    def values(self, units: list[str]) -> list[tuple]:
        if max(map(len, units)) <= KEPT_UNIT:
            return self.kept.values(units)
        short = [u for u in units if len(u) <= KEPT_UNIT]
        found = dict(zip(short, self.kept.values(short)))
        long = [u for u in units if u not in found]
        found |= zip(long, self.facts(long))
        return [found[u] for u in units]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[list[int]]]:
        """Numbers (n_a, n_b, n_links, n_best, count_sum), digest and rare pairs of each text; None has no tokens."""
        cut = re.compile(CUT).split
        units = [[] if t is None else cut(t) for t in texts]
        lengths = np.array([len(u) for u in units])
        numbers, digests, rare = np.zeros((5, len(texts)), np.int64), [""] * len(texts), [[] for _ in texts]
        if not lengths.sum():
            return numbers, digests, rare
        coded = pa.array([u for us in units for u in us], pa.large_string()).dictionary_encode()
        facts = list(zip(*self.values(coded.dictionary.to_pylist())))
        at = coded.indices.to_numpy()
        ends = np.cumsum(lengths)
        for row, fact in zip(numbers, facts[:5]):
            sums = np.append(0, np.cumsum(np.array(fact, np.int64)[at]))
            row[:] = sums[ends] - sums[ends - lengths]
        groups = pa.array(facts[5], pa.large_binary()).take(pa.array(at))
        offsets = np.frombuffer(groups.buffers()[1], np.int64)
        data = memoryview(groups.buffers()[2]).cast("B")
        has = np.array([bool(x) for x in facts[6]])[at]
        doc = np.repeat(np.arange(len(texts)), lengths)
        for i in np.flatnonzero(lengths).tolist():
            digests[i] = hashlib.sha256(data[offsets[ends[i] - lengths[i]] : offsets[ends[i]] - 1]).hexdigest()
        for i, k in zip(doc[has].tolist(), at[has].tolist()):
            rare[i] += facts[6][k]
        return numbers, digests, rare


FACTS = ["n_a", "n_b", "n_links", "n_best", "count_sum"]
SCORERS: dict[str, Scorer] = {}  # of a worker: the one of the last run


def scorer_of(run: str, *parts) -> Scorer:
    if run not in SCORERS:
        SCORERS.clear()
        SCORERS[run] = Scorer(*parts)
    return SCORERS[run]


def scored(docs: DataFrame, a_path: str, b_path: str, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    The tokenizers are given as paths that every machine has.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(docs["doc_id"], docs["text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = written(pair_counts(unit_counts(docs), a_path, b_path), "alignment-counts")
    counts = written(with_best(sums), "alignment-pairs")
    total = counts.agg(F.sum("links")).first()[0] or 0
    bound = total // heavy + 1
    frequent = counts.where(F.col("links") >= bound).toArrow()  # at most ``heavy`` rows: their links sum up to no more than all
    order = np.argsort(frequent.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy()[order] for c in ("pair", "links", "best")))
    run = uuid.uuid4().hex

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        valid = batch.column("valid").to_pylist()
        texts = [t.decode() if v else None for t, v in zip(texts_of(batch.column("text")), valid)]
        numbers, digests, rare = scorer_of(run, a_path, b_path, *known.value).texts(texts)
        return pa.record_batch({
            "doc_id": batch.column("doc_id"), **{f: pa.array(n) for f, n in zip(FACTS, numbers)},
            "groups_sha256": pa.array(digests, pa.string()), "rare": pa.array(rare, pa.list_(pa.int64())),
        })

    schema = f"doc_id {kind}, {', '.join(f'{f} long' for f in FACTS)}, groups_sha256 string, rare array<long>"
    found = docs.withColumn("valid", has_tokens(F.col("text"))).mapInArrow(per_batch(settle), schema)
    # a row's number is fixed by the written files
    rows = written(found.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
    rare = rows_of(rows, ["row"], "rare", "pair").join(counts.where(F.col("links") < bound), "pair").groupBy("row").agg(
        F.sum(F.col("best").cast("int")).alias("rare_best"), F.sum("links").alias("rare_sum")
    )
    more = lambda name, rest: (F.col(name) + F.coalesce(rest, F.lit(0))).alias(name)
    return rows.join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", more("n_best", "rare_best"),
        more("count_sum", "rare_sum"), "groups_sha256",
    )
