"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

The cost of a sequence is linear in its tokens plus quadratic in its pieces (attention stays inside a
piece). Documents are dealt into memory-sized buckets by a hash; in each bucket, full sequences are
cut off long documents, and the rest goes, longest first, to the cheapest sequence with room. Each
bucket opens only as many sequences as its tokens need, so a rest that fits nowhere is cut and fills
the cheapest gaps: padding is less than one sequence a bucket.

Cases: a null or empty text has the end token only; repeated rows are packed each; ties go by (id,
text hash); an empty table gives no rows; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WordTable, give_back, per_batch, prepare, texts_of, with_columns

SEQUENCE = 4096
END = 2
BUCKET_BYTES = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048  # the parts are equal for a piece of 2048 tokens

TOGETHER = 512  # words that are encoded as one text
GATHERED = 2 << 20  # bytes of rows that are encoded at once: the more, the fewer look-ups and the more memory
# a letter that normal forms leave alone, or a digit, and a mark that begins no contraction or special token
BORDER = r"""([A-Za-z0-9À-ÖØ-öø-ÿ])([!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~])"""


class Ids:
    """Token ids (little-endian unsigned 32-bit) of texts.

    The tokenizer drops white space, so the ids of a text are those of its words one after another. Each
    different word is encoded once by the tokenizer itself, many together with blanks between them; a
    token belongs to the word in which it begins.

    It also cuts at each ``BORDER`` and lower-cases, so a mark behind a word is a word of its own, and
    ASCII words are looked up in lower case. Others are not: normal form comes before lower case, and
    J̌ in lower case has another one. Neither are words that may be special tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = WordTable(self.encoded)

    def encoded(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            texts = [w.decode("utf-8", "replace") for w in words[i : i + TOGETHER]]
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.fromiter((s for s, _ in found.offsets), np.int64, len(found))
            ends = np.cumsum([len(t) + 1 for t in texts])
            ids = np.array(found.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(starts, ends)).tolist()
            out += [ids[s:e] for s, e in zip([0, *cuts], cuts)]
        return out

    def text(self, text: bytes) -> bytes:
        return self.texts([text])[0]

    def texts(self, texts: list[bytes]) -> list[bytes]:
        column = pa.array(texts, pa.large_binary()).view(pa.large_string())
        column = pc.replace_substring_regex(column, BORDER, r"\1 \2")
        words = pc.ascii_split_whitespace(column)
        del column
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        known = coded.dictionary
        plain = pc.and_not(pc.string_is_ascii(known), pc.match_substring(known, "<|"))
        known = pc.if_else(plain, pc.ascii_lower(known), known).view(pa.large_binary())
        found = pa.array(self.words.values(known.to_pylist()), pa.large_binary()).take(coded.indices)
        offsets = np.frombuffer(found.buffers()[1], np.int64)
        data = memoryview(found.buffers()[2] or b"").cast("B")
        cuts = offsets[words.offsets.to_numpy()].tolist()
        return [bytes(data[s:e]) for s, e in zip(cuts, cuts[1:])]


@cache
def ids_from(path: str) -> Ids:
    return Ids(path)


def pack(lengths: np.ndarray, size: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Pieces (document, start, length, sequence, offset) of documents given longest first."""
    pieces, rests, opened = [], [], 0
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - size + 1, size):
            pieces.append((d, start, size, opened, 0))
            opened += 1
        if n % size:
            rests.append((n % size, d, n - n % size))
    rests.sort(key=lambda r: (-r[0], r[1]))
    count = -(-sum(r[0] for r in rests) // size)
    room, cost = np.full(count, size), np.zeros(count)

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, opened + s, size - int(room[s])))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n, d, start in rests:
        while n:
            fits = room >= n
            ready = fits if fits.any() else room > 0
            s = int(np.where(ready, cost, np.inf).argmin())
            part = min(n, int(room[s]))
            put(d, start, part, s)
            n, start = n - part, start + part
    return pieces


def gathered(batches: Iterator[pa.RecordBatch], least: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, until they hold ``least`` bytes.

    Encoding takes some ten times the bytes of a text for a while: they are given back after each.
    """
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.nbytes for b in some) >= least:
            batch, some = pa.concat_batches(some), []
            yield batch
            give_back()
    if some:
        yield pa.concat_batches(some)


PIECES = "doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end: int = END, bucket_bytes: int = BUCKET_BYTES,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece, with its token ids; ``tokenizer`` is a path that every machine has."""
    prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(docs[text]) + 8)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    hashed = F.xxhash64(docs[key], docs[text])
    rows = docs.select(
        docs[key].alias("doc_id"), docs[text].alias("text"), hashed.alias("place"),
        F.pmod(hashed, F.lit(buckets)).alias("bucket"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    tail = np.array([end], "<u4").tobytes()

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = ids_from(tokenizer)
        new = pa.array([t + tail for t in ids.texts(texts_of(batch.column("text")))], pa.binary())
        return with_columns(batch.select(["doc_id", "place", "bucket"]), {"ids": new})

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        ids_from.cache_clear()  # all ids are made
        give_back()  # what the bucket before needed
        bucket = key[0].as_py()
        ids = rows.column("ids").to_pylist()
        names, places = rows.column("doc_id").to_pylist(), rows.column("place").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), names[i] is None, names[i] if names[i] is not None else 0, places[i]))
        lengths = np.array([len(ids[i]) // 4 for i in order])
        pieces = pack(lengths, size)
        at = [order[p[0]] for p in pieces]
        return pa.table(
            {
                "doc_id": rows.column("doc_id").combine_chunks().take(pa.array(at)),
                "start": pa.array([p[1] for p in pieces], pa.int64()),
                "length": pa.array([p[2] for p in pieces], pa.int64()),
                "ids": pa.array([ids[i][4 * p[1] : 4 * (p[1] + p[2])] for i, p in zip(at, pieces)], pa.binary()),
                "doc_tokens": pa.array([len(ids[i]) // 4 for i in at], pa.int64()),
                "sequence_id": pa.array([p[3] * buckets + bucket for p in pieces], pa.int64()),
                "offset": pa.array([p[4] for p in pieces], pa.int64()),
            }
        )

    encoded = rows.mapInArrow(lambda batches: per_batch(tokens)(gathered(batches)), f"doc_id {kind}, place long, bucket long, ids binary")
    return encoded.groupBy("bucket").applyInArrow(fill, PIECES.format(key=kind))
