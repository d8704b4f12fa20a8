"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser (a mark before the text, spaces to
marks), the pieces (a trie whose paths read characters and write a piece) and the byte fallback (a
character that no piece has writes its bytes). Composed with an input they give a graph of arcs; the
encoding is the shortest path in the tropical semiring. In a byte-pair model an arc has weight 1 if
merging its two neighbours alone leaves them as they are, else infinity: the encoding is the one
path whose neighbours all are, so it is the one of finite weight.

No piece has a mark after another character, nor a line break, so paths never cross these places: a
text is composed word by word, and the path of a word is kept for the next time it comes.

Cases: a null or empty text has no pieces; characters outside the model go by bytes; texts of any
length are read whole; repeated rows are encoded each; input columns named like the results give way.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import WordTable, per_batch, prepare, texts_of, with_columns

MARK = "▁"
END = -1  # key of a piece's id in the trie
KEPT = 700_000  # words of a worker that are kept
UNITS = re.compile(rb" *[^ \n]+| +|\n")


def proto_fields(data: bytes):
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        settings = dict(proto_fields(dict(proto_fields(model.serialized_model_proto()))[3]))
        if settings.get(2) or settings.get(4, 1) or not settings.get(3, 1):
            raise ValueError("only models with the identity normaliser and a mark before the text are supported")
        size = model.vocab_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.pieces = {model.id_to_piece(i): i for i in range(size) if not special(i)}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece crosses a word or line border")
        self.bytes_id = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.spelled: list[bytes] = [b""] * size
        for piece, i in self.pieces.items():
            self.spelled[i] = piece.replace(MARK, " ").encode()
        for byte, i in self.bytes_id.items():
            self.spelled[i] = bytes([byte])
        self.names = {i: p for p, i in self.pieces.items()}
        self.score = {p: model.get_score(i) for p, i in self.pieces.items()}
        # a piece that merging its own characters does not give is on no path of finite weight
        self.trie: dict = {}
        for piece, i in self.pieces.items():
            if self.merged(piece) == [piece]:
                node = self.trie
                for char in piece:
                    node = node.setdefault(char, {})
                node[END] = i
        self.fits: dict[int, bool] = {}
        self.size = size
        self.words = WordTable(lambda units: [self.unit(u) for u in units], KEPT)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are beside each other."""
        a, b = self.names[left], self.names[right]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        known = self.fits[left * self.size + right] = self.merged(a + b) == [a, b]
        return known

    def path(self, text: str) -> list[int]:
        """Pieces of the shortest path; below 0: minus (1 + code point) of a character that goes by bytes."""
        # states at a place: (weight, piece of the last arc, state before); a byte (below 0) merges with nothing
        length, size, known = len(text), self.size, self.fits.get
        states: list[list] = [[] for _ in range(length + 1)]
        states[0].append((0, -1, None))
        for i in range(length):
            here = states[i]
            if not here:
                continue
            node, j, arcs = self.trie, i, []
            while j < length and (node := node.get(text[j])) is not None:
                j += 1
                if (piece := node.get(END)) is not None:
                    arcs.append((j, piece))
            if not arcs or arcs[0][0] != i + 1:
                arcs.append((i + 1, -2 - ord(text[i])))
            for j, piece in arcs:
                best = None
                for state in here:
                    if best is None or state[0] < best[0]:
                        left = state[1]
                        if left < 0 or piece < 0:
                            best = state
                        else:
                            fit = known(left * size + piece)
                            if self.neighbours(left, piece) if fit is None else fit:
                                best = state
                if best is not None:
                    states[j].append((best[0] + 1, piece, best))
            states[i] = []
        state = min(states[-1], key=lambda s: s[0])
        out = []
        while state[2] is not None:
            out.append(state[1])
            state = state[2]
        return out[::-1]

    def unit(self, unit: bytes) -> bytes:
        ids: list[int] = []
        for piece in self.path(unit.decode("utf-8", "replace").replace(" ", MARK)):
            ids += [piece] if piece >= 0 else [self.bytes_id[b] for b in chr(-2 - piece).encode()]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        # a mark of the text itself reads as a space does
        return b"".join(self.words.values(UNITS.findall(b" " + text.replace(MARK.encode(), b" "))))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


RESULTS = {"ids": (pa.binary(), T.BinaryType()), "n_tokens": (pa.int64(), T.LongType())}


def _check_columns(docs: DataFrame, names, text: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.drop(*[c for c in names if c != text])


def encoded(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The rows with ids (binary, little-endian unsigned 32-bit) and n_tokens."""
    docs = _check_columns(docs, RESULTS, text)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = transducer(model)
        ids = [machine.encode(t) for t in texts_of(batch.column(text))]
        return with_columns(batch, {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64())})

    schema = T.StructType([*docs.schema, *(T.StructField(n, t) for n, (_, t) in RESULTS.items())])
    return docs.mapInArrow(per_batch(add), schema)


def decoded(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; marks read as spaces."""
    rows = _check_columns(rows, [text], ids)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = transducer(model)
        out = [machine.decode(i or b"").decode("utf-8", "replace") for i in batch.column(ids).to_pylist()]
        return with_columns(batch, {text: pa.array(out, pa.string())})

    return rows.mapInArrow(per_batch(add), T.StructType([*rows.schema, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32, decoded_crc32, and whether decoding gives the text back."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = transducer(model)
        first, last = min(machine.bytes_id.values()), max(machine.bytes_id.values())
        rows = []
        for text in texts_of(batch.column("text")):
            ids = machine.encode(text)
            numbers = np.frombuffer(ids, "<u4")
            back = machine.decode(ids)
            same = back == text.replace(MARK.encode(), b" ")
            rows.append((len(numbers), int(((numbers >= first) & (numbers <= last)).sum()), zlib.crc32(ids), zlib.crc32(back), same))
        names = ("n_tokens", "n_byte_tokens", "ids_crc32", "decoded_crc32", "round_trip")
        return with_columns(batch.select(["doc_id"]), {n: pa.array(v) for n, v in zip(names, zip(*rows))})

    return docs.mapInArrow(
        per_batch(add), f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    )
