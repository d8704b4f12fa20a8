"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions and gives each position a distribution over the
languages seen in training; a document's distribution is the mean over all its positions. It is trained
in numpy by backpropagation through time on a bounded sample: at most ``SAMPLE`` windows of each language, one a row; every language that
has a row to learn from is in it.

Cases: a null text, or one without a letter, is ``und`` with score 0; with no rows to learn from, all
are; ties go to the first language by name; texts of any length are read whole, window by window;
repeated rows are labelled each; rows without id or language are not learned from; input columns
named like the results give way to them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .base import per_batch, prepare, texts_of, with_columns

SAMPLE = 1000  # rows of each language to learn from: the bound of what reaches the driver
CHARS = 120  # of each, from a place that its hash names
HIDDEN = 8
WINDOW = 128
LANES = 2048  # windows that run side by side
STEPS = 160  # batches to train on, whatever the size of the sample
PAD = 256  # the byte after the last; leaves the state as it is


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE, chars: int = CHARS) -> list[tuple[bytes, str]]:
    """Parts of texts with their language: the rows of smallest hash in each language that may be learned from."""
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    hashed = F.xxhash64("doc_id", "text")
    start = F.pmod(F.shiftright(hashed, 8), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    part = F.col("text").substr(start, F.lit(chars)).cast("binary")
    # of each language about twice as many as asked for are sorted, whatever the length of the table
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return []
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(1, r["count"] // (2 * rows)))])
    some = usable.where(F.pmod(hashed, F.element_at(shares, F.col("lang"))) == 0)
    thinned = some.select(hashed.alias("h"), part.alias("part"), "lang")
    best = Window.partitionBy("lang").orderBy("h", "part")
    few = thinned.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= rows).orderBy("h", "part", "lang")
    return [(bytes(r["part"]), r["lang"]) for r in few.collect()]


def windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(width, number) matrix of byte numbers, padded; the text of each column."""
    counts = np.array([-(-len(t) // width) for t in texts])
    flat = np.full(int(counts.sum()) * width, PAD, np.int64)
    at = 0
    for t, c in zip(texts, counts.tolist()):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += c * width
    return np.ascontiguousarray(flat.reshape(-1, width).T), np.repeat(np.arange(len(texts)), counts)


class Network:
    """Parameters by name; for direction d: Wd inputs by byte, Ud recurrent, bd of the candidate; V, c output.

    Rows of W and U are update gate, reset gate, candidate. Gates are logistic; their inputs are kept
    halved, so that one tanh serves all.
    """

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.p: dict[str, np.ndarray] = {"V": rng.normal(0, 0.3, (len(langs), 2 * hidden)), "c": np.zeros((len(langs), 1))}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.4, (3 * hidden, PAD + 1))
            self.p[f"U{d}"] = rng.normal(0, 0.3, (3 * hidden, hidden))
            self.p[f"b{d}"] = np.zeros((hidden, 1))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.close_pad()

    def close_pad(self) -> None:
        for d in "fb":
            self.p[f"W{d}"][:, PAD] = 0
            self.p[f"W{d}"][: self.hidden, PAD] = 20

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """(positions, hidden, lanes); ``keep`` gets what the way back needs."""
        n, (w, u, b) = self.hidden, (self.p[k + d] for k in "WUb")
        h = np.zeros((n, x.shape[1]), np.float32)
        out = np.empty((len(x), n, x.shape[1]), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, g = np.take(w, x[t], axis=1), u @ h
            gates = np.tanh(a[: 2 * n] + g[: 2 * n])
            gates += 1
            gates *= 0.5
            z, r = gates[:n], gates[n:]
            q = g[2 * n :] + b
            c = np.tanh(a[2 * n :] + r * q)
            if keep is not None:
                keep.append((t, h, z, r, q, c))
            h = c + z * (h - c)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(languages, positions, lanes)."""
        back = {d: [] for d in "fb"} if keep is not None else {"f": None, "b": None}
        s = np.concatenate([self.states(x, "f", back["f"]), self.states(x, "b", back["b"])], axis=1)
        logits = np.matmul(self.p["V"], s) + self.p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        if keep is not None:
            keep.update(states=s, back=back)
        return logits.transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the cross entropy of all positions; ``weight`` is that of a position of each lane."""
        n, keep = self.hidden, {}
        p = self.probabilities(x, keep)
        d = p - (np.arange(len(self.langs))[:, None] == y)[:, None, :]
        d *= (weight * (x != PAD))[None]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = keep["states"]
        grads["V"] = np.einsum("ktb,thb->kh", d, s, optimize=True)
        grads["c"] = d.sum(axis=(1, 2))[:, None]
        ds = np.einsum("kh,ktb->thb", self.p["V"], d, optimize=True)
        for name, part in (("f", ds[:, :n]), ("b", ds[:, n:])):
            u = self.p[f"U{name}"]
            dh = np.zeros_like(part[0])
            inputs = np.zeros((len(x), 3 * n, x.shape[1]), np.float32)
            for t, h, z, r, q, c in reversed(keep["back"][name]):
                dh = dh + part[t]
                dc = dh * (1 - z) * (1 - c * c)
                # halved gate inputs: the slope of (1 + tanh v) / 2 is 2 s (1 - s)
                dz = dh * (h - c) * 2 * z * (1 - z)
                dr = dc * q * 2 * r * (1 - r)
                dq = dc * r
                inputs[t] = np.concatenate([dz, dr, dc])
                g = np.concatenate([dz, dr, dq])
                grads[f"U{name}"] += g @ h.T
                grads[f"b{name}"] += dq.sum(axis=1, keepdims=True)
                dh = dh * z + u.T @ g
            flat = inputs.transpose(0, 2, 1).reshape(-1, 3 * n)
            by_byte = np.zeros((PAD + 1, 3 * n), np.float32)
            np.add.at(by_byte, x.ravel(), flat)
            grads[f"W{name}"] = by_byte.T
        return grads

    def label(self, texts: list[bytes], width: int = WINDOW, lanes: int = LANES) -> np.ndarray:
        """(texts, languages): mean distribution over all positions of each text."""
        x, of = windows(texts, width)
        total = np.zeros((len(texts), len(self.langs)))
        for a in range(0, x.shape[1], lanes):
            part = x[:, a : a + lanes]
            p = self.probabilities(part)
            p *= (part != PAD)[None]
            np.add.at(total, of[a : a + lanes], p.sum(axis=1).T)
        return total / np.maximum([[len(t)] for t in texts], 1)


def train(rows: list[tuple[bytes, str]], steps: int = STEPS, batch: int = 128, rate: float = 0.02, seed: int = 1) -> Network | None:
    """Adam over shuffled batches; languages weigh alike whatever their share."""
    if not rows:
        return None
    langs = sorted({lang for _, lang in rows})
    net, rng = Network(langs, seed=seed), np.random.default_rng(seed)
    x, of = windows([t for t, _ in rows], WINDOW)
    y = np.array([langs.index(lang) for _, lang in rows])[of]
    share = np.bincount(y, minlength=len(langs)) / len(y)
    weight = (1 / (share[y] * len(langs) * WINDOW * batch)).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    while step < steps:
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            b = order[a : a + batch]
            grads = net.gradients(x[:, b], y[b], weight[b])
            step += 1
            speed = rate * (1 - step / (steps + 1))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.p[k] -= (speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.close_pad()
    return net


LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def identified(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The rows with lang_pred and score."""
    prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c != text])

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(text))
        known = [i for i, t in enumerate(texts) if net and has_letter(t)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            mean = net.label([texts[i] for i in known])
            for i, k, s in zip(known, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist()):
                langs[i], scores[i] = net.langs[k], min(1.0, s)
        return with_columns(batch, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(per_batch(add), schema)


def learned(docs: DataFrame) -> Network | None:
    return train(sample(docs.select("doc_id", "text", "lang")))


def language_kept(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Rows of a known language, by a mean probability of at least ``least``, as they came."""
    whole = docs.select(docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    found = identified(whole, learned(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns])
