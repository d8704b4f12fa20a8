"""SimHash near-dedup, tokenizer alignment and the filter audit against plain versions."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from check_oracle import ROOT, canonical, connection
from stackfolio.llm import alignment, filter_audit, simhash
from stackfolio.llm.queries import ORACLES, QUERIES

FOLDER = f"{ROOT}/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, fp string, part string, row string, pairs string, failed string"
WORD = [f"w{i}" for i in range(300)] + ["straße", "ÉTÉ", "the", "of", "日本", " x", "a\x00b", "#5", "UP"]


def text_of(rng, n):
    return " ".join(rng.choice(WORD) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = text_of(rng, 200)
    texts = [base] * 4 + [base.replace(" w1", f" x{i}", i) for i in range(6)]
    texts += [text_of(rng, n) for n in (1, 2, 3, 4, 49, 50, 51, 400)] + [None, None, "", " \n\t", "…", "a" * 500]
    texts += ["one▁two", "<|endoftext|> <s> </s> <unk>", " " + base, "A B C d", "x " * 60, "  two  blanks ", "a\x00b\x1fc\x7f"]
    texts += [" ".join(text_of(rng, 40) for _ in range(100)), "\n\n".join(text_of(rng, 30) for _ in range(20))]
    table = [(i, t, ["s1", None, "", "s2"][i % 4], *["clash"] * 5) for i, t in enumerate(texts)]
    return [*table, (None, base, "s1", *[None] * 5), (None, None, None, *[None] * 5), table[0], table[5], (0, base, "s9", *[None] * 5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in fps:
        for y in fps:
            if x < y and bin(x ^ y).count("1") <= radius:
                label[root(x)] = root(y)
    return {f: root(f) for f in fps}


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("fp")), "component_id").collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = plain_components(set(fps), 3)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    assert Counter(map(tuple, got)) == Counter((r[0], f"{f:016x}", least[root[f]]) for r, f in zip(rows, fps))
    assert len(set(least.values())) > 8
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_ball_links(spark, radius):
    """Random centres with up to five changed bits, and a chain of steps of the radius."""
    rng = random.Random(radius)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(8):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    step = rng.getrandbits(64)
    for _ in range(20):
        step ^= sum(1 << b for b in rng.sample(range(64), radius))
        fps.add(step)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.ball_links(table, radius).collect()]
    assert all(bin(u ^ v).count("1") <= radius for u, v in links)
    want = plain_components(fps, radius)
    joined = {f: f for f in fps}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for u, v in links:
        joined[root(u)] = root(v)
    groups = lambda name: {frozenset(g for g in fps if name(g) == name(f)) for f in fps}
    assert groups(root) == groups(want.get)


def test_half_of_the_bits_is_no_bit():
    assert simhash.fingerprint(np.array([1, 2], np.uint64)) == 0
    assert simhash.fingerprint(np.array([1, 1, 2], np.uint64)) == 1
    assert simhash.fingerprint(np.array([1 << 63], np.uint64)) == -(1 << 63)
    with pytest.raises(ValueError):
        simhash.ball_links(None, 4)


def plain_alignment(tokens, text):
    """(A ids, B ids, groups as lists of ids): ends in common found one by one."""
    if not text:
        return [], [], []
    a, b = tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
    size = lambda ids, entries: [len(entries[i].as_py()) for i in ids]
    whole = (" " + text).encode()
    if any(b"".join(e[i].as_py() for i in ids) != whole for ids, e in ((a, tokens.a_bytes), (b, tokens.b_bytes))):
        return [], [], []
    ends_a, ends_b = np.cumsum(size(a, tokens.a_bytes)).tolist(), np.cumsum(size(b, tokens.b_bytes)).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return a, b, groups


@pytest.mark.parametrize("heavy", [1, 20, 1 << 16])
def test_alignment(docs, rows, none, heavy):
    tokens = alignment.tokens_from(*PATHS)
    found = [plain_alignment(tokens, r[1]) for r in rows]
    assert sum(not f[0] and bool(r[1]) for f, r in zip(found, rows)) == 1  # the mark for a blank
    links = [[(a[-1], b[-1]) for a, b in groups] for _, _, groups in found]
    count = Counter(p for doc in links for p in doc)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter()
    for r, (a, b, groups), doc in zip(rows, found, links):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        n_best = sum(count[p] == best[p[1]] for p in doc)
        want[(r[0], len(a), len(b), len(groups), len(doc), n_best, sum(count[p] for p in doc), digest)] += 1
    got = alignment.scored(docs, *PATHS, heavy=heavy)
    assert Counter(map(tuple, got.collect())) == want
    assert alignment.scored(none, *PATHS).count() == 0


def test_alignment_ends():
    """Every kind of overlap, by random cuts of the same bytes."""
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 60)
        a, b = (np.array(sorted({n, *(rng.randrange(1, n + 1) for _ in range(rng.randrange(n + 1)))})) for _ in "ab")
        label = alignment.terminals(a, b)
        common = sorted(set(a.tolist()) & set(b.tolist()))
        want = [a.tolist().index(min(c for c in common if c >= end)) for end in [*a.tolist(), *b.tolist()]]
        assert label.tolist() == want


def test_units_encode_as_the_whole():
    tokens = alignment.tokens_from(*PATHS)
    rng = random.Random(9)
    kinds = [text_of(rng, 600), "a" * 300, " " * 200 + "b  c " * 80, "don't we'll 12 34 ... !! " * 40, "é　 x  y \x1c z " * 30, "x y\n", " x"]
    letters = [" \n\tab1.é日'sz", " \u2028 x\x85y", "a b'", "😀 é"]
    for text in kinds + ["".join(rng.choice(letters[i % 4]) for _ in range(2000)) for i in range(40)]:
        units = re.split(alignment.CUT, text)
        assert " ".join(units) == text
        a, n_a, b, n_b = tokens.ids(units)
        assert a.tolist() == tokens.a.encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == tokens.b.encode(text)
        for unit, i, j, k, m in zip(units, np.cumsum(n_a) - n_a, np.cumsum(n_a), np.cumsum(n_b) - n_b, np.cumsum(n_b)):
            assert [a[i:j].tolist()] == tokens.encode_a([unit]) and [b[k:m].tolist()] == tokens.encode_b([unit])
    with pytest.raises(ValueError):
        tokens.ids(["one▁two"])


def plain_failed(rows):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    for r in rows:
        text = r[1] or ""
        words = text.encode().split()
        yield [
            len(words) < 50, 100 * len(set(words)) < 65 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text),
            r[0] is not None and r[0] > first[text],
        ]


def test_filter_audit(spark, docs, rows, none):
    flags = [(0, 1, 0), (0, 0, 0), (1, 1, 1), (12, 0, 1), (15, None, 1), (15, 1, None), (None, 1, 1), (9999, 1, 1)]
    labels = spark.createDataFrame(flags, "doc_id long, quality int, toxic int")
    good = {i for i, q, _ in flags if q == 1 and i is not None}
    toxic = {i for i, _, t in flags if t == 1 and i is not None}
    failed = list(plain_failed(rows))
    assert all(any(f[k] for f in failed) for k in range(5))
    want = set()
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        found, shapley = [], Counter()
        for order in permutations(range(5)):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [d for d in left if d[1][k]]
                left = [d for d in left if not d[1][k]]
                shapley[k] += len(gone)
                found.append((order, step, k, len(left), gone))
        for order, step, k, kept, gone in found:
            want.add((
                part, "".join("ABCDE"[i] for i in order), step, kept, len(gone), sum(f[k] for _, f in mine) - len(gone),
                sum(f[k] and sum(f) == 1 for _, f in mine), sum(i in good for i, _ in gone),
                sum(i in toxic for i, _ in gone), shapley[k],
            ))
    got = filter_audit.audited(filter_audit.failure_counts(docs, labels)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert filter_audit.audited(filter_audit.failure_counts(none, labels)).count() == 0
    assert filter_audit.audited(filter_audit.failure_counts(docs, labels.limit(0))).count() == len(want)


def test_lattice_counts_paths():
    lattice = filter_audit.Lattice(4)
    assert sum(n for (s, _), n in zip(lattice.edges, lattice.orders) if s == 0) == 24
    through = Counter(edge for _, _, edge, _ in lattice.paths(permutations(range(4))))
    assert [through[i] for i in range(len(lattice.edges))] == lattice.orders


COLUMNS = {
    "op11_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op12_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    out = QUERIES[name](spark, FOLDER)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) == COLUMNS[name]
    rows = out.collect()
    if name in ORACLES:
        sql = connection(FOLDER).sql(ORACLES[name])
        assert canonical(out.columns, rows) == canonical(list(sql.columns), sql.fetchall())
    else:
        assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_packing_ids_are_those_of_the_tokenizer():
    """Every code point between two letters and beside a blank, special tokens, and random texts with control characters."""
    from stackfolio.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.Ids(path)
    plain = lambda texts: [e.ids for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(4)
    some = points[:0x3100] + rng.sample(points, 6000)
    texts = [f"a{c}b" for c in some] + [f"x {c}{d} {c} y" for c, d in zip(some, rng.sample(some, len(some)))]
    letters = "ab é\x00\x01\x1c\x1f\x7f\x85  \t\n\r\x0b'st’3½́Σσİ<|endoftext|>日本"
    texts += ["".join(rng.choice(letters) for _ in range(60)) for _ in range(500)]
    texts += ["a<|endoftext|>b <|startoftext|> c", "<|endoftext|>", "", " ", "don't DON'T we'LL", "x" * 5000, "é" * 300 + " y"]
    got = [np.frombuffer(i, "<u4").tolist() for i in ids.texts([t.encode() for t in texts])]
    for text, mine, whole in zip(texts, got, plain(texts)):
        assert mine == whole, ascii(text)
    assert not any(len(w) > ids.words.longest for w in ids.words.young)


def test_packing_encodes_a_word_once_whatever_its_case_and_marks():
    """Words in other letter case or before a mark are no new words; where case or cut would matter they are."""
    import pyarrow as pa

    from stackfolio.llm import packing

    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    plain = lambda text: ids.tokenizer.encode(text, add_special_tokens=False).ids
    texts = ["Word word, WORD. (word) word!! wörd; Wörd", "word word?"]
    assert [np.frombuffer(i, "<u4").tolist() for i in ids.texts([t.encode() for t in texts])] == [plain(t) for t in texts]
    assert sorted(ids.words.young) == sorted(w.encode() for w in [",", ".", "(word", ")", "!!", "wörd", ";", "Wörd", "?", "word"])
    odd = ["J̌ ǰ H̱ T̈x W̊ Y̊ İ KK", "<|ENDOFTEXT|> a<|endoftext|>,b A<|startoftext|>.", "a̸= a≠ é,́ x́, 1,2.5;3", "It's,'s A'S b.'T \"Q\"'re a''ll, É'VE."]
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    odd += [f"{a}{m}{b}" for m in marks for a in ("A", "é", "ÿ", "7", "β", "á", "<|", m, "'") for b in ("", "B", "'s", "̸", "|>", "́", m, "9")]
    rng = random.Random(8)
    letters = "aAbBjJsStTéÉÿß7½'\",.&|<>-̸̌̇́ \n\x85K"
    odd += ["".join(rng.choice(letters) for _ in range(50)) for _ in range(3000)]
    for text, got in zip(odd, ids.texts([t.encode() for t in odd])):
        assert np.frombuffer(got, "<u4").tolist() == plain(text), ascii(text)
    for broken in (b"A\xff,b \xc3, D\xe2\x82.", b"\xff", b"Caf\xc3,A"):
        want = [i for w in broken.split() for i in plain(w.decode("utf-8", "replace"))]
        assert np.frombuffer(ids.text(broken), "<u4").tolist() == want
    batches = [pa.RecordBatch.from_pydict({"n": pa.array(range(k), pa.int64())}) for k in (0, 5, 3, 0, 9, 1)]
    for least in (1, 60, 1 << 20):
        assert [n for b in packing.gathered(iter(batches), least) for n in b.column("n").to_pylist()] == [n for b in batches for n in b.column("n").to_pylist()]
    assert [b.num_rows for b in packing.gathered(iter(batches), 60)] == [8, 9, 1] and not list(packing.gathered(iter([])))


def test_search_goes_through_no_list_after_the_pivot(monkeypatch):
    """Best rows and ties as by brute force, though only lists up to the pivot are gone through."""
    import pyarrow as pa

    from stackfolio.llm import search

    monkeypatch.setattr(search, "FEW", 1)
    monkeypatch.setattr(search, "MORE", 3)
    monkeypatch.setattr(search, "FREQUENT", 12)
    rng = random.Random(6)
    names = [f"w{i}" for i in range(3000)]
    odds = [1 / (i + 1) for i in range(3000)]
    texts = [" ".join(rng.choices(names, odds, k=rng.randint(0, 80))).encode() for _ in range(2500)]
    texts += [texts[7]] * 30 + [b"", b"w0", b"w2999 w2999"]
    found = [search.terms(t) for t in texts]
    mean = sum(map(len, found)) / len(found)
    counts = {}
    for words in found:
        for w in set(words):
            counts[w] = counts.get(w, 0) + 1
    weight = {w: float(np.log(1 + (len(texts) - n + 0.5) / (n + 0.5))) for w, n in counts.items()}
    index = search.Index(texts, mean)
    asked = [sorted(set(found[i])) for i in (*range(40), 2501, 2531, 2532)] + [[], [b"none"], [b"none", b"w1"], [b"w0", b"w1", b"w2"]]
    rows = [[{"term": t, "weight": weight.get(t, 9.0)} for t in terms] for terms in asked]
    kind = pa.list_(pa.struct([("term", pa.binary()), ("weight", pa.float64())]))
    known = index.known(pa.array([[{"term": b"w5", "weight": 1.0}], *rows], kind).slice(1))
    gone = []
    lists = index.lists
    monkeypatch.setattr(index, "lists", lambda n, w: gone.append(len(lists(n, w)[0])) or lists(n, w))
    for terms, (numbers, weights) in zip(asked, known):
        scores = np.zeros(len(texts))
        for r, words in enumerate(found):
            for t in terms:
                f = words.count(t)
                scores[r] += weight.get(t, 9.0) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / mean)) if f else 0
        scores = np.round(scores, search.DIGITS)
        want = [r for r in np.lexsort((np.arange(len(scores)), -scores)).tolist() if scores[r] > 0][:10]
        r, s = index.best(numbers, weights, 10)
        top = np.lexsort((r, -s))[:10]
        assert len(set(r.tolist())) == len(r) and not index.weight.any()
        assert r[top].tolist() == want or np.abs(np.sort(s[top]) - np.sort(scores[want])).max() < 1e-5
        assert set(want) - set(r.tolist()) == set() or len(want) == 10
    whole = sum(counts.get(t, 0) for terms in asked for t in terms)
    assert 0 < sum(gone) < 0.6 * whole
    assert [len(n) for n, _ in known[-4:]] == [0, 0, 1, 3]
    empty = search.Index([], 1.0)
    assert empty.known(pa.array([[{"term": b"a", "weight": 1.0}]], kind))[0][0].size == 0 and empty.known(pa.array([], kind)) == []
