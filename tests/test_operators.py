"""Operators on small tables, brute force beside them, and skewed groups."""

import random

from pyspark.sql import functions as F

import re

import pytest
from stackfolio.operators import changes, lookup, order, scan, sets, tree
from stackfolio.operators.reconcile import reconcile
from stackfolio.operators.shape import vacuum
from stackfolio.plans import repairs
from stackfolio.sources import inline_lookup
from stackfolio.streaming.changes import live_records, read_log, replay_dedupe, upsert_stream
from stackfolio.sinks import read_snapshot


@pytest.mark.parametrize("chunk_rows", [1, 40, 10**6])
def test_scan_over_a_hot_group(spark, chunk_rows):
    """One group holds most rows and spreads over many chunks; the values are those of a plain loop."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(20)}", i, rng.choice([None, i]), rng.randrange(3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, v int, w int").repartition(5)
    got = scan.scan(
        df, ["g"], [F.col("i").asc()], number="n", count="c", sums={"s": "w"}, lasts={"l": "v"}, previous={"p": "i"}, following={"f": "i"},
        chunk_rows=chunk_rows,
    ).collect()
    want = {}
    for g in {r[0] for r in rows}:
        members = sorted(r for r in rows if r[0] == g)
        total, last = 0, None
        for k, (_, i, v, w) in enumerate(members):
            total, last = total + w, v if v is not None else last
            want[i] = (
                k + 1, len(members), total, last, members[k - 1][1] if k else None, members[k + 1][1] if k + 1 < len(members) else None,
            )
    assert {r["i"]: (r["n"], r["c"], r["s"], r["l"], r["p"], r["f"]) for r in got} == want


@pytest.mark.parametrize("chunk_rows", [1, 10**6])
def test_scan_with_missing_key(spark, chunk_rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, i int")
    got = scan.scan(df, ["g"], [F.col("i").asc()], number="n", chunk_rows=chunk_rows).collect()
    assert sorted((r["i"], r["n"]) for r in got) == [(1, 1), (2, 2), (3, 1)]
    assert scan.scan(df.limit(0), ["g"], [F.col("i").asc()], number="n", chunk_rows=chunk_rows).count() == 0
    assert scan.scan(df.limit(0), [], [F.col("i").asc()], number="n", chunk_rows=chunk_rows).count() == 0


SCAN_ORDERS = {
    "text": lambda: [F.col("t").asc(), F.col("i").asc()], "text falling": lambda: [F.col("t").desc(), F.col("i").asc()],
    "number falling, nulls last": lambda: [F.col("y").desc_nulls_last(), F.col("i").desc()],
    "number falling, nulls first": lambda: [F.col("y").desc_nulls_first(), F.col("i").asc()],
    "nulls last": lambda: [F.col("y").asc_nulls_last(), F.lower("t").asc(), F.col("i").desc()],
    "date falling": lambda: [F.col("d").desc(), F.col("f").asc(), F.col("i").asc()],
    "fraction falling": lambda: [F.col("f").desc(), F.col("i").asc()], "decimal falling": lambda: [F.col("m").desc(), F.col("i").asc()],
    "time falling": lambda: [F.col("z").desc(), "i"],
}


@pytest.mark.parametrize("name", list(SCAN_ORDERS))
def test_ranks_of_cut_groups(spark, name):
    """Against a window, with few chunks and many, for each kind of order; no job and no write before the result."""
    from pyspark.sql import Window

    rng = random.Random(len(name))
    rows = [
        (rng.choice(["a", "a", "b", None]), rng.choice(["é", "Z", "zz", None, "a b"]), i, rng.choice([None, 1, 2, -3]), rng.choice([0.5, -1.0, None]))
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "g string, t string, i int, y int, f double").withColumns({
        "d": F.date_add(F.lit("2020-01-01"), F.col("y")), "m": F.col("f").cast("decimal(5,2)"),
        "z": F.timestamp_seconds(F.col("y")),
    })
    order = [F.col(c).asc() if isinstance(c, str) else c for c in SCAN_ORDERS[name]()]
    for keys in (["g"], []):
        want = df.withColumn("w", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        got = scan.scan(want, keys, order, number="n", count="c", chunk_rows=30)
        rows_ = got.collect()
        assert len(rows_) == 900 and all(r["n"] == r["w"] for r in rows_)
        assert all(r["c"] == (900 if not keys else sum(x[0] == r["g"] for x in rows)) for r in rows_[:50])
    if not name.startswith(("text f", "fraction")):
        placed = df.withColumn(scan.PLACE, scan.order_place(df, order))
        assert len(scan._bounds(placed, [], 30).first()["_bounds"]) > 200


def test_scan_is_one_plan_with_one_exchange(spark):
    df = spark.range(5000).select(F.pmod("id", F.lit(7)).alias("g"), "id")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    out = scan.scan(df, ["g"], [F.col("id").asc()], number="n", previous={"p": "id"})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(_chunk" in plan and "Write" not in plan and "SortMergeJoin" not in plan


def test_paths_with_unknown_parent_and_circle(spark):
    edges = [("n86", None), ("n865", "n86"), ("n8650", "n865"), ("n86505", "n8650"), ("x", "gone"), ("y", "x"), ("a", "b"), ("b", "a")]
    nodes = spark.createDataFrame([(i, p) for i, p in edges], "id string, parent string")
    got = {r["id"]: r["path"] for r in tree.paths(nodes).collect()}
    assert got["n86505"] == ["n86", "n865", "n8650", "n86505"]
    assert got["n86"] == ["n86"]
    assert got["x"] == ["x"] and got["y"] == ["y"] and got["a"] == ["a"] and got["b"] == ["b"]


def test_path_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(50)], "id bigint, parent bigint").selectExpr(
        "cast(id AS string) id", "cast(parent AS string) parent"
    )
    got = {r["id"]: r["path"] for r in tree.paths(nodes).collect()}
    assert got["49"] == [str(i) for i in range(50)]


def test_siblings(spark):
    rows = [(None, "s#n6", "Zeta"), (None, "s#n4", "Alpha"), ("s#n4", "s#n50", "B"), ("s#n4", "s#n30", "C"), ("s#n6", "s#n135", "Bad"), ("s#n6", "s#n131", "Alzey")]
    df = spark.createDataFrame(rows, "parent string, id string, label string")
    assert [r["id"] for r in order.sort_siblings(df).collect()] == ["s#n6", "s#n4", "s#n30", "s#n50", "s#n131", "s#n135"]


def test_reconcile_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 20
    titles = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 9))), rng.choice("ab")) for i in range(60)]
    cats = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 20))), rng.choice("ab")) for i in range(120)]
    a = spark.createDataFrame(titles, "r int, t string, p string")
    b = spark.createDataFrame(cats, "c int, t string, p string")
    got = {x["r"]: (x["c"], round(x["overlap"], 6), round(x["score"], 6)) for x in reconcile(a, b, "r", "t", "c", "t", {"p": 0.3}, 0.6).collect()}
    want = {}
    for r, t, p in titles:
        own = set(t.split())
        best = [
            (-(len(own & set(u.split())) / len(own) + (0.3 if p == q else 0)), c, len(own & set(u.split())) / len(own))
            for c, u, q in cats if len(own & set(u.split())) / len(own) >= 0.6 - 1e-9
        ]
        if best:
            s, c, o = min(best)
            want[r] = (c, round(o, 6), round(-s, 6))
    assert got == want


def test_reconcile_with_missing_properties_and_ties(spark):
    rng = random.Random(6)
    titles = [(i, rng.choice(["x", "x y", "x y z", "q", "", None, "y x"]), rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i in range(60)]
    cats = [(i, rng.choice(["x", "y x", "x y z w", "z", "", None]), rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i in range(50)]
    a = spark.createDataFrame(titles, "r int, t string, p string, q int")
    b = spark.createDataFrame(cats, "c int, t string, p string, q long")
    for weights in ({}, {"p": 0.25}, {"p": 0.25, "q": 0.5}, {"q": 0.0}):
        got = {x["r"]: (x["c"], x["overlap"], round(x["score"], 6)) for x in reconcile(a, b, "r", "t", "c", "t", weights, 0.5).collect()}
        want = {}
        for r, t, p, q in titles:
            own = set((t or "").split())
            pairs = []
            for c, u, p2, q2 in cats:
                share = len(own & set((u or "").split())) / len(own) if own else 0
                bonus = weights.get("p", 0) * (p is not None and p == p2) + weights.get("q", 0) * (q is not None and q == q2)
                if share >= 0.5:
                    pairs.append((-share - bonus, c, share))
            if pairs:
                want[r] = (min(pairs)[1], min(pairs)[2], round(-min(pairs)[0], 6))
        assert got == want
    with pytest.raises(ValueError):
        reconcile(a, b, "r", "t", "c", "t", {"p": -1.0})


def test_reconcile_of_one_frequent_word(spark):
    """4000 records and 4000 titles with the same word make some thousand pairs."""
    from stackfolio.operators.reconcile import Candidates

    a = spark.range(4000).select(F.col("id").alias("r"), F.lit("x").alias("t"), F.pmod("id", F.lit(7)).alias("p"))
    b = spark.range(4000).select(F.col("id").alias("c"), F.concat(F.lit("x w"), "id").alias("t"), F.pmod("id", F.lit(11)).alias("p"))
    assert Candidates(a, b, "r", "t", "c", "t", ["p"], 0.8).pairs().count() < 8000
    got = reconcile(a, b, "r", "t", "c", "t", {"p": 0.3}).collect()
    assert len(got) == 4000 and all(x["c"] == x["r"] % 7 and x["score"] == 1.3 for x in got)


def test_lookup_of_lists_keeps_empty_and_missing_lists(spark):
    df = spark.createDataFrame([(1, ["a", "x", "a"]), (2, []), (3, None)], "id int, v array<string>")
    got = {r["id"]: r["v"] for r in lookup.lookup_array(df, "id", "v", inline_lookup(spark, {"a": "A"})).collect()}
    assert got == {1: ["A", "x", "A"], 2: [], 3: None}
    gone = lookup.lookup_array(df, "id", "v", inline_lookup(spark, {"a": "A"}), "delete")
    assert {r["id"]: r["v"] for r in gone.collect()} == {1: ["A", "A"], 2: [], 3: None}


def test_vacuum(spark):
    df = spark.createDataFrame([("", ["", "a"], [""], ("", None))], "a string, b array<string>, c array<string>, d struct<x:string,y:string>")
    row = vacuum(df).collect()[0]
    assert (row["a"], row["b"], row["c"], row["d"]) == (None, ["a"], None, None)


def test_broader_places_add_headings_once(spark):
    df = spark.createDataFrame([(1, ["p", "q"], ["p"]), (2, ["q"], None), (3, ["z"], ["h"])], "id int, places array<string>, headings array<string>")
    broader = inline_lookup(spark, {"p": "n30 ; n31", "q": "n31"})
    got = {r["id"]: (r["places"], r["headings"]) for r in lookup.broaden_places(df, "id", "places", "headings", broader, "n3[01]").collect()}
    assert got == {1: (["n30", "n31"], ["q", "p"]), 2: (["n31"], ["q"])}


def test_places_are_repaired_only_if_the_node_exists(spark):
    df = spark.createDataFrame([(1, ["_r19_ _00S1_", "k"]), (2, ["_r19_ _00S2_"])], "id int, places array<string>")
    nodes = spark.createDataFrame([("https://example.org/spatial#n00S1",)], "id string")
    got = repairs.repair_places(df, "id", "places", nodes).collect()
    assert [(r["id"], r["places"]) for r in got] == [(1, ["https://example.org/spatial#n00S1", "k"])]


def test_several_parents(spark):
    edges = spark.createDataFrame([("9", "c"), ("10", "c"), ("1", "d")], "parent string, id string")
    got = {(r["parent"], r["id"]) for r in sets.dedupe_across_parents(edges, "parent", "id", F.col("parent").cast("int")).collect()}
    assert got == {("10", "c"), ("1", "d")}


SCHEMA = "id string, version bigint, title string, op string"
LOG = [
    [("a", 1, "A1", "put"), ("b", 2, "B2", "put"), ("a", 3, "A3", "put")],
    [("b", 4, None, "delete"), ("c", 6, "C6", "put"), ("a", 2, "late", "put")],
    [("b", 3, "late put", "put"), ("c", 5, "late", "put"), ("d", 7, "D7", "put")],
]


def test_stream_equals_batch(spark, tmp_path):
    """Three micro-batches, late and deleted versions among them, give the table of the batch job."""
    folder = str(tmp_path / "log")
    for part in LOG:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    whole = spark.read.parquet(folder)
    batch = {tuple(r) for r in changes.apply_changes(None, whole, "id", "version").select("id", "version", "title").collect()}
    root = str(tmp_path / "target")
    upsert_stream(read_log(spark, folder, schema, 1), root, "t", "id", "version", str(tmp_path / "state")).awaitTermination()
    live = live_records(read_snapshot(spark, root, "t")).select("id", "version", "title")
    assert {tuple(r) for r in live.collect()} == batch == {("a", 3, "A3"), ("c", 6, "C6"), ("d", 7, "D7")}
    ids = {r["id"] for r in replay_dedupe(spark, folder, schema, "id").collect()}
    assert ids == {"a", "b", "c", "d"}


def test_paths_of_any_depth(spark):
    """A chain of 1000 nodes has 1000 whole paths; circles and what hangs on them have themselves."""
    from stackfolio.operators.tree import paths

    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(1000)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e")]
    found = {r["id"]: r["path"] for r in paths(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert found["n999"] == [f"n{i}" for i in range(1000)]
    assert all(len(found[f"n{i}"]) == i + 1 for i in range(1000))
    assert all(found[x] == [x] for x in "abcde")


def test_rebuild_keeps_all_values(spark):
    from stackfolio.operators.shape import rebuild

    triples = spark.createDataFrame([("1", "p", "b"), ("1", "p", "a"), ("2", "q", "x")], "s string, p string, o string")
    assert {r["s"]: (r["p"], r["q"]) for r in rebuild(triples, ["p", "q"]).collect()} == {"1": (["a", "b"], []), "2": ([], ["x"])}


def test_upserts_onto_a_loaded_base_and_with_a_new_checkpoint(spark, tmp_path):
    from stackfolio.sinks import swap_snapshot

    root, folder = str(tmp_path / "target"), str(tmp_path / "log")
    swap_snapshot(spark.createDataFrame([("a", 1, "A1", "put"), ("z", 1, "Z1", "put")], SCHEMA), root, "t")
    for n, part in enumerate(LOG):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        schema = spark.read.parquet(folder).schema
        for _ in range(2):  # the second run repeats all batches under another checkpoint
            state = str(tmp_path / f"state-{n}-{_}")
            upsert_stream(read_log(spark, folder, schema, 1), root, "t", "id", "version", state).awaitTermination()
    live = live_records(read_snapshot(spark, root, "t")).select("id", "version", "title")
    assert {tuple(r) for r in live.collect()} == {("a", 3, "A3"), ("c", 6, "C6"), ("d", 7, "D7"), ("z", 1, "Z1")}


@pytest.mark.parametrize("query", ["", "*", "+la -de", "la OR x", "d*", "la AND un", "-de", "la de", "un~", "-la OR d*"])
def test_index_answers_as_the_scan(spark, query):
    from stackfolio.operators import search

    df = spark.createDataFrame([(1, "la vie de Un"), (2, "x y"), (3, "de"), (4, "La Un"), (5, "dada")], "id long, t string")
    scan = {r["id"] for r in df.where(search.has_all_terms(F.col("t"), query)).collect()}
    assert {r["rec_id"] for r in search.search_index(search.token_index(df, "id", "t"), query).collect()} == scan


@pytest.mark.parametrize("query", ['"la vie"', "title:la", "(la OR de)"])
def test_unsupported_queries_are_refused(query):
    from stackfolio.operators.search import has_all_terms

    with pytest.raises(ValueError):
        has_all_terms(F.col("t"), query)


def test_double_keys_do_not_multiply_rows(spark):
    from stackfolio.operators.lookup import lookup

    table = spark.createDataFrame([("a", "1", 0), ("a", "2", 1)], "k string, v string, o int")
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert sorted(r["x"] for r in lookup(df, "x", table).collect()) == ["2", "b"]


INDEXED = [
    (1, "La vie de Un", "s1 the"), (2, "x y", None), (3, "de", "la"), (4, "La Un la vie; la vie", "s2"), (5, "dada", "s1"), (6, None, ""),
    (7, "vie la", "LA VIE"), (8, "", None), (9, "un-deux trois", "s2 un deux"),
]
ANSWERS = {
    "": {1, 2, 3, 4, 5, 6, 7, 8, 9}, "*": {1, 2, 3, 4, 5, 6, 7, 8, 9}, "la vie": {1, 4, 7}, '"la vie"': {1, 4, 7}, 'text:"la vie"': {1, 4},
    '"vie la vie"': {4}, "title:la": {3, 7}, "-title:la": {1, 2, 4, 5, 6, 8, 9}, "(la OR de) AND -(un OR title:la)": set(), "+la -de": {4, 7},
    "title:(s1 OR s2) un": {1, 4, 9}, "d*": {1, 3, 5, 9}, "text:d* title:s1": {1, 5}, "un-deux*": {9}, '"un deux" -trois': set(),
    "(vie AND (de OR un)) OR dada": {1, 4, 5}, "NOT (la OR de OR un)": {2, 5, 6, 8}, "la AND": {1, 3, 4, 7}, "title:s1 -*": set(),
    '"trois deux"': set(), 'title:"la vie" OR x': {2, 7}, '""': {1, 2, 3, 4, 5, 6, 7, 8, 9},
}


@pytest.fixture(scope="module")
def index_at_rest(spark, tmp_path_factory):
    from stackfolio.operators import positions

    path = str(tmp_path_factory.mktemp("index") / "i")
    df = spark.createDataFrame(INDEXED, "id long, text string, title string").repartition(3)
    positions.write_index(df, path, "id", {"text": "text", "title": "title"})
    return df, path


@pytest.mark.parametrize("query", list(ANSWERS))
def test_positional_index_and_scan(spark, index_at_rest, query):
    from stackfolio.operators import positions

    df, path = index_at_rest
    scan = {r["id"] for r in df.where(positions.answers({"text": F.col("text"), "title": F.col("title")}, query)).collect()}
    assert scan == ANSWERS[query]
    found = [r["rec_id"] for r in positions.search_at_rest(spark, path, query, ["text", "title"]).collect()]
    assert sorted(found) == sorted(ANSWERS[query])


@pytest.mark.parametrize("query", ["(la", "la)", '"la', "title:", "other:la", "(a OR NOT)"])
def test_queries_that_cannot_be_read(query):
    from stackfolio.operators import positions

    with pytest.raises(ValueError):
        positions.answers({"title": F.col("t")}, query)


def test_a_search_reads_the_files_of_its_words(spark, tmp_path):
    """A token of all records stands in many files; a rare word's search opens one."""
    import pyarrow.parquet as pq

    from stackfolio.operators import positions

    path = str(tmp_path / "i")
    df = spark.range(3000).select("id", F.concat(F.lit("all w"), F.col("id"), F.lit(" all")).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        positions.write_index(df, path, "id", {"t": "t"})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = lambda word, prefix=False: len(positions.parts_of(spark, path, [positions.Term((word,), None, prefix)]))
    whole = len(spark.read.parquet(f"{path}/postings").inputFiles())
    assert files("w7") == 1 and files("none") <= 1 and files("zzz") == 0 and 1 < files("all") < whole == 8 and 1 < files("w", True) < 8
    plan = positions.postings_of(spark, path, [positions.Term(("w7",))])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part#", plan) and re.search(r"PushedFilters: \[[^]]*EqualTo\(token,w7\)", plan)
    some = next((tmp_path / "i" / "postings").rglob("part-*.parquet"))
    columns = pq.ParquetFile(some).metadata.row_group(0)
    coded = {columns.column(i).path_in_schema: columns.column(i).encodings for i in range(columns.num_columns)}
    assert "DELTA_BINARY_PACKED" in coded["positions.list.element"] and "DELTA_BINARY_PACKED" in coded["rec_id"]


def test_double_keys_in_all_lookups(spark):
    """One row stays one row, whichever lookup meets a key twice; the last by reading order wins where it is given."""
    from stackfolio.operators import lookup
    from stackfolio.plans import persons

    table = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("c", "9", 0)], "k string, v string, o int")
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    found = lookup.lookup_any(df, "x", [table.where("k = 'z'"), table], "y").collect()
    assert sorted((r["x"], r["y"]) for r in found) == [("a", "2"), ("b", None)]
    wide = spark.createDataFrame([("a", "1", "p", 1), ("a", "2", "q", 0), ("b", None, "r", 0)], "k string, v string, w string, o int")
    found = lookup.lookup_wide(df, "x", wide, "k", ["v", "w"]).collect()
    assert sorted((r["x"], r["v"], r["w"]) for r in found) == [("a", "1", "p"), ("b", None, "r")]
    uri = spark.createDataFrame([("http://a", "A"), ("http://a", "B")], "k string, v string")
    refs = spark.createDataFrame([("p1", "born", 0, "http://a")], "local_id string, role string, pos int, value string")
    assert [r["label"] for r in persons.place_labels(refs, uri, uri).collect()] == ["B"]
    names = spark.createDataFrame([("11", "N"), ("11", "M")], "k string, label string")
    people = spark.createDataFrame([("p1", ["http://x/11"])], "local_id string, related_person array<string>")
    assert [r["label"] for r in persons.related_labels(people, names, uri).collect()] == ["N"]


def test_points_within_areas(spark):
    """Random rings, among them self-crossing, tiny, huge and flat ones, against the crossing test of each pair."""
    from stackfolio.operators.areas import within_areas

    rng = random.Random(8)
    rings = {}
    for k in range(60):
        size, y, x = 10 ** rng.uniform(-4, 2), rng.uniform(-50, 50), rng.uniform(-50, 50)
        rings[k] = [(y + size * rng.uniform(-1, 1), x + size * rng.uniform(-1, 1)) for _ in range(rng.randrange(3, 9))]
    rings |= {90: [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], 91: [(1.0, 1.0)], 92: [], 93: [(1.0, 1.0)] * 4, 94: [(0.0, 0.0), (0.0, 5.0), (0.0, 9.0)]}
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(500)]
    points += [(1000 + 20 * k + j, y + rng.uniform(-1, 1) * 10 ** -j, x + rng.uniform(-1, 1) * 10 ** -j) for k, ring in rings.items() for y, x in ring[:1] for j in range(6)]
    points += [(5000 + i, float(i % 5 * 2), float(i // 5 * 2)) for i in range(25)]  # corners, sides and cell borders

    def inside(y, x, ring):
        odd = False
        for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], *ring[:1]]):
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return odd

    want = {(i, k) for i, y, x in points for k, ring in rings.items() if inside(y, x, ring)}
    areas = spark.createDataFrame(list(rings.items()), "k int, ring array<struct<lat: double, lon: double>>")
    df = spark.createDataFrame([*points, (9999, None, 1.0)], "i int, y double, x double")
    got = within_areas(df, "y", "x", areas, "k", "ring")
    assert {(r["i"], r["area"]) for r in got.collect()} == want and len(want) > 150
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert within_areas(df, "y", "x", areas.limit(0), "k", "ring").count() == 0
