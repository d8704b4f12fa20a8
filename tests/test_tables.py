"""Commits of several writers, and rows kept by key."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stackfolio.operators.changes import apply_changes, final_versions
from stackfolio.sinks import read_snapshot, swap_snapshot
from stackfolio.streaming.changes import live_records, read_log, stream_dedupe
from stackfolio.tables import KeyedTable, commit, newest_commit, unused_parts, write_whole

SCHEMA = "id long, version long, title string, op string"


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("part-*.parquet")}


def batch(spark, rows):
    return final_versions(spark.createDataFrame(rows, SCHEMA), "id", "version")


def test_two_writers_lose_no_version(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(3).cache()
    wrong = []

    def write(w):
        try:
            for i in range(4):
                swap_snapshot(df, root, "s", f"{w}-{i}")
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not wrong
    steps = sorted(p.name for p in (tmp_path / "s" / "steps").glob("*.json"))
    assert steps == [f"{i:012d}.json" for i in range(8)]
    found = [p.read_text() for p in sorted((tmp_path / "s" / "steps").glob("*.json"))]
    assert sorted(found) == sorted(f'{{"whole": "{w}-{i}"}}' for w in "ab" for i in range(4))
    for w in "ab":
        assert [f for f in found if f'"{w}-' in f] == [f'{{"whole": "{w}-{i}"}}' for i in range(4)]
    assert read_snapshot(spark, root, "s").count() == 3


def test_a_commit_is_tried_again(spark, tmp_path):
    seen = []

    def change(now):
        seen.append(now)
        if len(seen) == 1:
            commit(spark, str(tmp_path), "t", lambda _: {"by": "another"})
        return {"by": "me"}

    commit(spark, str(tmp_path), "t", change)
    assert seen == [None, {"by": "another"}] and newest_commit(spark, str(tmp_path), "t") == (1, {"by": "me"})


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """Against ``apply_changes``: late, repeated and deleted rows, a new column, folding in between."""
    root = str(tmp_path)
    base = spark.range(2000).select("id", F.lit(1).cast("long").alias("version"), F.concat(F.lit("b"), "id").alias("title"))
    write_whole(base, root, "t")
    table = KeyedTable(spark, root, "t", "id", "version", buckets=8)
    log, touched = [], []
    for n in range(12):
        rows = [(n, 10 + n, f"t{n}", "put"), (n - 1, 5, "late", "put"), (1990 + n % 3, 20 + n, None, "delete")]
        for _ in range(2):
            before = files(root)
            buckets = table.append(batch(spark, rows))
            after = files(root)
            if before and n:
                assert all(after[f] == t for f, t in before.items())
                assert len(after) - len(before) == len(buckets) <= 3
                touched += buckets
        log += rows
        if n == 6:
            assert table.fold(deltas=4) and table.fold(deltas=4) == []
            assert any(len(p) == 1 and p[0][1] > 1 for p in newest_commit(spark, root, "t")[1]["deltas"].values())
        want = apply_changes(base, spark.createDataFrame(log, SCHEMA), "id", "version")
        if n in (0, 5, 6, 11):
            got = live_records(table.read())
            columns = ["id", "version", "title"]
            assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())
    assert len(set(touched)) > 1
    extra = batch(spark, [(5, 99, "new", "put")]).withColumn("note", F.lit("n"))
    table.append(extra)
    found = {r["id"]: r["note"] for r in table.read().where("id IN (5, 700)").collect()}
    assert found == {5: "n", 700: None}
    with pytest.raises(ValueError):
        table.append(batch(spark, [(5, 99, "new", "put")]).withColumn("note", F.lit(1)))
    named = unused_parts(spark, root, "t")
    assert named and all(p.split("part=")[-1] not in newest_commit(spark, root, "t")[1]["sizes"] for p in named)


def test_folding_costs_what_the_batches_cost(spark, tmp_path):
    """Rows written by 20 batches, folding included, are far fewer than 20 snapshots."""
    root = str(tmp_path)
    write_whole(spark.range(4000).select("id", F.lit(1).cast("long").alias("version"), F.lit("b").alias("title"), F.lit("put").alias("op")), root, "t")
    table = KeyedTable(spark, root, "t", "id", "version", buckets=4)
    for n in range(20):
        table.append(batch(spark, [(100 * n + i, 2 + n, "x", "put") for i in range(100)]))
        table.fold()
    written = spark.read.parquet(f"{root}/t/data").count()
    assert table.read().count() == 4000 and table.read().where("title = 'x'").count() == 2000
    assert written < 4000 + 20 * 100 * 5


def test_a_fold_keeps_deltas_that_came_meanwhile(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    table = KeyedTable(spark, root, "t", "id", "version", buckets=1)
    table.append(batch(spark, [(1, 1, "a", "put"), (2, 1, "b", "put")]))
    write, other = table._write, KeyedTable(spark, root, "t", "id", "version")
    meanwhile = []

    def slow(rows, buckets):
        out = write(rows, buckets)
        while meanwhile:
            meanwhile.pop()()
        return out

    monkeypatch.setattr(table, "_write", slow)
    meanwhile.append(lambda: other.append(batch(spark, [(1, 2, "a2", "put")])))
    assert table.fold() == ["0"]
    state = newest_commit(spark, root, "t")[1]
    assert len(state["deltas"]["0"]) == 1 and state["base"]["0"][1] == 2
    meanwhile.append(other.fold)  # the other one folds first: this fold is not committed
    step = newest_commit(spark, root, "t")[0]
    table.fold()
    assert newest_commit(spark, root, "t")[0] == step + 1 and not newest_commit(spark, root, "t")[1]["deltas"]
    assert {r["id"]: r["title"] for r in table.read().collect()} == {1: "a2", 2: "b"}
    assert table.append(batch(spark, [])) == []


def test_first_arrivals_without_state(spark, tmp_path):
    """Eight micro-batches with many repeated ids, and all of them again: one row an id, no state kept."""
    folder, target = str(tmp_path / "log"), str(tmp_path / "target")
    seen = {}
    for n in range(8):
        rows = [((n * 37 + 11 * i) % 150 if i % 9 else None, n, f"t{n}-{i}", "put") for i in range(120)]
        for r in rows:
            seen.setdefault(r[0], n)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    for again in range(2):
        query = stream_dedupe(read_log(spark, folder, schema, 1), "id", target, str(tmp_path / f"state{again}"), buckets=4)
        query.awaitTermination()
        assert len(query.recentProgress) >= 8 and not any(p["stateOperators"] for p in query.recentProgress)
        got = spark.read.schema(schema).parquet(target).select("id", "version").collect()
        assert len(got) == len(seen) - 1 and {r["id"] for r in got} == set(seen) - {None}
