"""Run queries and their SQL twins side by side: ``python check_oracle.py [sf] [name …]``."""

from __future__ import annotations

import hashlib
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from stackfolio.queries import QUERIES
from stackfolio.queries.registry import NAMES

ROOT = "/root/testdata"


def session(cores: str = "8", partitions: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(columns: list[str], rows) -> tuple[int, str, list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v) -> str:
        if v is None:
            return "∅"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(v)

    lines = sorted("\x1f".join(cell(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.md5("\x1e".join(lines).encode()).hexdigest(), lines


def connection(folder: str):
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    q = QUERIES[name]
    start = time.time()
    df = q(spark, folder)
    got = canonical(df.columns, df.collect())
    spent = time.time() - start
    if q.sql is None:
        return got[0] > 0, f"{name}: {got[0]} rows, no SQL ({spent:.1f}s)"
    start = time.time()
    rel = con.sql(q.sql)
    want = canonical(list(rel.columns), rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"{name}: columns {sorted(df.columns)} <> {sorted(rel.columns)}"
    if got[:2] == want[:2]:
        return got[0] > 0, f"{name}: {got[0]} rows equal ({spent:.1f}s, sql {time.time() - start:.1f}s)"
    left, right = set(got[2]), set(want[2])
    some = [x.replace("\x1f", " | ")[:400] for x in sorted(left - right)[:2]]
    other = [x.replace("\x1f", " | ")[:400] for x in sorted(right - left)[:2]]
    return False, f"{name}: {got[0]} rows <> {want[0]}\n   columns {sorted(df.columns)}\n   spark only: {some}\n   sql only: {other}"


def main(args: list[str]) -> int:
    sf = args[0] if args else "0.001"
    folder = f"{ROOT}/sf{sf}"
    names = args[1:] or list(QUERIES)
    spark, con = session(), connection(folder)
    bad = []
    for name in names:
        try:
            good, message = compare(spark, con, folder, name)
        except Exception as error:  # report and go on
            good, message = False, f"{name}: {type(error).__name__}: {str(error)[:1200]}"
        print(("ok   " if good else "FAIL ") + message, flush=True)
        if not good:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} good; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
