"""Tables at rest that several writers may change: commits, and rows kept by key.

A table is a folder with a file for each commit (``steps/000000000007.json``: what the table consists of
now) and the Parquet parts that the commits name. A writer writes its parts first, reads the newest
commit, and creates the next one only if nobody else has; if somebody has, it looks again. So commits
follow one another, none is lost, a reader sees one of them whole, and a writer that dies leaves nothing
but parts without a name.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
GONE = "_gone"
BUCKETS = 32
FOLD_SHARE = 0.5  # deltas with this share of their bucket's rows are folded into its base
FOLD_DELTAS = 16  # so many small deltas of a bucket become one


def _path(spark: SparkSession, path: str):
    """Path and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.exists(hadoop)


def _steps(root: str, name: str) -> str:
    return f"{root}/{name}/steps"


def newest_commit(spark: SparkSession, root: str, name: str) -> tuple[int, dict] | None:
    """Number and contents of the newest commit."""
    folder, fs = _path(spark, _steps(root, name))
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    names = [n for n in names if n[:-5].isdigit() and n.endswith(".json")]
    if not names:
        return None
    stream = fs.open(_path(spark, f"{_steps(root, name)}/{max(names)}")[0])
    try:
        return int(max(names)[:-5]), json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _create(spark: SparkSession, root: str, name: str, step: int, state: dict) -> bool:
    """Create the commit ``step`` whole, or not at all if it is there."""
    target, fs = _path(spark, f"{_steps(root, name)}/{step:012d}.json")
    draft, _ = _path(spark, f"{_steps(root, name)}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(json.dumps(state).encode())
    stream.close()
    if fs.getUri().getScheme() != "file":
        return not fs.exists(target) and fs.rename(draft, target)  # a rename does not replace
    try:  # a local rename would replace, a link does not
        os.link(draft.toUri().getPath(), target.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(draft, False)


def commit(spark: SparkSession, root: str, name: str, change: Callable[[dict | None], dict | None]) -> dict | None:
    """Change a table from its newest commit; ``change`` runs again when another writer came first.

    It gets None for a table without a commit, and gives None if there is nothing to do any more.
    """
    while True:
        newest = newest_commit(spark, root, name)
        state = change(newest and newest[1])
        if state is None or _create(spark, root, name, newest[0] + 1 if newest else 0, state):
            return state


class KeyedTable:
    """Newest version of each key, in hash buckets of the key.

    A batch is written as a small delta: a file for each bucket that it touches. Readers take the base
    rows of the buckets without deltas as they are, and the newest version of each key in the others.
    ``fold`` writes new bases for the buckets whose deltas have grown to a share of them, so that what a
    batch costs, folding included, follows the batch and not the table. Deleted keys stay as markers
    (``_gone``) with their version, so that late rows cannot bring them back.

    A table that was written whole (``write_whole``) becomes the base at the first delta. Columns that
    come later are null in older rows.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, key: str, version: str, buckets: int = BUCKETS):
        self.spark, self.root, self.name = spark, root, name
        self.key, self.version, self.buckets = key, version, buckets

    def _write(self, df: DataFrame, buckets: int) -> tuple[str, dict[str, int]]:
        """Write rows as a part; its name and the rows of each of its buckets."""
        part = uuid.uuid4().hex
        path = f"{self.root}/{self.name}/data/part={part}"
        dealt = df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(path)
        found = self.spark.read.schema(f"{BUCKET} int").parquet(path)
        return part, {str(r[0]): r[1] for r in found.groupBy(BUCKET).count().collect()}

    def _whole_as_base(self) -> None:
        """Deal a table that was written whole, or an empty one, into buckets."""
        while (newest := newest_commit(self.spark, self.root, self.name)) is None or "buckets" not in newest[1]:
            state = {"key": self.key, "version": self.version, "buckets": self.buckets, "base": {}, "deltas": {}, "sizes": {}, "schema": None}
            if newest is not None:
                rows = read_table(self.spark, self.root, self.name)
                rows = rows if GONE in rows.columns else rows.withColumn(GONE, F.lit(False))
                part, sizes = self._write(rows, self.buckets)
                state |= {"base": {b: [part, n] for b, n in sizes.items()}, "sizes": {part: len(sizes)}, "schema": rows.schema.jsonValue()}
            if commit(self.spark, self.root, self.name, lambda now: state if now == (newest and newest[1]) else None):
                return

    def append(self, rows: DataFrame) -> list[str]:
        """Add a batch with one row a key, ``_gone`` included; the buckets that it touches."""
        while True:
            self._whole_as_base()
            _, state = newest_commit(self.spark, self.root, self.name)
            part, sizes = self._write(rows, state["buckets"])

            def change(now: dict) -> dict | None:
                if now.get("buckets") != state["buckets"]:
                    return None  # written whole meanwhile
                now["schema"] = _both_schemas(now["schema"], rows.schema)
                now["sizes"][part] = len(sizes)
                for bucket, n in sizes.items():
                    now["deltas"].setdefault(bucket, []).append([part, n])
                return now

            if not sizes or commit(self.spark, self.root, self.name, change):
                return list(sizes)

    def fold(self, share: float = FOLD_SHARE, deltas: int = FOLD_DELTAS) -> list[str]:
        """Fold deltas into bases where they are due; where many are small, fold them into one delta."""
        newest = newest_commit(self.spark, self.root, self.name)
        if newest is None or "buckets" not in newest[1]:
            return []
        state = newest[1]
        small, due = [], []
        for bucket, parts in state["deltas"].items():
            if sum(n for _, n in parts) >= share * state["base"].get(bucket, [None, 0])[1]:
                due.append(bucket)
            elif len(parts) >= deltas:
                small.append(bucket)
        for chosen, with_base in ((due, True), (small, False)):
            if chosen:
                part, sizes = self._write(_merged(self.spark, self.root, self.name, state, chosen, with_base), state["buckets"])

                def change(now: dict) -> dict | None:
                    # another writer may have added deltas; where it folded, this work is not wanted
                    same = [
                        b for b in chosen
                        if "buckets" in now and now["base"].get(b) == state["base"].get(b) and now["deltas"].get(b, [])[: len(state["deltas"][b])] == state["deltas"][b]
                    ]
                    for b in same:
                        later = now["deltas"].pop(b)[len(state["deltas"][b]) :]
                        if with_base:
                            now["base"][b] = [part, sizes[b]]
                        else:
                            later = [[part, sizes[b]], *later]
                        if later:
                            now["deltas"][b] = later
                    now["sizes"][part] = len(sizes)
                    named = {p for p, _ in now["base"].values()} | {p for ps in now["deltas"].values() for p, _ in ps}
                    now["sizes"] = {p: n for p, n in now["sizes"].items() if p in named}
                    return now if same else None

                commit(self.spark, self.root, self.name, change)
        return due + small

    def read(self) -> DataFrame | None:
        return read_table(self.spark, self.root, self.name)


def _both_schemas(old: dict | None, new: StructType) -> dict:
    fields = {f["name"]: f for f in (old or {"fields": []})["fields"]}
    for field in new.jsonValue()["fields"]:
        known = fields.setdefault(field["name"], field)
        if known["type"] != field["type"]:
            raise ValueError(f"column {field['name']}: {field['type']} in a table with {known['type']}")
    return {"type": "struct", "fields": [f | {"nullable": True} for f in fields.values()]}


def _rows(spark: SparkSession, root: str, name: str, state: dict, parts: dict[str, list[str]]) -> DataFrame | None:
    """Rows of parts, of the given buckets only: other folders are not listed."""
    data = f"{root}/{name}/data"
    paths = []
    for part, buckets in parts.items():
        whole = len(buckets) == state["sizes"][part]
        paths += [f"{data}/part={part}"] if whole else [f"{data}/part={part}/{BUCKET}={b}" for b in buckets]
    if not paths:
        return None
    schema = StructType.fromJson(state["schema"])
    return spark.read.schema(schema).option("basePath", data).parquet(*paths).select(*schema.names)


def _by_part(pairs) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for part, bucket in pairs:
        out.setdefault(part, []).append(bucket)
    return out


def _merged(spark: SparkSession, root: str, name: str, state: dict, buckets: list[str], with_base: bool = True) -> DataFrame:
    """Newest row of each key of the buckets: one partial aggregate over base and deltas."""
    pairs = [(p, b) for b in buckets for p, _ in state["deltas"][b]]
    if with_base:
        pairs += [(state["base"][b][0], b) for b in buckets if b in state["base"]]
    rows = _rows(spark, root, name, state, _by_part(pairs))
    rows = rows.withColumn(GONE, F.coalesce(GONE, F.lit(False)))
    key, version = state["key"], state["version"]
    rest = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row")).select(key, "_row.*")
    return newest.select(*rows.columns)


def write_whole(df: DataFrame, root: str, name: str, version: str | None = None) -> str:
    """Write all rows afresh, then commit them. The same version may be written again."""
    spark = df.sparkSession
    version = version or uuid.uuid4().hex
    path = f"{root}/{name}/v-{version}"
    df.write.mode("overwrite").parquet(path)
    commit(spark, root, name, lambda now: {"whole": version})
    return path


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The newest commit's rows; None if there is none, or none that has rows or columns."""
    newest = newest_commit(spark, root, name)
    if newest is None:
        return None
    state = newest[1]
    if "whole" in state:
        return spark.read.parquet(f"{root}/{name}/v-{state['whole']}")
    if state["schema"] is None:
        return None
    clean = _rows(spark, root, name, state, _by_part((p, b) for b, (p, _) in state["base"].items() if b not in state["deltas"]))
    if not state["deltas"]:
        return clean
    merged = _merged(spark, root, name, state, list(state["deltas"]))
    return merged if clean is None else clean.unionByName(merged)


def unused_parts(spark: SparkSession, root: str, name: str) -> list[str]:
    """Parts that the newest commit does not name. Some may belong to a writer or reader at work, so
    removing the older ones is left to the caller."""
    newest = newest_commit(spark, root, name)
    folder, fs = _path(spark, f"{root}/{name}/data")
    if newest is None or not fs.exists(folder):
        return []
    named = set(newest[1].get("sizes", {}))
    found = [s.getPath().toString() for s in fs.listStatus(folder)]
    return sorted(p for p in found if p.rpartition("part=")[2] not in named)
