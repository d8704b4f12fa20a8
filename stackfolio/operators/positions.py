"""Search with phrases, fields and brackets: a positional index at rest, and the same by a scan.

The index is a folder. ``postings`` has one row per (token, field, record) with the rising positions of
the token in the field; rows are dealt by ranges of (token, record), so a token of most records spreads
over many files, and a word's files are known from ``ranges``, which has one row per range. A search
reads the ranges of its words only. ``records`` has the ids of all records, for queries that a record
without any of the words can answer.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import rows_of
from ..functions.text import words
from .search import query_terms

# Positions and ids rise within a file, so they are written as differences.
DELTA_CODED = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#positions.list.element": "false",
    "parquet.enable.dictionary#rec_id": "false",
}
SIGNS = re.compile(r'\s+|(?P<open>\()|(?P<close>\))|(?P<sign>[+-](?=[^\s)]))|(?P<field>[\w.]+):(?=\S)|"(?P<phrase>[^"]*)"|(?P<word>[^\s()":]+)|(?P<wrong>.)')


class Term(NamedTuple):
    """A word, or several one after another; ``prefix``: any word that starts like it."""

    words: tuple[str, ...]
    field: str | None = None
    prefix: bool = False


class Not(NamedTuple):
    part: object


class All(NamedTuple):
    """All parts hold; without parts: everything."""

    parts: tuple


class Any(NamedTuple):
    parts: tuple


def parsed(query: str):
    """A query as a tree of ``Term``, ``Not``, ``All`` and ``Any``.

    Words beside each other must all be there; ``OR`` binds less than ``AND``; ``-`` and ``NOT`` forbid;
    ``*`` at the end of a word is open; ``"…"`` is a phrase, as are the parts of a word with signs in it;
    ``field:`` holds for a word, phrase or bracket. ``*`` alone and an empty query ask for everything.
    """
    plain = query_terms(query)
    if plain is not None:
        return All(tuple(Term((w,)) for w in dict.fromkeys(w for term in plain for w in re.findall(r"[^\W_]+", term))))
    marks = [m for m in SIGNS.finditer(query) if m.lastgroup]
    if any(m.lastgroup == "wrong" for m in marks):
        raise ValueError(f"a quote or colon without its other part: {query!r}")
    place = 0

    def ahead() -> tuple[str | None, str]:
        if place == len(marks):
            return None, ""
        return marks[place].lastgroup, marks[place][marks[place].lastgroup]

    def either(field: str | None):
        nonlocal place
        parts = [together(field)]
        while ahead() == ("word", "OR"):
            place += 1
            parts.append(together(field))
        return parts[0] if len(parts) == 1 else Any(tuple(parts))

    def together(field: str | None):
        nonlocal place
        parts = []
        while ahead()[0] not in (None, "close") and ahead() != ("word", "OR"):
            if ahead() in (("word", "AND"), ("sign", "+")):
                place += 1
            else:
                parts.append(one(field))
        return parts[0] if len(parts) == 1 else All(tuple(p for p in parts if p != All(())))

    def one(field: str | None):
        nonlocal place
        kind, value = ahead()
        place += 1
        if kind == "sign" or (kind, value) == ("word", "NOT"):
            if ahead()[0] in (None, "close"):
                raise ValueError(f"nothing after {value}: {query!r}")
            return one(field) if value == "+" else Not(one(field))
        if kind == "field":
            return one(value)
        if kind == "open":
            inner = either(field)
            if ahead()[0] != "close":
                raise ValueError(f"a bracket is not closed: {query!r}")
            place += 1
            return inner
        if kind not in ("word", "phrase"):
            raise ValueError(f"nothing where a word is expected: {query!r}")
        found = tuple(w.lower() for w in re.findall(r"[^\W_]+", value))
        prefix = kind == "word" and value.endswith("*") and len(found) == 1
        return Term(found, field, prefix) if found else All(())

    tree = either(None)
    if place < len(marks):
        raise ValueError(f"a bracket is not opened: {query!r}")
    return tree


def terms_of(tree) -> list[Term]:
    if isinstance(tree, Term):
        return [tree]
    parts = [tree.part] if isinstance(tree, Not) else tree.parts
    return list(dict.fromkeys(t for p in parts for t in terms_of(p)))


def _condition(tree, test: Callable[[Term], object], yes, no):
    """The tree with its terms tested: over columns, or over truth values."""
    if isinstance(tree, Term):
        return test(tree)
    if isinstance(tree, Not):
        return ~_condition(tree.part, test, yes, no)
    parts = [_condition(p, test, yes, no) for p in tree.parts]
    return reduce(lambda a, b: a & b, parts, yes) if isinstance(tree, All) else reduce(lambda a, b: a | b, parts, no)


class _Truth:
    """A truth value with the operators of a column."""

    def __init__(self, value: bool):
        self.value = value

    def __and__(self, other):
        return _Truth(self.value and other.value)

    def __or__(self, other):
        return _Truth(self.value or other.value)

    def __invert__(self):
        return _Truth(not self.value)

    def __bool__(self):
        return self.value


def without_any_word(tree) -> bool:
    """Whether a record with none of the words answers the query."""
    return bool(_condition(tree, lambda _: _Truth(False), _Truth(True), _Truth(False)))


def _known(tree, fields) -> None:
    unknown = {t.field for t in terms_of(tree)} - {None, *fields}
    if unknown:
        raise ValueError(f"no fields {sorted(unknown)}: there are {sorted(fields)}")


def answers(fields: dict[str, Column], query: str) -> Column:
    """The record answers the query, by reading its texts; each text is split once."""
    tree = parsed(query)
    _known(tree, fields)
    # the words of a field between blanks: a word, a phrase and the start of a word are parts of it
    line = lambda text: F.concat(F.lit(" "), F.array_join(words(F.coalesce(text, F.lit(""))), " "), F.lit(" "))
    record = F.struct(*[line(text).alias(name) for name, text in fields.items()])

    def test(row: Column, term: Term) -> Column:
        wanted = " " + " ".join(term.words) + ("" if term.prefix else " ")
        return reduce(lambda a, b: a | b, [row[f].contains(wanted) for f in fields if term.field in (None, f)])

    return F.exists(F.array(record), lambda row: _condition(tree, lambda t: test(row, t), F.lit(True), F.lit(False)))


def write_index(df: DataFrame, path: str, id_col: str, fields: dict[str, str]) -> None:
    """Index the columns ``fields`` (field name → column); ids are unique and not NULL."""
    spark = df.sparkSession

    def placed_words(field: str, column: str) -> Column:
        one = lambda w, i: F.struct(F.lit(field).alias("field"), i.alias("pos"), w.alias("token"))
        return F.transform(words(F.coalesce(F.col(column), F.lit(""))), one)

    listed = F.flatten(F.array(*[placed_words(f, c) for f, c in fields.items()]))
    rows = rows_of(df.select(F.col(id_col).alias("rec_id"), listed.alias("_words")), ["rec_id"], "_words", "w")
    rows = rows.select("w.token", "w.field", "rec_id", "w.pos")
    # one exchange: the ranges of (token, record) keep the rows of a posting together
    postings = rows.repartitionByRange("token", "rec_id").groupBy("token", "field", "rec_id").agg(
        F.sort_array(F.collect_list("pos")).alias("positions")
    )
    placed = postings.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "token", "field", "rec_id")
    placed.write.options(**DELTA_CODED).partitionBy("part").parquet(f"{path}/postings")
    schema = placed.schema
    spark.read.schema(schema).parquet(f"{path}/postings").groupBy("part").agg(
        F.min("token").alias("low"), F.max("token").alias("high"), F.count("*").alias("postings")
    ).coalesce(1).write.parquet(f"{path}/ranges")
    df.select(F.col(id_col).alias("rec_id")).write.parquet(f"{path}/records")


def _of_word(token: Column, word: str, prefix: bool) -> Column:
    return token.startswith(word) if prefix else token == word


def _back(positions: Column, steps: int) -> Column:
    return F.transform(positions, lambda p: p - steps)


def parts_of(spark: SparkSession, path: str, terms: list[Term]) -> list[int]:
    """The parts of the postings that can have a word of the terms."""
    low, high = F.col("low"), F.col("high")
    inside = [
        (high >= w) & (low.startswith(w) | (low <= w) if t.prefix else low <= w) for t in terms for w in t.words
    ]
    ranges = spark.read.parquet(f"{path}/ranges").where(reduce(lambda a, b: a | b, inside, F.lit(False)))
    return sorted(r["part"] for r in ranges.select("part").collect())


def postings_of(spark: SparkSession, path: str, terms: list[Term]) -> DataFrame:
    """The postings of the words of the terms, from the files that can have them."""
    wanted = [_of_word(F.col("token"), w, t.prefix) for t in terms for w in t.words]
    postings = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(parts_of(spark, path, terms)))
    return postings.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))


def search_at_rest(spark: SparkSession, path: str, query: str, fields: list[str]) -> DataFrame:
    """``rec_id`` of the records that answer the query, as ``answers`` reads it.

    One aggregate per record tells which words it has and, for phrases, where; the positions of a
    phrase's words, each shifted by its place in the phrase, must have a number in common.
    """
    tree = parsed(query)
    _known(tree, fields)
    terms = terms_of(tree)
    token, positions = F.col("token"), F.col("positions")
    columns, tests = [], {}
    for i, term in enumerate(terms):
        scope = [f for f in fields if term.field in (None, f)]
        if len(term.words) == 1:
            here = _of_word(token, term.words[0], term.prefix)
            here = here & (F.col("field") == term.field) if term.field else here
            columns.append(F.max(here).alias(f"t{i}"))
            tests[term] = F.coalesce(F.col(f"t{i}"), F.lit(False))
        else:
            for j, field in enumerate(scope):
                for k, word in enumerate(term.words):
                    columns.append(F.max(F.when((token == word) & (F.col("field") == field), positions)).alias(f"t{i}_{j}_{k}"))
            starts = [[_back(F.col(f"t{i}_{j}_{k}"), k) for k in range(len(term.words))] for j in range(len(scope))]
            tests[term] = reduce(
                lambda a, b: a | b, [F.coalesce(F.size(reduce(F.array_intersect, s)) > 0, F.lit(False)) for s in starts], F.lit(False)
            )
    records = spark.read.parquet(f"{path}/records")
    if not terms:
        return records if without_any_word(tree) else records.limit(0)
    found = postings_of(spark, path, terms).groupBy("rec_id").agg(*columns)
    if without_any_word(tree):
        found = records.join(found, "rec_id", "left")
    return found.where(_condition(tree, tests.__getitem__, F.lit(True), F.lit(False))).select("rec_id")
