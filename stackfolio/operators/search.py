"""Fielded search as filters on the records, and word search on a token table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import overlaps
from ..functions.rows import rows_of
from ..functions.text import words


def query_terms(query: str) -> list[str] | None:
    """Required words of a plain query; None when it uses operators and must be read as written."""
    text = query.strip()
    if not text or re.search(r"[+~\"()]|AND|OR|(?:^|\s)-[^\s]|\*|:", text):
        return None if text else []
    return [t.lower() for t in re.split(r"[\s-]", text) if t.strip()]


class Atom(NamedTuple):
    """One word of a query: ``prefix`` if any word that starts with it will do."""

    word: str
    negative: bool
    prefix: bool

    def matches(self, token: Column) -> Column:
        return token.startswith(self.word) if self.prefix else token == self.word


def query_parts(query: str) -> list[list[Atom]]:
    """Alternatives (``OR``) of required words; none at all for a query that asks for everything.

    Phrases, fields and brackets are refused: read as loose words they would give wrong answers.
    """
    terms = query_terms(query)
    if terms is not None:
        wanted = sorted({w for term in terms for w in re.findall(r"[^\W_]+", term)})
        return [[Atom(w, False, False) for w in wanted]] if wanted else []
    if re.search(r"[()\[\]{}]|\w:\S", query) or re.search(r'"[^"\s]*\s', query):
        raise ValueError(f"phrases, fields and brackets are not supported: {query!r}")
    parts = []
    for part in re.split(r"\s+OR\s+", query.strip()):
        atoms = []
        for word in re.split(r"\s+AND\s+|\s+", part):
            bare = word.lstrip("+-").strip('"').rstrip("~").lower()
            if bare not in ("", "*"):
                atoms.append(Atom(bare.rstrip("*"), word.startswith("-"), bare.endswith("*")))
        if not atoms:
            return []
        parts.append(atoms)
    return parts


def has_all_terms(text: Column, query: str) -> Column:
    """The text answers the query: words, ``OR``, ``AND``, ``+``/``-`` signs, trailing ``*`` (one scan)."""
    parts = query_parts(query)
    if not parts:
        return F.lit(True)
    if all(not (atom.negative or atom.prefix) for part in parts for atom in part):
        # the text is split once for all words of an alternative
        def all_of(part: list[Atom]) -> Column:
            wanted = sorted({atom.word for atom in part})
            return F.size(F.array_intersect(F.array(*map(F.lit, wanted)), words(text))) == len(wanted)

        return reduce(lambda a, b: a | b, map(all_of, parts))
    tokens = F.array_distinct(words(text))

    def test(atom: Atom) -> Column:
        found = F.exists(tokens, atom.matches) if atom.prefix else F.array_contains(tokens, atom.word)
        return ~found if atom.negative else found

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(test, part)) for part in parts])


def token_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, rec_id), each pair once; write it bucketed by token for repeated search."""
    rows = df.select(F.col(id_col).alias("rec_id"), F.array_distinct(words(F.col(text_col))).alias("_tokens"))
    return rows_of(rows, ["rec_id"], "_tokens", "token")


def search_index(index: DataFrame, query: str) -> DataFrame:
    """Records that answer the query, as ``has_all_terms`` reads it.

    One aggregate per record says which words it has. Only rows of these words are read and shuffled,
    unless an alternative has forbidden words only, or the query asks for everything; then all indexed
    records are looked at (a record without any word is not in an index).
    """
    parts = query_parts(query)
    if not parts:
        return index.select("rec_id").distinct()
    atoms = sorted({atom for part in parts for atom in part})
    token = F.col("token")
    if all(any(not atom.negative for atom in part) for part in parts):
        index = index.where(reduce(lambda a, b: a | b, [atom.matches(token) for atom in atoms]))
    found = index.groupBy("rec_id").agg(*[F.max(atom.matches(token)).alias(f"a{i}") for i, atom in enumerate(atoms)])

    def test(atom: Atom) -> Column:
        has = F.col(f"a{atoms.index(atom)}")
        return ~has if atom.negative else has

    wanted = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(test, part)) for part in parts])
    return found.where(wanted).select("rec_id")


def contributor_is(contributions: Column, who: str, kind: str, authority: str = "https://d-nb.info/gnd/") -> Column:
    """One and the same contribution has the name or id, and the kind or no kind.

    An element is (label, alt_label[], id, type[]). Words of a name must all be in one of its names.
    """
    text = authority + who if re.fullmatch(r"[\d\-X]+", who) else who
    if text.startswith("http"):
        def named(c: Column) -> Column:
            return c["id"] == text
    else:
        terms = [w.lower() for w in re.split(r"\s+AND\s+|\s+", who) if w]

        def has(label: Column) -> Column:
            tokens = words(label)
            return reduce(lambda a, b: a & b, [F.array_contains(tokens, t) for t in terms])

        def named(c: Column) -> Column:
            return F.coalesce(has(c["label"]), F.lit(False)) | F.coalesce(
                F.exists(c["alt_label"], has), F.lit(False)
            )

    def typed(c: Column) -> Column:
        return c["type"].isNull() | (F.size(c["type"]) == 0) | F.array_contains(c["type"], kind)

    return F.coalesce(F.exists(contributions, lambda c: named(c) & typed(c)), F.lit(False))


def has_values(values: Column, asked: str, always_all: bool = False) -> Column:
    """``a,b,AND``: all values; ``a,b``: any of them."""
    parts = [p for p in asked.split(",") if p]
    need_all = always_all or "AND" in parts
    wanted = sorted({p for p in parts if p != "AND"})
    if not wanted:
        return F.lit(True)
    listed = F.array(*[F.lit(w) for w in wanted])
    if need_all:
        return F.coalesce(F.size(F.array_intersect(values, listed)) == len(wanted), F.lit(False))
    return overlaps(values, listed)


def issued_range(year: Column, asked: str) -> Column:
    """``1990``, ``1990-2000``, ``1990-*`` or ``*-2000``."""
    first, _, last = asked.partition("-")
    last = last if "-" in asked else first
    test = F.lit(True)
    if first.strip() not in ("", "*"):
        test = test & (year >= int(first))
    if last.strip() not in ("", "*"):
        test = test & (year <= int(last))
    return F.coalesce(test, F.lit(False))


def search(
    df: DataFrame, fields: dict[str, str], dataset: Column | None = None, q: str = "", name: str = "",
    subject: str = "", id: str = "", publisher: str = "", issued: str = "", medium: str = "",
    owner: str = "", t: str = "", spatial: str = "", person: str = "", corporation: str = "",
) -> DataFrame:
    """All given conditions must hold; an empty one asks nothing. The dataset filter always applies.

    ``fields`` names the columns: text, title, subjects, ids, publisher, year, media, owners, types,
    places, contributions. Cheap comparisons come first; all is one filter above the scan.
    """
    tests = [dataset if dataset is not None else F.lit(True)]
    col = {role: F.col(name_) for role, name_ in fields.items()}
    if issued.strip():
        tests.append(issued_range(col["year"], issued))
    for value, role in ((medium, "media"), (owner, "owners"), (t, "types"), (subject, "subjects"), (id, "ids")):
        if value.strip():
            tests.append(has_values(col[role], value))
    if spatial.strip():
        tests.append(has_values(col["places"], spatial, always_all=True))
    if person.strip():
        tests.append(contributor_is(col["contributions"], person, "Person"))
    if corporation.strip():
        tests.append(contributor_is(col["contributions"], corporation, "CorporateBody"))
    for value, role in ((name, "title"), (publisher, "publisher"), (q, "text")):
        if value.strip():
            tests.append(has_all_terms(col[role], value))
    return df.where(reduce(lambda a, b: a & b, tests))


def fetch_many(df: DataFrame, rec_id: str, id_columns: Sequence[str], ids: DataFrame, pos: str, asked: str) -> DataFrame:
    """Records of an ordered id list (pos, asked), found by any of their ids, in list order."""
    aliases = F.array_distinct(F.filter(F.array(*[F.col(c).cast("string") for c in id_columns]), lambda v: v.isNotNull()))
    found = df.withColumn("_alias", F.explode(aliases))
    wanted = ids.select(F.col(pos).alias("pos"), F.col(asked).cast("string").alias("asked"))
    return wanted.join(found, F.col("asked") == F.col("_alias")).drop("_alias").orderBy("pos", rec_id)
