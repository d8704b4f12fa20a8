"""Text values: assembling, cleaning, URIs."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def absent_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def paste(*parts: Column | str, sep: str = " ") -> Column:
    """Join parts; plain strings are literal text, missing columns are left out."""
    return F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p for p in parts])


def around(before: str, value: Column, after: str = "") -> Column:
    """``before`` + value + ``after``, or NULL when the value is missing."""
    return F.concat(F.lit(before), value, F.lit(after))


def squeeze_spaces(value: Column) -> Column:
    return F.regexp_replace(value, " +", " ")


def strip_controls(value: Column) -> Column:
    """Remove control characters but carriage return, line feed and tab."""
    return F.regexp_replace(value, r"[\p{Cc}&&[^\r\n\t]]", "")


def without_nonsort(value: Column) -> Column:
    return F.regexp_replace(value, "<<|>>|¬", "")


MARKS = "".join(map(chr, range(0x0300, 0x0370)))
LATIN_END = "ƀ"
SYLLABLES = range(0xAC00, 0xD7A4)  # Hangul: two or three letters each


def base_letters(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if c not in MARKS)


@lru_cache(maxsize=1)
def diacritic_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition without combining marks, of all of Unicode but the Hangul syllables.

    (from, to) for ``translate``, characters and marks to be removed last; characters with longer bases.
    """
    single, longer = {}, {}
    for code in range(0xA0, 0x110000):
        if code in SYLLABLES or 0xD800 <= code < 0xE000:
            continue
        letter = chr(code)
        base = base_letters(letter)
        if base != letter:
            (single if len(base) <= 1 else longer)[letter] = base
    source = sorted(single, key=lambda c: not single[c])
    return "".join(source), "".join(single[c] for c in source), longer


@lru_cache(maxsize=1)
def syllable_tables() -> list[tuple[str, str]]:
    """(from, to) for ``translate`` to the first, second and third letter; syllables of two letters last."""
    parts = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in SYLLABLES}
    source = sorted(parts, key=lambda c: -len(parts[c]))
    return [("".join(source), "".join(parts[c][k : k + 1] for c in source)) for k in range(3)]


def _longer_bases(value: Column) -> Column:
    """Characters whose decomposition has several letters; all other text as it is."""
    longer = diacritic_tables()[2]
    group = "".join(longer)
    # neither separator occurs in a decomposition
    table = F.str_to_map(F.lit("\x02".join(f"{c}\x01{base}" for c, base in longer.items())), F.lit("\x02"), F.lit("\x01"))
    syllable = F.lit(f"[{chr(SYLLABLES[0])}-{chr(SYLLABLES[-1])}]")
    one = "|".join([f"[{group}]", f"[{chr(SYLLABLES[0])}-{chr(SYLLABLES[-1])}]", f"[^{group}{chr(SYLLABLES[0])}-{chr(SYLLABLES[-1])}]+"])

    def spelled(part: Column) -> Column:
        letters = F.concat(*[F.translate(part, source, target) for source, target in syllable_tables()])
        return F.when(F.regexp(part, syllable), letters).otherwise(F.coalesce(F.element_at(table, part), part))

    parts = F.transform(F.regexp_extract_all(value, F.lit(one), F.lit(0)), spelled)
    # a class of all of them is slow to test: Latin letters by name, and whatever comes behind them
    latin = "".join(c for c in longer if c < LATIN_END)
    return F.when(value.rlike(f"[{latin}{LATIN_END}-\U0010FFFF]"), F.array_join(parts, "")).otherwise(value)


def strip_diacritics(value: Column) -> Column:
    """Base letters only (compatibility decomposition), but names with German umlauts stay as they are."""
    source, target, _ = diacritic_tables()
    as_it_is = ~has_other_letters(value) | F.lower(value).rlike("[äöü]|[aou]̈")
    return F.when(as_it_is, value).otherwise(F.translate(_longer_bases(value), source, target))


def has_other_letters(value: Column) -> Column:
    """Not all of the text is ASCII: a cheap test before any work on accents."""
    return value.rlike(r"[^\x00-\x7F]")


def make_uri(value: Column, prefix: str = "", encode: bool = False) -> Column:
    if encode:
        value = F.regexp_replace(F.url_encode(value), r"\+", "%20")
    return F.concat(F.lit(prefix), value)


def local_part(uri: Column) -> Column:
    """The part behind the last slash or hash of a URI; other text as it is."""
    return F.regexp_replace(uri, r"^http.+[/#](.+)$", "$1")


def short_id(uri: Column) -> Column:
    """``…#n141020`` → ``141020``; text without a hash as it is."""
    return F.when(uri.contains("#"), F.substr(F.split(uri, "#")[1], F.lit(2))).otherwise(uri)


def words(value: Column) -> Column:
    """Lower-case word tokens, no empty ones."""
    return F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), lambda w: w != "")
