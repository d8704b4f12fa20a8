"""License scans: ordered signature rules.

A rule is a regular expression over the words of a text (lower case, one space between words). Its
keywords are looked for first, and every text that the rule hits has one of them; only rules with a
keyword that is there run. Hits are taken by priority, then
longest first; a hit that lies inside one already taken is dropped. The rules are made from a table
of families and one of forms, some three hundred in all; signatures written by hand follow, for
standard headers, openings of licence texts and names without a version, which have labels of their own.

Cases: a null or empty text has no words and no labels; texts are read whole; repeated rows are
scanned each; input columns named like the results give way to them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import per_batch, prepare, texts_of, with_columns

# Phrases that the scan always reports, each of their places counted.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Family: label, its name as an expression, its short identifier as words, keywords of the name: each
# text of the expression has one of them. The keyword of the identifier is the identifier.
FAMILIES = (
    ("mit", r"(?:mit|expat|x11)", "mit", ("mit", "expat", "x11")),
    ("mit-0", r"mit no attribution", "mit 0", ("mit no attribution",)),
    ("apache-1.1", r"apache(?: software)?(?: license)? version 1 1", "apache 1 1", ("apache",)),
    ("apache-2", r"(?:asl|apache(?: software)?(?: license)?)(?: version| v)? ?2(?: 0)?", "apache 2 0", ("apache", "asl")),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause", ("bsd",)),
    ("bsd-3-clause", r"(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause", ("bsd",)),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd 4 clause", ("bsd",)),
    ("bsd-zero", r"(?:zero clause bsd|0bsd)", "0bsd", ("bsd",)),
    ("isc", r"isc", "isc", (" isc ",)),
    ("zlib", r"zlib(?: libpng)?", "zlib", ("zlib",)),
    ("boost", r"boost software(?: license)?", "bsl 1 0", ("boost software",)),
    ("unlicense", r"unlicense", "unlicense", ("unlicense",)),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "wtfpl", ("wtfpl", "do what the fuck")),
    ("gpl-1", r"(?:gpl|gnu general public license)(?: version| v)? ?1(?: 0)?", "gpl 1 0", (" gpl", "gnu general public")),
    ("gpl-2", r"(?:gpl|gnu general public license)(?: version| v)? ?2(?: 0)?", "gpl 2 0", (" gpl", "gnu general public")),
    ("gpl-3", r"(?:gpl|gnu general public license)(?: version| v)? ?3(?: 0)?", "gpl 3 0", (" gpl", "gnu general public")),
    ("lgpl-2.0", r"(?:lgpl|gnu (?:library|lesser) general public license)(?: version| v)? ?2(?: 0)?", "lgpl 2 0", ("lgpl", "gnu library general", "gnu lesser general")),
    ("lgpl-2.1", r"(?:lgpl|gnu lesser general public license)(?: version| v)? ?2 1", "lgpl 2 1", ("lgpl", "gnu lesser general")),
    ("lgpl-3", r"(?:lgpl|gnu lesser general public license)(?: version| v)? ?3(?: 0)?", "lgpl 3 0", ("lgpl", "gnu lesser general")),
    ("agpl-3", r"(?:agpl|gnu affero general public license)(?: version| v)? ?3(?: 0)?", "agpl 3 0", ("agpl", "gnu affero")),
    ("gfdl", r"(?:gfdl|gnu free documentation)(?: version)?(?: 1 [0-3])?", "gfdl 1 3", ("gfdl", "gnu free documentation")),
    ("mpl-1.1", r"mozilla public(?: license)?(?: version| v)? ?1 1", "mpl 1 1", ("mozilla public",)),
    ("mpl-2", r"mozilla public(?: license)?(?: version| v)? ?2(?: 0)?", "mpl 2 0", ("mozilla public",)),
    ("epl-1", r"eclipse public(?: license)?(?: version| v)? ?1(?: 0)?", "epl 1 0", ("eclipse public",)),
    ("epl-2", r"eclipse public(?: license)?(?: version| v)? ?2(?: 0)?", "epl 2 0", ("eclipse public",)),
    ("eupl", r"european union public(?: license)?(?: v(?:ersion)? ?1 [0-2])?", "eupl 1 2", ("european union public",)),
    ("cddl", r"common development and distribution(?: license)?(?: version)?(?: 1 [01])?", "cddl 1 0", ("common development and distribution",)),
    ("cpl", r"common public(?: license)?(?: version)? 1 0", "cpl 1 0", ("common public",)),
    ("artistic-1", r"artistic(?: license)? 1 0", "artistic 1 0", ("artistic",)),
    ("artistic-2", r"artistic(?: license)? 2 0", "artistic 2 0", ("artistic",)),
    ("python", r"(?:python software foundation|psf)", "python 2 0", ("python software foundation", "psf")),
    ("postgresql", r"postgresql", "postgresql", ("postgresql",)),
    ("ofl", r"(?:sil open font|ofl)(?: license)?(?: version)?(?: 1 1)?", "ofl 1 1", ("sil open font", "ofl")),
    ("ms-pl", r"microsoft public", "ms pl", ("microsoft public",)),
    ("ms-rl", r"microsoft reciprocal", "ms rl", ("microsoft reciprocal",)),
    ("upl", r"universal permissive", "upl 1 0", ("universal permissive",)),
    ("odbl", r"(?:open database|odbl)", "odbl 1 0", ("open database", "odbl")),
    ("odc-by", r"open data commons attribution", "odc by 1 0", ("open data commons",)),
    ("cc0", r"(?:cc0|creative commons zero)", "cc0 1 0", ("cc0", "creative commons zero")),
    ("cc-by", r"(?:cc by|creative commons attribution)", "cc by 4 0", ("cc by", "creative commons attribution")),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "cc by sa 4 0", ("cc by sa", "creative commons attribution")),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)", "cc by nd 4 0", ("cc by nd", "creative commons attribution")),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "cc by nc 4 0", ("cc by nc", "creative commons attribution")),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc by nc sa 4 0", ("cc by nc", "creative commons attribution")),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)", "cc by nc nd 4 0", ("cc by nc", "creative commons attribution")),
    ("public-domain", r"public domain", "public domain", ("public domain",)),
)

# Form: priority (smaller first), score, expression around {name} or {id}.
FORMS = (
    (1, 0.99, r"spdx license identifier {id}(?: only| or later)?"),
    (2, 0.95, r"(?:re)?licen[sc]ed (?:to you )?under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?"),
    (2, 0.95, r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?"),
    (3, 0.9, r"subject to (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?"),
    (4, 0.85, r"dedicated to the {name}|licen[sc]e:? (?:is )?(?:the )?{name}"),
    (5, 0.8, r"(?:the )?{name} (?:international |unported )?licen[sc]e"),
    (6, 0.7, r"opensource org licenses? {id}|spdx org licenses {id}|creativecommons org licenses {id}"),
)
# Signature: label, priority, score, expression, keywords: each text of the expression has one of them.
FSF = r"as published by the free software foundation (?:either )?version"
GRANT = r"(?:(?:under|subject to) (?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?|licen[sc]e (?:is )?(?:the |an? )?)"
SIGNATURES = (
    # headers and grants with a version
    *(
        (f"{label}-{v}", 7, 0.9, rf"{GRANT}?{name} {FSF} {n}(?: 0)?", (keyword,))
        for label, name, keyword, versions in (
            ("gpl", r"gnu general public licen[sc]e", "gnu general public", (("1", "1"), ("2", "2"), ("3", "3"))),
            ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e", "general public", (("2.0", "2(?! 1)"), ("2.1", "2 1"), ("3", "3"))),
            ("agpl", r"gnu affero general public licen[sc]e", "gnu affero", (("3", "3"),)),
        )
        for v, n in versions
    ),
    *(
        (f"{kind}-{v}", 7, 0.85, rf"{GRANT}?(?:gnu )?{kind}(?: version| ?v) ?{n}", (kind,))
        for kind, v, n in (
            ("gpl", "2", "2(?: 0)?"), ("gpl", "3", "3(?: 0)?"), ("lgpl", "2.1", "2 1"), ("lgpl", "3", "3(?: 0)?"), ("agpl", "3", "3(?: 0)?"),
        )
    ),
    *(
        (label, 8, 0.7, rf"{GRANT}{name}(?: licen[sc]e)?", keywords)
        for label, name, _, keywords in FAMILIES
        if re.search(r"-\d(?:\.\d)?$", label) or label.endswith("clause") or label.startswith("cc")
    ),
    ("apache-2", 7, 0.9, r"licenses this file to you under the apache license version 2(?: 0)?", ("licenses this file",)),
    ("perl", 8, 0.8, r"under the same terms as perl(?: \d)?(?: itself)?", ("same terms as perl",)),
    # openings of texts
    ("gpl-1", 7, 0.9, r"gnu general public license version 1 february 1989", ("february 1989",)),
    ("gpl-2", 7, 0.9, r"gnu general public license version 2 june 1991", ("june 1991",)),
    ("gpl-3", 7, 0.9, r"gnu general public license version 3 29 june 2007", ("29 june 2007",)),
    ("lgpl-2.0", 7, 0.9, r"gnu library general public license version 2 june 1991", ("june 1991",)),
    ("lgpl-2.1", 7, 0.9, r"gnu lesser general public license version 2 1 february 1999", ("february 1999",)),
    ("lgpl-3", 7, 0.9, r"gnu lesser general public license version 3 29 june 2007", ("29 june 2007",)),
    ("agpl-3", 7, 0.9, r"gnu affero general public license version 3 19 november 2007", ("19 november 2007",)),
    ("apache-2", 7, 0.9, r"apache license version 2 0 january 2004", ("january 2004",)),
    ("mpl-2", 7, 0.9, r"mozilla public license version 2 0 1 definitions", ("mozilla public",)),
    ("mit-text", 7, 0.9, r"permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    ("boost-text", 7, 0.9, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", ("hereby granted free of charge",)),
    ("permission-text", 9, 0.6, r"permission is hereby granted free of charge", ("hereby granted free of charge",)),
    ("bsd-text", 7, 0.9, r"redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?", ("redistribution and use in source",)),
    ("bsd-3-clause-text", 7, 0.85, r"nor the names of (?:its|their|the) contributors may be used to endorse or promote products", ("nor the names of",)),
    ("bsd-4-clause-text", 7, 0.85, r"all advertising materials mentioning features or use of this software must display", ("all advertising materials",)),
    ("isc-text", 7, 0.85, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("hpnd-text", 7, 0.85, r"permission to use copy modify and(?: or)? distribute this software and its documentation", ("permission to use copy modify",)),
    ("zlib-text", 7, 0.85, r"in no event will the authors? be held liable for any damages arising from the use of this software", ("in no event will the author",)),
    ("unlicense-text", 7, 0.9, r"this is free and unencumbered software released into the public domain", ("free and unencumbered",)),
    ("artistic-text", 7, 0.85, r"the intent of this document is to state the conditions under which a package may be copied", ("conditions under which a package",)),
    ("cc0-text", 7, 0.9, r"has dedicated the work to the public domain by waiving all", ("dedicated the work to the public domain",)),
    # names without a version; a grant of one version holds the same words and comes before
    *(
        (label, 9, 0.6, GRANT + name, keywords)
        for label, name, keywords in (
            ("gpl", r"(?:(?:gnu )?gpl|gnu general public licen[sc]e)", (" gpl", "gnu general public")),
            ("lgpl", r"(?:(?:gnu )?lgpl|gnu (?:lesser|library) general public licen[sc]e)", ("lgpl", "general public")),
            ("agpl", r"(?:(?:gnu )?agpl|gnu affero general public licen[sc]e)", ("agpl", "gnu affero")),
            ("mpl", r"(?:mpl|mozilla public licen[sc]e)", (" mpl", "mozilla public")),
            ("bsd", r"(?:bsd(?: style| type)? licen[sc]e)", ("bsd",)),
            ("apache", r"(?:apache(?: software)? licen[sc]e)", ("apache",)),
            ("epl", r"(?:epl|eclipse public licen[sc]e)", (" epl", "eclipse public")),
            ("cpl", r"(?:common public licen[sc]e)", ("common public",)),
            ("artistic", r"(?:artistic licen[sc]e)", ("artistic",)),
            ("mit", r"(?:mit(?: style| type)? licen[sc]e)", ("mit",)),
            ("creative-commons", r"(?:creative commons licen[sc]e)", ("creative commons",)),
        )
    ),
)
# Looked for before anything else: no rule can hit a text without one of these.
GATES = (
    b"licen", b"cc by", b"cc0", b"dedicated", b"under", b"subject to", b"spdx", b"gpl", b"hereby granted", b"permission to use copy",
    b"redistribution and use", b"nor the names of", b"all advertising materials", b"in no event will the author", b"free and unencumbered",
)

WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]
    priority: int
    score: float
    pattern: re.Pattern


def rule(label: str, keywords: tuple[str, ...], priority: int, score: float, expression: str) -> Rule:
    # a space stands on both sides of the words, and a hit is whole words
    return Rule(label, tuple(k.encode() for k in keywords), priority, score, re.compile(f"(?<= )(?:{expression})(?= )".encode()))


@cache
def rules() -> tuple[Rule, ...]:
    made = []
    for label, name, short, keywords in FAMILIES:
        for priority, score, form in FORMS:
            expression = form.replace("{name}", name).replace("{id}", short)
            made.append(rule(label, keywords if "{name}" in form else (short,), priority, score, expression))
    made += [rule(label, keywords, priority, score, expression) for label, priority, score, expression, keywords in SIGNATURES]
    return tuple(sorted(made, key=lambda r: r.priority))


@cache
def all_keywords() -> frozenset[bytes]:
    return frozenset(k for r in rules() for k in r.keywords)


def hits_of(words: bytes) -> list[tuple[int, int, int, str, float]]:
    """(priority, start, end, label, score) of all rules; the words have a space on both sides."""
    if not any(g in words for g in GATES):
        return []
    present = {k for k in all_keywords() if k in words}
    found = (r for r in rules() if not present.isdisjoint(r.keywords))
    return [(r.priority, m.start(), m.end(), r.label, r.score) for r in found for m in r.pattern.finditer(words)]


def taken(hits: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Of (priority, start, end, label, score): those not contained in an earlier taken one."""
    kept: list = []
    for hit in sorted(hits, key=lambda h: (h[0], h[1] - h[2], h[1], h[3])):
        if not any(k[1] <= hit[1] and hit[2] <= k[2] for k in kept):
            kept.append(hit)
    return kept


def places(words: bytes, phrase: bytes) -> list[int]:
    """First words of all places of a phrase, overlapping ones too."""
    found, at, look = [], -1, b" " + phrase + b" "
    word = last = 0
    while (at := words.find(look, at + 1)) >= 0:
        word += words.count(b" ", last, at)
        last = at
        found.append(word)
    return found


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    parts = text.translate(WORD_BYTES).split(b" ")
    parts = [p for p in parts if p]
    words = b" " + b" ".join(parts) + b" "
    base = {label: places(words, phrase.encode()) for phrase, label in BASE}
    starts = sorted(x for v in base.values() for x in v)
    named = sorted({label for label, v in base.items() if v})
    hits = taken(hits_of(words))
    labels = sorted({*named, *(h[3] for h in hits)})
    score = max([0.0, *(h[4] for h in hits), *([0.9] if starts else [])])
    spans = [{"label": h[3], "start": words.count(b" ", 0, h[1]) - 1, "words": words.count(b" ", h[1], h[2]) + 1} for h in sorted(hits, key=lambda h: h[1])]
    return (
        len(parts), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(named),
        ",".join(labels), score, spans,
    )


SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
RESULTS = {
    "n_words": (pa.int64(), "long"), "n_base": (pa.int64(), "long"), "first_word": (pa.int64(), "long"),
    "last_word": (pa.int64(), "long"), "base_labels": (pa.string(), "string"), "labels": (pa.string(), "string"),
    "score": (pa.float64(), "double"), "detections": (SPAN, "array<struct<label:string,start:long,words:long>>"),
}


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with RESULTS; ``detections`` has the label, first word and number of words of each hit."""
    prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in RESULTS if c != text])
    extra = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, (_, t) in RESULTS.items()))

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(scan, texts_of(batch.column(text))))
        return with_columns(batch, {n: pa.array(v, t) for (n, (t, _)), v in zip(RESULTS.items(), columns)})

    return docs.mapInArrow(per_batch(add), T.StructType([*docs.schema, *extra]))
