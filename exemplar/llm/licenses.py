"""License scan by ordered signature rules.

A text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; the
rules see the words joined by single spaces, with one space at either end, so a rule
matches whole words and a match has a place in words.

* Base phrases: every place where a phrase's words stand consecutively.
* Signature rules (``RULES``): regular expressions, each with a label, a priority and a
  score.  They come from families of licences times ways to name one (grant, title,
  identifier tag, web address, notice sentence).  A rule runs only on texts that hold
  its keyword as a word; the words decide first which rules run at all.
* Of overlapping matches, one that lies within the words of a match of higher priority
  (smaller number; equal ones: longer first) is suppressed, whatever its label.

Defined results: null text counts as empty (no words, no labels, score 0); repeated rows
are scanned each; an empty table gives an empty result; other columns are ignored
unless the caller carries them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from .workers import ready


#: Base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: (label, names, versions): names are regexes over space-joined words, versions fill ``{v}`` in label and name.
FAMILIES = (
    ("mit", ("mit", "expat", "mit x11", "x11"), ("",)),
    ("apache-{v}", ("apache(?: software)? license(?: version)?(?: v)? ?{v}(?: 0)?", "apache ?{v}(?: 0)?", "asl ?{v}(?: 0)?"), ("1", "2")),
    ("bsd-{v}-clause", ("bsd {v} clause", "{v} clause bsd", "{v} clause berkeley"), ("0", "2", "3", "4")),
    ("gpl-{v}", ("gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version)?(?: v)? ?{v}(?: 0)?", "(?:gnu )?gpl ?v?{v}(?: 0)?", "general public license version {v}"), ("1", "2", "3")),
    ("lgpl-{v}", ("gnu (?:lesser|library) general public license(?: version)?(?: v)? ?{v}", "(?:gnu )?lgpl ?v?{v}"), ("2", "2 1", "3")),
    ("agpl-{v}", ("gnu affero general public license(?: version)?(?: v)? ?{v}", "(?:gnu )?agpl ?v?{v}"), ("1", "3")),
    ("gfdl-{v}", ("gnu free documentation license(?: version)?(?: v)? ?1 {v}", "gfdl ?1 {v}"), ("1", "2", "3")),
    ("mpl-{v}", ("mozilla public license(?: version)?(?: v)? ?{v}", "mpl ?v?{v}"), ("1 0", "1 1", "2 0", "2")),
    ("epl-{v}", ("eclipse public license(?: version)?(?: v)? ?{v}", "epl ?v?{v}"), ("1 0", "2 0")),
    ("cddl-{v}", ("common development and distribution license(?: version)? ?{v}", "cddl ?v?{v}"), ("1 0", "1 1")),
    ("eupl-{v}", ("european union public licen[cs]e(?: version)? ?(?:v ?)?{v}", "eupl ?v?{v}"), ("1 1", "1 2")),
    ("osl-{v}", ("open software license(?: version)?(?: v)? ?{v}", "osl ?{v}"), ("1 0", "2 0", "2 1", "3 0")),
    ("afl-{v}", ("academic free license(?: version)?(?: v)? ?{v}", "afl ?{v}"), ("2 1", "3 0")),
    ("artistic-{v}", ("(?:perl )?artistic license(?: version)? ?{v}",), ("1 0", "2 0")),
    ("boost-{v}", ("boost software license(?: version)? ?{v}", "bsl ?{v}"), ("1 0",)),
    ("cc-by-{v}", ("creative commons attribution(?: license)? {v}(?: 0)?", "cc by {v}(?: 0)?"), ("1", "2", "2 5", "3", "4")),
    ("cc-by-sa-{v}", ("creative commons attribution share ?alike {v}(?: 0)?", "cc by sa {v}(?: 0)?"), ("1", "2", "2 5", "3", "4")),
    ("cc-by-nd-{v}", ("creative commons attribution no ?deriv(?:atives|s)? {v}(?: 0)?", "cc by nd {v}(?: 0)?"), ("2", "3", "4")),
    ("cc-by-nc-{v}", ("creative commons attribution non ?commercial {v}(?: 0)?", "cc by nc {v}(?: 0)?"), ("1", "2", "3", "4")),
    ("cc-by-nc-sa-{v}", ("creative commons attribution non ?commercial share ?alike {v}(?: 0)?", "cc by nc sa {v}(?: 0)?"), ("2", "3", "4")),
    ("cc-by-nc-nd-{v}", ("creative commons attribution non ?commercial no ?deriv(?:atives|s)? {v}(?: 0)?", "cc by nc nd {v}(?: 0)?"), ("2", "3", "4")),
    ("cc0-{v}", ("cc0(?: {v}(?: 0)?)?", "creative commons zero(?: v?{v}(?: 0)?)?"), ("1",)),
    ("isc", ("isc", "internet systems consortium"), ("",)),
    ("zlib", ("zlib(?: libpng)?",), ("",)),
    ("unlicense", ("unlicense",), ("",)),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public"), ("",)),
    ("python-2", ("python software foundation", "psf"), ("",)),
    ("ruby", ("ruby s?",), ("",)),
    ("php", ("php(?: version)? 3(?: 01?)?",), ("",)),
    ("openssl", ("openssl",), ("",)),
    ("postgresql", ("postgresql",), ("",)),
    ("odbl", ("open database", "odbl"), ("",)),
    ("ofl-1-1", ("sil open font", "ofl(?: 1 1)?"), ("",)),
    ("ms-pl", ("microsoft public", "ms pl"), ("",)),
    ("ms-rl", ("microsoft reciprocal", "ms rl"), ("",)),
    ("ncsa", ("university of illinois(?: ncsa)?(?: open source)?", "ncsa"), ("",)),
    ("upl", ("universal permissive",), ("",)),
    ("blueoak", ("blue oak model",), ("",)),
    ("bsd", ("bsd(?: style)?", "berkeley software distribution"), ("",)),
    ("gpl", ("gnu general public", "gpl"), ("",)),
    ("lgpl", ("gnu (?:lesser|library) general public", "lgpl"), ("",)),
    ("agpl", ("gnu affero general public", "agpl"), ("",)),
    ("apache", ("apache",), ("",)),
    ("mpl", ("mozilla public", "mpl"), ("",)),
)

#: Ways to name a licence: (priority, score, template over the name ``{n}``).
WAYS = (
    (10, 1.0, "spdx license identifier {n}"),
    (20, 0.95, "(?:licensed|released|distributed|available|provided|published|covered|made available|licensing) under (?:the )?(?:terms of (?:the )?)?{n}"),
    (30, 0.9, "under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{n} licen[cs]e"),
    (40, 0.8, "(?:license|licence) {n}"),
    (50, 0.7, "{n} licen[cs]ed?"),
)

#: Sentences and addresses that stand for a licence by themselves: (label, priority, score, regex).
NOTICES = (
    ("mit", 5, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 15, 0.95, "opensource org licen[cs]es mit"),
    ("apache-2", 15, 0.95, "(?:www )?apache org licenses license 2 0"),
    ("gpl", 15, 0.9, "(?:www )?gnu org licenses gpl"),
    ("lgpl", 15, 0.9, "(?:www )?gnu org licenses lgpl"),
    ("agpl", 15, 0.9, "(?:www )?gnu org licenses agpl"),
    ("bsd", 5, 1.0, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", 5, 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", 5, 1.0, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", 5, 1.0, "this is free and unencumbered software released into the public domain"),
    ("boost-1-0", 5, 1.0, "distributed under the boost software license"),
    ("cc0", 15, 0.95, "creativecommons org publicdomain zero"),
    ("cc-by", 16, 0.9, "creativecommons org licenses by(?! (?:sa|nc|nd))"),
    ("cc-by-sa", 15, 0.9, "creativecommons org licenses by sa"),
    ("cc-by-nc", 16, 0.9, "creativecommons org licenses by nc(?! (?:sa|nd))"),
    ("cc-by-nc-sa", 15, 0.9, "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", 15, 0.9, "creativecommons org licenses by nc nd"),
    ("mpl-2", 5, 1.0, "this source code form is subject to the terms of the mozilla public license"),
    ("public-domain", 45, 0.7, "(?:released|dedicated|placed) (?:in|in ?to) the public domain"),
    ("all-rights-reserved", 60, 0.5, "all rights reserved"),
    ("proprietary", 55, 0.6, "proprietary and confidential"),
    ("proprietary", 55, 0.6, "unauthorized copying of this file"),
)


@lru_cache(maxsize=1)
def rules() -> dict[str, list[tuple[str, int, float, re.Pattern]]]:
    """(label, priority, score, pattern) of all rules by keyword, a word that every match of the rule holds."""
    out: dict[str, list[tuple[str, int, float, re.Pattern]]] = {}

    def add(label: str, priority: int, score: float, name: str, pattern: str) -> None:
        # the space before is part of the pattern, so the engine can look for a literal beginning
        out.setdefault(_keyword(name), []).append((label, priority, score, re.compile(f" {pattern}(?= )")))

    for label, names, versions in FAMILIES:
        for v in versions:
            full = label.replace("{v}", v.replace(" ", "-"))
            for name in names:
                for n in _variants(name.replace("{v}", v)):
                    for priority, score, way in WAYS:
                        # a name with a version says more than the bare name, so it comes first within a way
                        add(full, priority - bool(v), score, n, way.replace("{n}", n))
                    if v:
                        add(full, 35, 0.85, n, n)
    for label, priority, score, pattern in NOTICES:
        add(label, priority, score, pattern, pattern)
    return out


def _variants(name: str) -> list[str]:
    """The name with each optional space or v after a letter or digit written out both ways."""
    m = re.search(r"(?<=\w)(?: \?(?:v\?)?|(?<= )v\?)|(?<=\w )v\?", name)
    if not m:
        return [name]
    spellings = ("", " ", "v", " v") if m.group().endswith("v?") and m.group().startswith(" ") else ("", "v") if "v" in m.group() else ("", " ")
    return [w for s in spellings for w in _variants(name[: m.start()] + s + name[m.end() :])]


def _keyword(pattern: str) -> str:
    """The longest literal word outside optional parts and alternatives."""
    plain = pattern
    while re.search(r"\([^()]*\)\??", plain):
        plain = re.sub(r"\([^()]*\)\??", " ", plain)
    # a class stands for one letter, a letter before ? is optional
    plain = re.sub(r"\S*[?\[\]]\S*", " ", plain)
    return max(plain.split(), key=len)


_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _not_contained(hits: list[tuple]) -> list[tuple[int, int, str, float]]:
    """The hits, by priority, that lie in no hit kept before: the farthest end among those that begin no later
    is a prefix maximum, held in a binary indexed tree over the beginnings."""
    starts = sorted({h[2] for h in hits})
    tree = [-1] * (len(starts) + 1)
    kept = []
    for _, _, a, z, label, score in hits:
        rank = bisect_right(starts, a)
        far, i = -1, rank
        while i:
            far, i = max(far, tree[i]), i & (i - 1)
        if far >= z:
            continue
        kept.append((a, z, label, score))
        i = rank
        while i < len(tree):
            tree[i] = max(tree[i], z)
            i += i & -i
    return kept


def scan_text(text: str | None) -> tuple[int, list[tuple[str, int, int, float]], list[tuple[str, int, int, float]]]:
    """(words, base places, rule detections); places are (label, first word, end word, score)."""
    raw = (text or "").encode().translate(_TABLE)
    words = raw.split()
    if not words:
        return 0, [], []
    keywords = _keywords().intersection(words)
    if not keywords:
        return len(words), [], []
    found = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    # where each word begins, so a place becomes a word number without reading what stands before
    begins = list(accumulate((len(w) + 1 for w in found[1:-1].split(" ")), initial=1))
    base = []
    for phrase, label in BASE:
        needle, n, at = f" {phrase} ", phrase.count(" ") + 1, found.find(f" {phrase} ")
        while at >= 0:
            first = bisect_left(begins, at + 1)
            base.append((label, first, first + n, 1.0))
            at = found.find(needle, at + 1)
    hits = []
    for keyword in keywords:
        for label, priority, score, pattern in rules().get(keyword.decode(), ()):
            hits += [(priority, m.start() - m.end(), m.start() + 1, m.end(), label, score) for m in pattern.finditer(found)]
    places = []
    for a, z, label, score in sorted(_not_contained(sorted(hits))):
        places.append((label, bisect_left(begins, a), bisect_right(begins, z - 1), score))
    return len(words), base, places


@lru_cache(maxsize=1)
def _keywords() -> frozenset[bytes]:
    return frozenset(k.encode() for k in [*rules(), *(max(p.split(), key=len) for p, _ in BASE)])


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))
_PLACES_DDL = "array<struct<label:string,first_word:bigint,end_word:bigint,score:double>>"


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, n_words, base (places of base phrases) and detections (places of the rules)."""
    ready(docs.sparkSession)
    kept = docs.select(*dict.fromkeys([*carry, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("label", "first_word", "end_word", "score")
        for b in batches:
            rows = [scan_text(t.as_py()) for t in b.column("text")]
            told = [pa.array([[dict(zip(keys, p)) for p in r[i]] for r in rows], _PLACES) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in carry], pa.array([r[0] for r in rows], pa.int64()), *told],
                names=[*carry, "n_words", "base", "detections"],
            )

    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in carry]
    return kept.mapInArrow(run, ", ".join([*fields, "n_words long", f"base {_PLACES_DDL}", f"detections {_PLACES_DDL}"]))
