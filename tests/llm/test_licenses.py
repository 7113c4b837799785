import re

from exemplar.llm import licenses, queries

from .common import LONG, SF, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


AWKWARD = [
    None,
    "",
    "Under the MIT License, under-the/mit license. CC BY-NC cc by nc cc by nc",
    "apache license version 2 apache license version 2.0 apache license version 20",
    "é under the mit licensé under the mit license é",
    LONG + " Licensed under CC BY-NC 4.0.",
]


def test_base_places(spark):
    got = {r.doc_id: r for r in licenses.scan(docs(spark, AWKWARD + [AWKWARD[2]]), carry=("doc_id", "score", "token")).collect()}
    for i, text in enumerate(AWKWARD):
        n, places = brute(text)
        assert got[i].n_words == n
        assert sorted((p.first_word, p.label) for p in got[i].base) == places
    assert got[len(AWKWARD)].base == got[2].base


def test_query_over_the_table(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op9_license_scan"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, places = brute(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base) == (n, len(places))
        assert (g.first_word, g.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = sorted({x for _, x in places})
        assert g.base_labels == ",".join(base) and set(base) <= set(filter(None, g.labels.split(",")))
        assert 0 <= g.score <= 1


def test_rules():
    labels = lambda text: list(dict.fromkeys(d[0] for d in licenses.scan_text(text)[2]))
    assert sum(map(len, licenses.rules().values())) > 300
    assert labels("SPDX-License-Identifier: GPL-3.0-only") == ["gpl-3"]
    assert labels("GPLv2") == ["gpl-2"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("Released under the BSD 3-Clause License") == ["bsd-3-clause"]
    assert labels("http://creativecommons.org/licenses/by-nc-sa/4.0/") == ["cc-by-nc-sa"]
    assert labels("the weather in mitte is open and public") == []


def test_contained_detections_are_suppressed():
    found = licenses.scan_text("Licensed under the Apache License, Version 2.0 and the MIT license")[2]
    assert [d[0] for d in found] == ["apache-2", "mit"]
    for i, a in enumerate(found):
        assert not any(b is not a and b[1] <= a[1] and a[2] <= b[2] for b in found[:i])


def test_empty_table(spark):
    assert licenses.scan(docs(spark, [])).collect() == []


def plain_detections(text):
    """All rules at all places, then one hit after the other against all that are kept; words counted from the beginning."""
    found = " " + " ".join(WORD.findall((text or "").translate(LOWER))) + " "
    hits = [
        (priority, m.start() - m.end(), m.start() + 1, m.end(), label, score)
        for one in licenses.rules().values() for label, priority, score, pattern in one for m in pattern.finditer(found)
    ]
    kept = []
    for _, _, a, z, label, score in sorted(hits):
        if not any(b <= a and z <= y for b, y, *_ in kept):
            kept.append((a, z, label, score))
    return [(label, len(found[:a].split()), len(found[:z].split()), score) for a, z, label, score in sorted(kept)]


def test_detections_against_every_rule_at_every_place():
    import random

    rng = random.Random(3)
    parts = [
        "released under the MIT license", "Licensed under the Apache License, Version 2.0", "GNU General Public License, version 3 or later", "GPLv2", "cc by nc sa 4.0",
        "SPDX-License-Identifier: BSD-3-Clause", "all rights reserved", "the license", "é", "mit", "under", "version 2", "public domain", "copyright", "mozilla public license 2.0",
    ]
    for _ in range(40):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        assert licenses.scan_text(text)[2] == plain_detections(text)


def test_long_texts_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):  # 160 and 640 KB
        text = "released under the mit license and word " * n
        start = time.perf_counter()
        words, base, found = licenses.scan_text(text)
        took.append(time.perf_counter() - start)
        assert (words, len(base)) == (7 * n, n) and len(found) >= n
        assert base[-1][1] == 7 * (n - 1) + 1
    assert took[1] < 8 * took[0], took
