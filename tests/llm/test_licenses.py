"""The registered licence query against all units and all windows of words of a small table."""

from __future__ import annotations

import re
import time
from collections import Counter

import brute
import pytest

from roadworthy.llm import licenses
from roadworthy.llm.queries import QUERIES

TEXTS = [
    (1, "This project is licensed under the Apache License, Version 2.0."),
    (2, "This library is released under the MIT License.\nSee the file for more.\n\nAnother paragraph."),
    (3, "A first line\nReleased under the\nMIT Licence. See LICENSE for details.\n\nlicensed under CC BY-SA 4.0"),
    (4, licenses.whole_texts()["isc-full"]),
    (5, "Code and data of this work are dedicated to the public domain.\n\n\nLicensed under the BSD License.\n! !\nLicensed under CC BY 4.0."),
    (6, "the license of this software"), (7, None), (8, ""), (9, "one"), (9, "one"), (None, "released under the MIT license"),
    (10, "Released under the MIT License.\n" * 3 + "released under the MIT license released under the MIT license"),
]


def scan(text, templates, least=0.85):
    """(first line, last line, licence, score) of one text, by comparing every unit and every window with every template."""
    known = {k: w for k, t in templates.items() for w in [re.findall("[a-z0-9]+", brute.ascii_lower(t).replace("licence", "license"))]}
    counts = {k: Counter(zip(w, w[1:])) for k, w in known.items()}
    lines = [re.findall("[a-z0-9]+", line) for line in brute.ascii_lower(text).replace("licence", "license").split("\n")]
    edges = [sum(map(len, lines[:i])) for i in range(len(lines) + 1)]
    words = sum(lines, [])

    def scores(part):
        pairs = Counter(zip(part, part[1:]))
        for name, w in known.items():
            if 2 * min(len(part), len(w)) - 2 < least * (len(part) + len(w) - 2):
                continue  # not if all of the smaller were common
            common = sum((pairs & counts[name]).values())
            if 2 * common / (len(part) + len(w) - 2) >= least:
                yield name, 2 * common / (len(part) + len(w) - 2), 3 * common - (len(part) + len(w) - 2)

    blocks, start = [], None
    for i, line in enumerate([*lines, []]):
        if line and start is None:
            start = i
        if not line and start is not None:
            blocks.append((start, i - 1))
            start = None
    units = [(i, i) for i, line in enumerate(lines) if line] + [b for b in blocks if b[0] < b[1]]
    units += [(blocks[0][0], blocks[-1][1])] if len(blocks) > 1 else []
    out = []
    for a, b in units:
        part = sum(lines[a:b + 1], [])
        hits = sorted((-s, n) for n, s, _ in scores(part)) if len(part) > 1 else []
        out += [(a, b, hits[0][1], round(-hits[0][0], 6))] if hits else []
    windows = sorted((-gain, name, a, b, s) for a in range(len(words)) for b in range(a + 2, len(words) + 1) for name, s, gain in scores(words[a:b]))
    kept = []
    for _, name, a, b, s in windows:
        if all(b <= x or y <= a for x, y, _, _ in kept):
            kept.append((a, b, name, s))
    units_found = list(out)
    line_of = [i for i, line in enumerate(lines) for _ in line]
    for a, b, name, s in kept:
        if not any(n == name and edges[x] <= a and b <= edges[y + 1] for x, y, n, _ in units_found):
            out.append((line_of[a], line_of[b - 1], name, round(s, 6)))
    return out


def test_registered_query_is_the_brute_force_scan(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "x", 1) for r in TEXTS], "doc_id long, text string, license string, score int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    templates = licenses.whole_texts()
    want = [(i, *hit) for i, t in TEXTS for hit in scan(t, templates)]
    got = [tuple(r) for r in QUERIES["op8_licenses"](spark, str(tmp_path)).select("doc_id", "first_line", "last_line", "license", "score").collect()]
    assert brute.sort_rows(got) == brute.sort_rows(want)
    assert {(1, "apache-2.0"), (2, "mit"), (3, "mit"), (4, "isc"), (4, "isc-full")} <= {(r[0], r[3]) for r in got}


@pytest.mark.parametrize("kind", ["copies", "noisy"])
def test_long_licence_texts_take_linear_time(kind):
    known = licenses.Templates(licenses.whole_texts(), 0.85)
    words = [w for line in licenses.lines_of(licenses.whole_texts()["gpl-3.0-full"]) for w in line]

    def seconds(copies):
        text = [w if kind == "copies" or i % 25 else "other" for i, w in enumerate(words * copies)]
        start = time.process_time()
        assert len([w for w in known.within(text) if w[2] == "gpl-3.0-full"]) >= copies // 2  # the best first, wherever they begin
        return time.process_time() - start

    assert seconds(24) < 20 * seconds(6) + 1
