"""Licence scan: Dice coefficient over word bigrams against licence templates.

The units compared are every line of a text, every paragraph of more than one
line (lines without words end a paragraph), and the whole text if it has more
than one paragraph.  Text is normalised to its words: A-Z lower-cased, runs of
a-z and 0-9, ``licence`` spelt ``license``.  A unit's bigrams are counted with
repeats; its score against a template is 2 * common / (unit's + template's).
A score of ``least`` needs sizes within a factor of (2 - least) / least, so a
unit is compared only with the templates in that range, and only through the
bigrams they share.  The best template at or above ``least`` is
reported, ties going to the smaller name.

With ``within``, licences that are no unit are found too: every window of words
of the whole text, across lines, is a candidate.  A window's gain is the bigrams
it has in common with the template less those that only one of them has.  Of
the windows with a score of ``least``, the one with the largest gain is kept (ties:
smaller name, earlier, shorter), then the next that overlaps none of those
kept.  Only windows that begin and end with one of the template's bigrams can be best.  Starts
after which too few bigrams count are left out; blocks of the others are bounded and
halved, the most promising first.
A kept window inside a reported unit of the same licence is not reported again.

``TEMPLATES`` are notices and the openings of short licences; ``whole_texts``
adds the whole licence texts in ``license_texts/`` (17 files, 240 kB), which are
read once and broadcast.  Licences without a file there (the Creative Commons
texts but CC0, AGPL, EPL and others) are found by their notices only, or not at all.

Defined results: a null, empty or wordless text and units of one word match
nothing; repeated rows are reported as often as they occur; an empty table
gives an empty result; columns named like an output column are replaced.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from roadworthy.llm.arrow import pieces
from roadworthy.llm.common import LOWER, UPPER, bounded_batches

LEAST = 0.85
FOUND = "first_line int, last_line int, license string, score double"
_LOWER = str.maketrans(UPPER, LOWER)

#: Licence notices and short licence texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "bsd-notice": "Licensed under the BSD License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "public-domain": "This work is dedicated to the public domain.",
}


def whole_texts() -> dict[str, str]:
    """The notices, and the whole licence texts by file name."""
    files = (Path(__file__).parent / "license_texts").glob("*.txt")
    return TEMPLATES | {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files)}


def lines_of(text: str) -> list[list[str]]:
    """Words of each line, normalised."""
    plain = text.translate(_LOWER).replace("licence", "license")
    return [re.findall("[a-z0-9]+", line) for line in plain.split("\n")]


class Templates:
    def __init__(self, texts: Mapping[str, str], least: float):
        if not 0 < least <= 1:
            raise ValueError("least is above 0 and at most 1")
        sized = sorted((len(words) - 1, name, words) for name, t in texts.items() for words in [sum(lines_of(t), [])])
        sized = [s for s in sized if s[0] > 0]
        self.least, self.names, self.sizes = least, [s[1] for s in sized], [s[0] for s in sized]
        self.shared: dict[tuple[str, str], dict[int, int]] = defaultdict(dict)
        for number, (_, _, words) in enumerate(sized):
            for pair, n in Counter(zip(words, words[1:])).items():
                self.shared[pair][number] = n
        self.number_of = {pair: i for i, pair in enumerate(self.shared)}
        self.fewest = np.array([max(1, math.ceil(least * n / (2 - least) - 1e-9)) for n in self.sizes], np.int64)
        #: How often each template has each bigram.
        self.counts = np.zeros((len(sized), len(self.shared)), np.int32)
        for pair, i in self.number_of.items():
            for number, n in self.shared[pair].items():
                self.counts[number, i] = n

    def range_of(self, size: int) -> tuple[int, int]:
        """Templates [from, to) whose size allows the least score for a unit of ``size`` bigrams."""
        ratio = (2 - self.least) / self.least
        return bisect_left(self.sizes, size / ratio - 1e-9), bisect_right(self.sizes, size * ratio + 1e-9)

    def best(self, words: list[str]) -> tuple[str, float] | None:
        size = len(words) - 1
        low, high = self.range_of(size) if size > 0 else (0, 0)
        if low == high:
            return None
        pairs = [p for p in zip(words, words[1:]) if p in self.shared]
        common: dict[int, int] = defaultdict(int)
        for pair, n in Counter(pairs).items():
            for number, m in self.shared[pair].items():  # in order of size
                if number >= high:
                    break
                if number >= low:
                    common[number] += min(n, m)
        scored = [(2 * c / (size + self.sizes[t]), self.names[t]) for t, c in common.items()]
        scored = [s for s in scored if s[0] >= self.least]
        return min(((name, score) for score, name in scored), key=lambda s: (-s[1], s[0])) if scored else None

    def _hits(self, words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By template: its bigrams' places, the place that must lie before a window for each to count, where the widest windows end, possible starts."""
        number_of = self.number_of.get
        ids = np.array([number_of(pair, -1) for pair in zip(words, words[1:])], np.int32)
        places = np.flatnonzero(ids >= 0)
        ids, found = ids[places], {}
        most = self.range_of(len(words) - 1)[1]  # larger templates need more bigrams than there are
        for number in np.flatnonzero(np.count_nonzero(self.counts[:most, ids], axis=1) >= self.fewest[:most]).tolist():
            counts, size, fewest = self.counts[number][ids], self.sizes[number], self.fewest[number]
            mine = np.flatnonzero(counts)
            pos, own = places[mine], np.arange(len(mine))
            ends = np.searchsorted(pos, pos + int(size * (2 - self.least) / self.least + 1e-9))
            # A bigram counts as often as the template has it: not if that many others are between the start and it.
            order = np.argsort(ids[mine], kind="stable")
            sorted_ids, earlier = ids[mine][order], own - counts[mine][order]
            full = np.flatnonzero((earlier >= 0) & (sorted_ids[earlier] == sorted_ids))
            late, early = order[full], order[earlier[full]]
            before = np.full(len(pos), -1)
            before[late] = pos[early]
            # The most bigrams that count from a start on: all to its widest end, less those of a pair (early, late) inside.
            inside = np.searchsorted(ends, late, side="right")
            lost = np.zeros(len(pos) + 1, np.int64)
            some = inside <= early
            np.add.at(lost, inside[some], 1)
            np.add.at(lost, early[some] + 1, -1)
            common = ends - own - np.cumsum(lost)[:-1]
            starts = np.flatnonzero(common >= fewest)
            if len(starts):
                found[number] = pos, before, ends, starts
        return found

    def within(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(first word, end, template, score) of the best windows that do not overlap.

        A block of a template's starts is bounded by the bigrams that count from its first start and the windows' sizes from its
        last; bounds of one start are exact.  The best block is halved until it is one start; starts within kept windows are dropped.
        """
        hits = self._hits(words)

        def measure(number: int, a: int, b: int, limit: int) -> tuple | None:
            """The most that windows from the a-th to before the b-th start gain that end by word ``limit``."""
            pos, before, ends, starts = hits[number]
            first, last = int(starts[a]), int(starts[b - 1])
            end = min(int(ends[last]), int(np.searchsorted(pos, limit - 1)))
            if end <= first:
                return None
            start, size = int(pos[first]), self.sizes[number]
            common = np.cumsum(before[first:end] < start)
            total = np.maximum(pos[first:end] - int(pos[last]) + 1, common) + size  # no window is smaller than what it has in common
            score = 2 * common / total
            gain = np.where(score >= self.least, 3 * common - total, -4 * size - len(words))
            j = int(gain.argmax())
            if score[j] < self.least:
                return None
            return -int(gain[j]), self.names[number], start, int(pos[first + j]) + 2, float(score[j]), number, a, b

        queue = [w for number, h in hits.items() if (w := measure(number, 0, len(h[3]), len(words)))]
        heapq.heapify(queue)
        kept: list[tuple[int, int, str, float]] = []  # in order of place
        while queue:
            bound, name, start, end, score, number, a, b = heapq.heappop(queue)
            at = hits[number][0][hits[number][3][a:b]]
            i = bisect_right(kept, start, key=lambda w: w[0])
            room = kept[i][0] if i < len(kept) else len(words)
            if i and kept[i - 1][1] > start:
                cuts = [(a + int(np.searchsorted(at, kept[i - 1][1])), b)]
            elif b - a > 1:
                inside = a + int(np.searchsorted(at, room))
                cuts = [(a, inside), (inside, b)] if inside < b else [(a, (a + b) // 2), ((a + b) // 2, b)]
            elif end > room:
                cuts = [(a, b)]
            else:
                insort(kept, (start, end, name, score))
                continue
            for a, b in cuts:
                last = int(hits[number][0][hits[number][3][b - 1]])
                i = bisect_right(kept, last, key=lambda w: w[0])
                if a < b and (w := measure(number, a, b, kept[i][0] if i < len(kept) else len(words))):
                    heapq.heappush(queue, w)
        return kept


def units(lines: list[list[str]], longest: int) -> Iterator[tuple[int, int, list[str]]]:
    """(first line, last line, words) of each unit of 2 to ``longest`` words; lines count from 0."""
    spans, start = [], None
    for i, words in enumerate([*lines, []]):
        if words:
            if len(words) <= longest:
                yield i, i, words
            start = i if start is None else start
        elif start is not None:
            spans.append((start, i - 1))
            start = None
    wide = [s for s in spans if s[1] > s[0]] + ([(spans[0][0], spans[-1][1])] if len(spans) > 1 else [])
    for a, b in wide:
        if sum(map(len, lines[a:b + 1])) <= longest:
            yield a, b, sum(lines[a:b + 1], [])


def found_in(lines: list[list[str]], known: Templates, longest: int, within: bool) -> Iterator[tuple[int, int, str, float]]:
    """(first line, last line, licence, score) of each matching unit, and of each window that is part of none."""
    edges = np.cumsum([0, *map(len, lines)])
    seen = defaultdict(list)
    for first, last, words in units(lines, longest):
        if hit := known.best(words):
            seen[hit[0]].append((edges[first], edges[last + 1]))
            yield first, last, *hit
    if within:
        for a, b, name, score in known.within([w for line in lines for w in line]):
            if not any(x <= a and b <= y for x, y in seen[name]):
                first, last = np.searchsorted(edges, [a, b - 1], side="right") - 1
                yield int(first), int(last), name, score


def _templates(shared: dict, least: float) -> Templates:
    """The templates of a broadcast value, kept with it for the worker's next tasks."""
    if least not in shared:
        shared[least] = Templates(shared["texts"], least)
    return shared[least]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST, text: str = "text", within: bool = False) -> DataFrame:
    """One row a match: the row's columns without its text, the lines, the licence and the score."""
    bounded_batches(docs.sparkSession)
    found = StructType.fromDDL(FOUND)
    kept = [f for f in docs.schema if f.name != text and f.name not in found.names]
    schema = StructType(kept + found.fields)
    arrow_schema = to_arrow_schema(schema)
    texts = docs.sparkSession.sparkContext.broadcast({"texts": dict(templates)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _templates(texts.value, least)
        longest = int(known.sizes[-1] * (2 - least) / least) + 2 if known.sizes else 0
        for batch in pieces(batches, text, 8 << 20):
            rows, hits = [], []
            for row, value in enumerate(batch.column(text).to_pylist()):
                for hit in found_in(lines_of(value or ""), known, longest, within):
                    rows.append(row)
                    hits.append(hit)
            if rows:
                at = pa.array(rows)
                columns = [batch.column(f.name).take(at) for f in kept] + [pa.array(list(c)) for c in zip(*hits)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return docs.select(*[f.name for f in kept], text).mapInArrow(run, schema)
