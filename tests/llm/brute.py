"""Plain versions of the operators, and small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict  # noqa: F401

import numpy as np
import xxhash

LONG = "word and another word of a long text " * 4000


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard int, fp string, component_id string"
_SHARED = "the quick brown fox jumps over the lazy dog while nobody at all is watching it run away from the barn"
ROWS = [
    (5, "Ein kurzer Satz über das Haus am Fluss und den Wald dahinter.", "de", "src1"),
    (2, _SHARED, "en", "src1"),
    (9, _SHARED, "en", "src12"),
    (9, _SHARED, "en", "src12"),  # a repeated row
    (7, "prefix text " + _SHARED.upper() + " suffix text", "en", None),
    (11, "x" * 49, "en", "other"),
    (12, "x" * 130, "en", "other"),
    (13, "x" * 60, None, "src3"),
    (14, "", "en", "src3"),
    (15, None, "en", "src3"),
    (16, " \t\n ", "fr", ""),
    (17, "12345 !!! 678", "fr", "src3"),
    (18, "two words", "es", "src19"),
    (19, "one", "es", "src19"),
    (20, LONG, "en", "src0"),
    (21, LONG + "tail", "en", "src0"),
    (22, "été où ça déjà vu là-bas près de la forêt éternelle où rien ne bouge 😀 jamais", "fr", "src0"),
    (3, "été où ça déjà vu là-bas près de la forêt éternelle où rien ne bouge 😀 toujours", "fr", "src0"),
    (None, _SHARED, "en", "src1"),
    (None, None, None, None),
    (30, "line\nLicensed under the Apache License, Version 2.0.\n\nanother line", "en", "src5"),
    (31, "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, "
         "provided that the above\ncopyright notice and this permission notice appear in all copies.", "en", "src5"),
    (32, "nul \x00 byte and\r\nwindows line", "en", "src5"),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", 1, "f", "c") for r in rows], DOCUMENTS)


LABELS = [(5, 1, 0), (2, 1, 0), (9, 0, 1), (9, 0, 1), (9, 1, 0), (7, None, 0), (None, 1, 1), (999, 0, 0)] + [(i, i % 2, 0) for i in range(11, 33)]
BENCHMARK = [(1, _SHARED), (1, _SHARED), (2, "lazy dog"), (10, "where nothing moves"), (None, "one"), (3, None), (4, "!!!"), (5, "Two, WORDS")]
PAGES = [
    (1, "http://Example.ORG/es/a?q", "h"), (1, "http://Example.ORG/es/a?q", "h"), (2, "https://a.example.org/en/12#x", None),
    (3, "https://www.b.com/de/x", ""), (4, "https://b.com/fr/x", ""), (5, "https://b.com/en/x", ""), (6, None, ""), (7, "", ""),
    (8, "no scheme here", ""), (9, "x://", ""), (10, "http://org", ""), (11, "http://org/", ""), (12, "http://notexample.org/es/", ""),
    (13, "http://h.co.uk/p://q", ""), (None, "http://É.com/de/", ""), (14, "http://c.net/" + "y" * 9000, ""),
    *[(100 + i, f"http://bad.com/de/{i}", "") for i in range(40)], (200, "http://bad.com/en/", ""),
]
CHAINS = {
    "labels": ("doc_id long, quality int, toxic int", LABELS),
    "benchmark": ("item_id long, text string", BENCHMARK),
    "pages": ("page_id long, url string, html string", PAGES),
}
EMBEDDINGS = (
    [(i, [float((i * 7 + j * j) % 11) - 5.0 for j in range(4)], 0) for i in range(0, 260)]
    + [(300, [1.0, 2.0, 3.0, 4.0], 1), (301, [1.0, 2.0, 3.0, 4.0], 1), (400, [1.0, 2.0, 3.0, 4.0], 1), (400, [1.0, 2.0, 3.0, 4.0], 1)]
    + [(500, None, 1), (600, [], 1), (700, [0.0] * 4, 1), (800, [1.0, None, 1.0, 1.0], 1), (900, [1.0, float("nan"), 1.0, 1.0], 1),
       (1000, [1.0, float("inf"), 0.0, 0.0], 1), (1100, [1.0, 1.0], 1), (1101, [2.0, 1.0], 1), (None, [1.0, 2.0, 3.0, 4.0], 1)]
)


def write_tables(spark, folder, empty=False):
    """All tables under ``folder``; without rows if ``empty``."""
    tables = {"documents": documents(spark, [] if empty else ROWS)}
    for name, (schema, rows) in CHAINS.items():
        tables[name] = spark.createDataFrame([] if empty else rows, schema)
    tables["embeddings"] = spark.createDataFrame([] if empty else EMBEDDINGS, "vec_id long, embedding array<float>, label int")
    for name, df in tables.items():
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def decontaminated(docs, items, window=13):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item, text in items:
        words = re.findall(word, ascii_lower(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[i:i + window])].add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        words = re.findall(word, ascii_lower(text))
        hit, found = [0] * len(words), set()
        for n in {len(k) for k in windows}:
            for p in range(len(words) - n + 1):
                if tuple(words[p:p + n]) in windows:
                    found |= windows[tuple(words[p:p + n])]
                    hit[p:p + n] = [1] * n
        n = sum(hit)
        out.append((doc_id, len(words), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(words)))
    return out


def deduplicated(docs, width=50):
    first = {}
    for doc_id, text in docs:
        b = (text or "").encode()
        if doc_id is not None:
            for p in range(len(b) - width + 1):
                first[b[p:p + width]] = min(doc_id, first.get(b[p:p + width], doc_id))
    out = []
    for doc_id, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if doc_id is not None and first[b[p:p + width]] < doc_id:
                gone[p:p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, distance):
    """Component number of each value under links of at most ``distance`` bits."""
    distinct = sorted(set(values))
    arr = np.array(distinct, np.uint64)
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= distance):
            parent[find(i + 1 + int(j))] = find(i)
    at = {v: find(i) for i, v in enumerate(distinct)}
    return [at[v] for v in values]


def simhash_components(docs, size=3, distance=2):
    marks = [simhash(t, size) for _, t in docs]
    groups = linked(marks, distance)
    least = {}
    for (doc_id, _), g in zip(docs, groups):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return [(doc_id, "%016x" % m, least.get(g)) for (doc_id, _), m, g in zip(docs, marks, groups)]


def nearest(rows, k=10):
    """query_id -> [(vec_id, distance)] by full search."""
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 100 == 0:
            other = {(float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in good if i != q and len(a) == len(b)}
            out[q] = [(i, d) for d, i in sorted(other)[:k]]
    return out


def sort_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def spelled(docs, length=5):
    """Runs of letters of all texts, with a letter left out where the crc32 says so."""
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= length:
                yield run


def spelling(words, least=3, ratio=2):
    """(word, form, root, n, n_near, form_n); words: every occurrence."""
    n = {w: c for w, c in Counter(words).items() if c >= least}
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
    near = {w: set().union(*(holes[w[:i] + "\0" + w[i + 1:]] for i in range(len(w)))) - {w} for w in n}
    for w in n:
        for i in range(len(w)):
            less = w[:i] + w[i + 1:]
            if less in n and less != w:
                near[w].add(less)
                near[less].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def inner_products(rows, k=20, step=20):
    """{query id: [(vec_id, score)]} of ids divisible by ``step``; rows: (id, vector); repeated rows count once."""
    grid = {(i, tuple(math.floor(64 * c) for c in v)) for i, v in rows
            if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    found = defaultdict(list)
    for q, x in grid:
        if q % step == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in grid if i != q and len(y) == len(x))[:k]
            found[q] += [(i, -s) for s, i in best]
    return {q: best for q, best in found.items() if best}
