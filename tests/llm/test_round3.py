"""Spelling variants, whitening and the exact top-k search against brute force, and their methods' claims."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadworthy.llm import pivot_index, spelling, whitening
from roadworthy.llm.queries import QUERIES

SF0001, SF001 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SETS = ["awkward", SF0001]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return brute.write_tables(spark, tmp_path_factory.mktemp("awkward3"))


def folder(name, request):
    return request.getfixturevalue(name) if name == "awkward" else name


# Spelling variants

@pytest.mark.parametrize("where", [*SETS, SF001])
def test_op11(spark, where, request):
    d = folder(where, request)
    want = brute.spelling(brute.spelled(brute.texts(spark, d)))
    got = QUERIES["op11_spelling"](spark, d).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert where != SF001 or sum(w[1] is not None for w in want) > 100


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_spelling_broadcasts_no_join_side(spark, monkeypatch):
    plans, written = [], spelling.written

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *rest)

    monkeypatch.setattr(spelling, "written", seen)
    found = spelling.variants(words_of(spark, {"house": 2, "houses": 5, "houseys": 11, "mouse": 3, "kitchen": 9}), 5, 2)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)
    assert {r.word: r.root for r in found.collect()} == {"house": "houseys", "houses": "houseys", "houseys": "houseys", "mouse": "mouse", "kitchen": "kitchen"}


def test_variants_of_generated_words(spark):
    rnd = random.Random(4)
    words = {}
    for _ in range(300):
        w = "".join(rnd.choice("abcé") for _ in range(rnd.randint(5, 14)))
        words[w] = rnd.randint(1, 40)
        for _ in range(4):
            i, c = rnd.randrange(len(w) + 1), rnd.choice("abcé")
            w = rnd.choice((w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:]))
            words[w] = rnd.randint(1, 40)
    got = spelling.variants(words_of(spark, words), 5, 3).collect()
    want = brute.spelling([w for w, n in words.items() if len(w) >= 5 for _ in range(n)])
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(r.n_near for r in got) > 3 and sum(r.root not in (r.word, r.form) for r in got) > 3


def test_counts_of_a_word_are_added_and_other_columns_ignored(spark):
    df = spark.createDataFrame(
        [("house", 2, "x"), ("house", 1, "y"), ("houses", 9, "z"), (None, 5, "x"), ("mouse", None, "x"), ("mouse", 3, None), ("tiny", 9, ""),
         ("HOUSE", 3, "")], "word string, n int, form string")
    got = {r.word: tuple(r)[1:] for r in spelling.variants(df).collect()}
    assert got == {"house": ("houses", "houses", 3, 2, 9), "houses": (None, "houses", 9, 1, None), "mouse": (None, "mouse", 3, 1, None),
                   "HOUSE": (None, "HOUSE", 3, 0, None)}
    assert spelling.variants(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(df, length=3)
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)


def test_long_chains_reach_their_root_and_very_long_words_are_compared(spark):
    chain = {"a" * (10 + i): 3 * 2 ** i for i in range(12)}
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(5000))
    got = {r.word: r for r in spelling.variants(words_of(spark, {**chain, long: 3, long[:2500] + "é" + long[2500:]: 6})).collect()}
    assert {got[w].root for w in chain} == {"a" * 21}
    assert got[long].form == long[:2500] + "é" + long[2500:]


def test_pivots_are_the_cheapest_disjoint_pair():
    rnd = random.Random(2)
    for _ in range(500):
        counts = np.array([rnd.randint(0, 6) for _ in range(spelling.BUCKETS)])
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(4, 12)))
        grams = spelling.prefix(word, counts)
        cost = {at: c for c, at in grams}
        a, b = spelling.pivots(grams)
        assert abs(a - b) >= 2
        assert cost[a] + cost[b] == min(cost[i] + cost[j] for i, j in itertools.combinations(cost, 2) if abs(i - j) >= 2)


def test_words_one_edit_apart_share_a_key():
    rnd = random.Random(3)
    counts = np.array([rnd.randint(0, 99) for _ in range(spelling.BUCKETS)])
    for _ in range(3000):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(5, 30)))
        i, c = rnd.randrange(len(w) + 1), rnd.choice("abcd")
        v = rnd.choice((w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:]))
        if v == w or len(v) < 5:
            continue
        by_last = sorted((spelling.prefix(u, counts)[-1][0], u) for u in (v, w))
        (_, first), (_, second) = by_last
        waiting = {k for _, at in spelling.prefix(second, counts) for k in spelling.prefix_keys(second, at)}
        assert waiting & {k for at in spelling.pivots(spelling.prefix(first, counts)) for k in spelling.pivot_keys(first, at)}, (v, w)


def test_a_shared_bigram_does_not_make_all_words_meet(spark):
    """Words that all start with the one rare bigram: few pairs meet, though all share a pivot."""
    rnd = random.Random(8)
    words = {"xq" + "".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(1500)}
    table = np.zeros(spelling.BUCKETS, np.int64) + 50
    table[spelling.zlib.crc32(b"xq") % spelling.BUCKETS] = 1
    waiting, met = defaultdict(int), 0
    for w in words:
        for k in {k for _, at in spelling.prefix(w, table) for k in spelling.prefix_keys(w, at)}:
            waiting[k] += 1
    for w in words:
        met += sum(waiting[k] for k in {k for at in spelling.pivots(spelling.prefix(w, table)) for k in spelling.pivot_keys(w, at)})
    assert met < 0.05 * len(words) ** 2


# Whitening

def fitted(rows):
    """{length: (ids, x as Fractions, n, S, V)} of usable rows."""
    by_dim = defaultdict(list)
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            by_dim[len(v)].append((i, [math.floor(64 * c) + 1_000_000 for c in v]))
    for dim, group in by_dim.items():
        n = len(group)
        s = [sum(x[d] for _, x in group) for d in range(dim)]
        c = [[Fraction(n * x[d] - s[d], n) for d in range(dim)] for _, x in group]
        yield dim, group, n, s, np.array([[float(sum(r[a] * r[b] for r in c) / n) for b in range(dim)] for a in range(dim)])


@pytest.mark.parametrize("where", SETS)
def test_op12(spark, where, request):
    d = folder(where, request)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = QUERIES["op12_whitening"](spark, d).collect()
    total = 0
    for dim, group, n, s, v in fitted(rows):
        if not dim:
            continue
        k = min(32, dim)
        total += n * k
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1], axes[:, ::-1]
        by_id = defaultdict(list)
        for r in got:
            if r.n == n:
                by_id[r.vec_id, r.component].append(r)
        deviation = defaultdict(set)
        for i, x in group:
            deviation[i].add(sum((n * a - b) ** 2 for a, b in zip(x, s)))
        for j in range(k):
            if values[j] < 1e-6:
                assert all(r.whitened is None for i, _ in group for r in by_id[i, j + 1])
                continue
            want, made = [], []
            for i, x in group:
                for r in by_id[i, j + 1][:1]:
                    want.append(float(np.dot([float(Fraction(n * a - b, n)) for a, b in zip(x, s)], axes[:, j]) / math.sqrt(values[j])))
                    made.append(r.whitened)
                    assert r.deviation in deviation[i]
                    assert r.explained == pytest.approx(values[j] / np.trace(v), rel=1e-9)
                    assert r.identity_error <= 1e-9
            if min(abs(values[j] - o) for m, o in enumerate(values) if m != j) > 1e-6 * values[0]:
                sign = 1 if np.dot(want, made) > 0 else -1
                assert np.allclose(np.array(made) * sign, want, atol=1e-7)
    assert len(got) == total


def test_whitened_values_of_a_large_offset_and_many_digits_are_exact(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(400, 5)) * [1e3, 1, 10, 100, 5]
    df = spark.createDataFrame([(f"k{i}", v.tolist(), 1) for i, v in enumerate(data)], "key string, vector array<double>, component int")
    x = whitening.grid(df, "key", "vector", offset=10 ** 12)
    fits = whitening.fit(x)
    exact = np.array([r.x for r in x.collect()], dtype=object)
    n = len(exact)
    c = exact * n - exact.sum(axis=0)
    want = c.T @ c
    v = fits[5].axes @ np.diag(fits[5].values) @ fits[5].axes.T
    assert np.allclose(v, (want / n ** 3).astype(float), rtol=1e-9, atol=1e-13 * float(want.max() / n ** 3))
    assert fits[5].identity_error < 1e-6
    rows = whitening.whiten(df, 2, vec_id="key", embedding="vector").collect()
    assert len(rows) == 800 and {r.component for r in rows} == {1, 2}
    assert isinstance(rows[0].vec_id, str)


def test_polarisation_gives_numpys_covariance():
    rng = np.random.default_rng(1)
    for size in (3, 1 << 20, 1 << 40, 1 << 55):
        x = rng.integers(-size, size, (70, 6))
        sums = [int(s) for s in x.astype(object).sum(axis=0)]
        totals = [int(t) for t in whitening.pair_squares(whitening.centred(x, sums, len(x)))]
        v = whitening.covariance(totals, len(x), 6)
        exact = x.astype(object) * len(x) - np.array(sums, object)
        assert (v == ((exact.T @ exact) / len(x) ** 3).astype(float)).all() or np.allclose(v, ((exact.T @ exact) / len(x) ** 3).astype(float), rtol=1e-15)


def test_degenerate_fits(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in whitening.whiten(same).collect()} == {(None, None, None, 0)}
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, []), (None, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(far).collect()
    assert sorted(((r.vec_id is None, r.component, r.n) for r in got)) == [(False, 1, 2), (False, 2, 2), (True, 1, 2), (True, 2, 2)]


# Exact top-k

def by_query(rows):
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
    return dict(found)


@pytest.mark.parametrize("where", SETS)
def test_op13(spark, where, request):
    d = folder(where, request)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert by_query(QUERIES["op13_top_k"](spark, d).collect()) == brute.inner_products(rows)


def clustered(n=3000, dim=16, centres=12):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(centres, dim)) * 8
    data = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.2
    data[:600] = data[0]  # a hot vector
    return [(i, v.tolist()) for i, v in enumerate(data)]


def test_rings_out_of_reach_are_not_measured(spark):
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = pivot_index.top_k(df, df.where("vec_id % 20 = 0"), k=5, rows=50, block=32).collect()
    assert by_query(got) == brute.inner_products(rows, 5)
    measured = {r.query_id: r.measured for r in got}
    assert sum(measured.values()) < 0.5 * len(measured) * len(rows)


def test_a_round_is_shuffled_in_bounded_slices_and_broadcasts_none(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, asked = 2400, 120
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plans, copies, written = [], [], pivot_index.written

    def seen(df, name, *rest):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        out = written(df, name, *rest)
        if name == "met":  # a row without neighbour for each query and part that met
            copies.append(out.where("vec_id is null").count())
        return out

    monkeypatch.setattr(pivot_index, "written", seen)
    got = pivot_index.top_k(df, df.where("vec_id % 20 = 0"), k=5, rows=10, block=10)
    plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert by_query(got.collect()) == brute.inner_products(rows, 5)
    assert not any("Broadcast" in p for name, p in plans if name in ("met", "best", "result"))
    # Blocks are dealt by hash, so a slice may have some more than its share.
    assert max(copies) < 1.5 * 4 * (n + asked) < sum(copies)


def test_large_rings_are_split_and_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.5]) for i in range(700)] + [(1000, [3.0, 1.0])] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    made = pivot_index.index(df, rows=100)
    sizes = [len(r.ids) // 8 for r in made.blocks.collect()]
    assert sum(sizes) == 701 and max(sizes) < 200
    got = by_query(pivot_index.search(made, df.where("vec_id in (0, 500, 1000)"), k=4).collect())
    one, far = 64 * 64 + 32 * 32, 64 * 192 + 32 * 64
    assert got == {0: [(1000, far), (1, one), (2, one), (3, one)], 500: [(1000, far), (0, one), (1, one), (2, one)],
                   1000: [(0, far), (1, far), (2, far), (3, far)]}


def test_exact_for_large_whole_numbers_and_for_queries_outside(spark):
    rng = np.random.default_rng(12)
    data = rng.integers(-(1 << 25), 1 << 25, (200, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "key long, vector array<double>")
    asked = spark.createDataFrame([(-5, [1e5, 2e5, 3e5]), (-7, [0.0, 0.0, 0.0]), (-9, [1e9, 0.0, 0.0])], "key long, vector array<double>")
    got = by_query(pivot_index.top_k(df, asked, k=3, scale=1.0, vec_id="key", embedding="vector", rows=20).collect())
    assert set(got) == {-5, -7}  # a component of 2^26 or more takes no part
    want = sorted((-sum(int(a) * int(b) for a, b in zip((100000, 200000, 300000), v)), i) for i, v in enumerate(data))[:3]
    assert got[-5] == [(i, -s) for s, i in want] and got[-7] == [(0, 0), (1, 0), (2, 0)]
    with pytest.raises(ValueError):
        pivot_index.top_k(df, asked, k=0, vec_id="key", embedding="vector")
