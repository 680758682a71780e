"""The operators' own interfaces: parameters, clashing columns, and each method's claims."""

from __future__ import annotations

import pickle
import random
import re
import types

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadworthy.llm import decontamination, language_id, licenses, mixing, quality, sharding, simhash, suffix_dedup, vptree
from roadworthy.llm.components import components


def test_factor_one_is_exact_and_a_larger_one_is_not_better(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(1500, 12)).round(2)
    data[1000:1200] = data[7]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.nearest(rows, 5)

    def found(factor):
        got = vptree.nearest(df, df.where("vec_id % 100 = 0"), k=5, factor=factor, rows=400, block=4).collect()
        return {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in want}

    exact = found(1.0)
    assert exact == {q: [i for i, _ in w] for q, w in want.items()}
    loose = found(3.0)
    hits = sum(len(set(loose[q]) & set(exact[q])) for q in want)
    assert hits <= sum(map(len, exact.values()))
    with pytest.raises(ValueError):
        vptree.nearest(df, df, factor=0.5)


def test_rows_of_one_id_are_spread(spark):
    rng = np.random.default_rng(11)
    data = [v.tolist() for v in rng.normal(size=(1200, 6)).round(3)]
    rows = [(i, v) for i, v in enumerate(data[:600])] + [(5000, v) for v in data[600:]] + [(7000, data[3])] * 600
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    trees = vptree.index(df, rows=150).collect()
    sizes = [len(pickle.loads(t.tree)[0]) for t in trees]
    assert sum(sizes) == 1201 and max(sizes) < 300 and len(sizes) >= 6
    asked = df.where("vec_id in (0, 300, 5000, 7000)").selectExpr("vec_id query_id", "embedding vector", "size(embedding) dim")
    blocks = [r["count"] for r in vptree._dealt(asked, "query_id", 100, "block").groupBy("block").count().collect()]
    assert sum(blocks) == 603 and max(blocks) < 200
    got = vptree.nearest(df, df.where("vec_id in (0, 300, 7000)"), k=5, rows=150, block=1).collect()
    found = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in (0, 300, 7000)}
    for q, ids in found.items():
        v = np.array(data[3] if q == 7000 else data[q])
        near = sorted({(float(np.sqrt(((np.array(w) - v) ** 2).sum())), i) for i, w in rows if i != q})
        assert ids == [i for _, i in near[:5]]


def test_looser_factor_measures_fewer_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 10
    data = np.concatenate([c + rng.normal(size=(50, 8)) for c in centres])
    tree = vptree.Tree(np.arange(len(data)), data)
    seen = {}
    for factor in (1.0, 2.0):
        search = vptree.Search.__new__(vptree.Search)
        measured = []
        offer = vptree.Search._offer
        search._offer = lambda rows, a, b, s=search, m=measured: (m.append(len(rows) * (b - a)), offer(s, rows, a, b))[1]
        search.__init__(tree, np.arange(20), data[:20], 5, factor)
        seen[factor] = sum(measured)
    assert seen[2.0] < seen[1.0] < 20 * len(data)


def test_language_calibration_and_sparsity(spark):
    words = {"a": ["the", "thing", "that"], "b": ["die", "und", "der"]}
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(w, k=20)), k) for k, w in words.items() for _ in range(60)] + [(None, "a"), ("x", None)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, label string"))
    assert model.labels == ["a", "b"] and 0.05 <= model.temperature <= 20
    assert 0 < np.count_nonzero(model.weights) < 0.01 * model.weights.size
    assert model.predict(["the thing", "und der", None, "12 34", ""])[0] == ["a", "b", "und", "und", "und"]
    hot = np.tile([4.0, 0.0], (10, 1))
    assert language_id.temperature(hot, np.array([0] * 6 + [1] * 4)) > 5  # overconfident logits are cooled


def test_language_of_clashing_columns(spark):
    df = spark.createDataFrame([("the thing", 1, "old")], "text string, score int, lang_pred string")
    model = language_id.learn(spark.createDataFrame([("the thing", "a")], "text string, label string"))
    assert language_id.predict(df, model).first()["lang_pred"] == "a"


def test_attention_gradient():
    rng = np.random.default_rng(0)
    texts = ["word " * 200, "!!! ### " * 90, "short", "", "UPPER LOWER " * 80]
    x, owner = quality.passages(texts)
    net = quality.Network.start(x, 0.5)
    y = np.array([1.0, 0, 1, 0, 0])
    grad = net.gradient(net.forward(x, owner, 5), owner, y)

    def loss():
        p = net.forward(x, owner, 5)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in grad.items():
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 3):
            old, eps = flat[i], 1e-5
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - np.asarray(g).reshape(-1)[i]) < 1e-6, name


def test_attention_weights_cover_the_document(spark):
    rows = [(i, ("word and another " * 60) if i % 2 else ("### !!! " * 100)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    net = quality.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, label int"))
    for r in quality.score(docs, net).collect():
        assert len(r.passages) == -(-len(rows[r.doc_id][1]) // quality.PASSAGE) and abs(sum(r.passages) - 1) < 1e-5
        assert (r.score > 0.5) == (r.doc_id % 2 == 1)
    kept = quality.keep(docs, net, 0.5)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {1}


def test_offsets_point_into_the_original_text(spark):
    text = "Ünd \x00 The QUICK, brown-fox;  jumps éé over."
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, words int")
    items = spark.createDataFrame([(7, "quick brown fox jumps")], "item_id long, text string")
    for block_bytes in (decontamination.BLOCK_BYTES, 1):
        row = decontamination.scan(docs, items, block_bytes=block_bytes).first()
        assert [text[a:b] for a, b in row.spans] == ["QUICK, brown-fox;  jumps"]
        assert row["items"] == ["7"] and row.n_words == 8
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_blocks_of_items_find_the_same(spark, block_bytes):
    rng = random.Random(2)
    words = [rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(4000)]
    items = [(i, " ".join(words[j:j + rng.randint(1, 30)])) for i, j in enumerate(range(0, 600, 20))]
    docs = [(i, " ".join(rng.choices(words, k=80) + words[j:j + 20])) for i, j in enumerate(range(0, 1000, 25))]
    got = decontamination.scan(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = got.select("doc_id", "n_words", decontamination.hit_words(F.col("words")).alias("h"), F.size("items"))
    want = [(d, n, h, k) for d, n, h, k, _, _ in brute.decontaminated(docs, items)]
    assert brute.sort_rows(got.collect()) == brute.sort_rows(want)


def test_texts_without_a_window_are_not_searched():
    """Words of bytes are those of the text; the automaton reads only texts that may hold a window, and misses none."""
    rng = random.Random(5)
    odd = "".join(map(chr, [*range(256), 0x130, 0x2028, 0x3000, 0x1F600]))
    for text in ["", odd, *("".join(rng.choices(odd, k=60)) for _ in range(200))]:
        assert [w.decode() for w in decontamination.words_of(text.encode())] == re.findall(decontamination.WORD, brute.ascii_lower(text))
    assert decontamination.words_of(None) == []
    for lengths in ([40], [13], [5], [1, 2], [3, 12, 20, 13], [7, 30]):
        items = [(str(i), " ".join(rng.choices("abcdefgh", k=n) + [f"x{i}"])) for i in range(6) for n in lengths]
        windows = decontamination.Windows(items, 13)
        for _ in range(300):
            words = rng.choices("abcdefghy", k=rng.randint(0, 25))
            if rng.random() < 0.6:
                held = items[rng.randrange(len(items))][1].split()
                at = rng.randint(0, max(0, len(held) - 13))
                words += held[at:at + rng.choice((12, 13, 20))] + rng.choices("abcdefghy", k=rng.randint(0, 25))
            words = [w.encode() for w in words]
            found = windows.find(words)
            sieves, windows.sieves = windows.sieves, [types.SimpleNamespace(may_hold=lambda words: True)]
            assert found == windows.find(words)
            windows.sieves = sieves
    windows = decontamination.Windows([("1", " ".join(f"w{i}" for i in range(40))), ("2", "short item")], 13)
    windows.automaton = types.SimpleNamespace(iter=lambda ids: pytest.fail("searched"))
    apart = [f"w{i}".encode() for i in range(40) for _ in range(2)] + [b"item", b"short"]
    assert windows.find(apart) == ([], set())
    assert decontamination.Windows([], 13).find(apart) == ([], set())


def test_equal_items_are_sent_once_and_read_once_a_worker(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices("abcdefgh", k=20))) for i in range(60)]
    docs = [(i, " ".join(rng.choices("abcdefgh", k=10)) + " " + items[i][1]) for i in range(30)]
    sent = []
    monkeypatch.setattr(decontamination, "_scan", lambda d, rows, *a, f=decontamination._scan, **k: sent.append(rows) or f(d, rows, *a, **k))
    got = decontamination.scan(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame(items + [items[0]] * 300, "item_id long, text string"), block_bytes=1000)
    got = got.select("doc_id", "n_words", decontamination.hit_words(F.col("words")).alias("h"), F.size("items"))
    assert brute.sort_rows(got.collect()) == brute.sort_rows([(d, n, h, k) for d, n, h, k, _, _ in brute.decontaminated(docs, items)])
    assert sum(map(len, sent)) == 60 and max(sum(len(t) + 64 for _, t in rows) for rows in sent) < 2500
    shared = {"items": items}
    assert decontamination._windows(shared, 13) is decontamination._windows(shared, 13)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_blocks_find_every_equal_window(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(suffix_dedup, "RANGE", 64)
    base = rng.integers(97, 99 if seed % 2 else 120, 400).astype(np.uint8)
    text = np.concatenate([base, rng.integers(97, 99, 200).astype(np.uint8), base[50:350], np.full(150, 97, np.uint8), base[::-1], base])
    at = np.arange(len(text) - suffix_dedup.WIDTH + 1)
    owner = rng.integers(0, 50, len(at))
    least = {}
    data = text.tobytes()
    for p in at:
        w = data[p:p + suffix_dedup.WIDTH]
        least[w] = min(least.get(w, 99), owner[p])
    got = suffix_dedup.owners(text, at, owner)
    assert got.tolist() == [least[data[p:p + suffix_dedup.WIDTH]] for p in at]


def test_difference_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("passes", [1, 3])
def test_suffix_dedup_of_near_copies_and_runs(spark, passes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 4000)
    rng = random.Random(passes)
    line = "".join(rng.choices("abc de é", k=300))
    docs = []
    for i in range(60):
        a = rng.randrange(200)
        docs.append((rng.randrange(50), line[a:a + rng.randrange(300)] + "".join(rng.choices("ab", k=rng.randrange(80))) + line[:rng.randrange(120)]))
    docs += [(100 + i, "z" * (40 + 10 * i)) for i in range(8)] + [(1, line), (1, line), (2, line)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = suffix_dedup.deduplicate(df, passes=passes)
    assert brute.sort_rows(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute.sort_rows(brute.deduplicated(docs))
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got.collect())


def _frequent_line(n):
    """Documents with one line in common, every other with one more neighbour in common, and a copy."""
    rng = random.Random(n)
    line = "all documents of this site share this one common line"
    some = ["".join(rng.choices("abcdefgh ", k=60)) + "\n" + line + "\n" + rng.choice(["", "and a second line that half of them share\n"])
            + "".join(rng.choices("abcdefgh ", k=60)) for _ in range(n)]
    return [*enumerate(some), (n, some[7]), (n, line + line), (n + 1, "z" * 900), (n + 2, "z" * 700)]


def test_frequent_line_is_sorted_in_bounded_parts(spark, monkeypatch):
    docs = _frequent_line(300)
    block, held, levels = 2000, [], []
    monkeypatch.setattr(suffix_dedup, "owners", lambda text, *rest, f=suffix_dedup.owners: held.append(len(text)) or f(text, *rest))
    frags = pa.RecordBatch.from_pylist([{"doc_id": i, "key": i, "first": 0, "text": t} for i, t in docs])
    spans = {}
    for gram in suffix_dedup.GRAMS:
        rows = pa.Table.from_batches(suffix_dedup._cut(0, 1, gram)([frags])).sort_by([("mini", "ascending"), ("frag", "ascending"), ("doc_id", "ascending")])
        out = pa.Table.from_batches(suffix_dedup._sort(block, gram == suffix_dedup.WIDTH)(rows.to_batches(20)))
        levels.append((rows.num_rows, out.num_rows - out["frag"].null_count))
        for r in out.to_pylist():
            if r["frag"] is None:
                spans.setdefault(r["doc_id"], []).append(r)
        more = out.filter(pa.compute.is_valid(out["frag"])).rename_columns(["doc_id", "key", "first", "end", "text"])
        frags = more.combine_chunks().to_batches()[0] if more.num_rows else None
        if frags is None:
            break
    assert levels[0][1] and max(held) < block + 20 * (suffix_dedup.LONGEST + suffix_dedup.WIDTH)
    want = {d: gone for d, _, gone, *_ in brute.deduplicated([x for x in docs if x[0] != 300])}
    got = {d: sum(b - a for a, b in suffix_dedup.merged(spans.get(d, []))) for d in want}
    assert got == want


@pytest.mark.parametrize("passes", [1, 2])
def test_large_buckets_are_dealt_again(spark, passes):
    docs = _frequent_line(120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.deduplicate(df, passes=passes, block=500).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert brute.sort_rows(got.collect()) == brute.sort_rows(brute.deduplicated(docs))


@pytest.mark.parametrize(("distance", "segments", "small"), [(2, 16, 64), (2, 16, 1), (1, 8, 2), (3, 20, 2), (0, 16, 64)])
def test_pigeonring_loses_no_link(spark, distance, segments, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(distance)
    centre = rng.getrandbits(64)
    marks = {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1, 2**63}
    for _ in range(200):  # a large group of near copies
        marks.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    got = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"), distance, segments).collect()
    pairs = {frozenset(((u, v))) for u, v in ((r.u, r.v) for r in got)}
    want = {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    assert pairs == want and len(got) == len(pairs)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5), (7, 8), (8, 7)]
    edges += [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(50)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_one_of_each_keeps_columns_and_null_ids(spark):
    text = "a text of some words that is repeated in full"
    docs = spark.createDataFrame(
        [(None, text, "x", 1), (4, text, "y", 2), (4, text, "y", 2), (9, text.upper(), "z", 3), (1, "another text altogether", "w", 4), (None, "", "v", 5)],
        "doc_id long, text string, fp string, root int")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert brute.sort_rows(got.collect()) == brute.sort_rows([(4, text, "y", 2), (1, "another text altogether", "w", 4), (None, "", "v", 5)])


def test_weights_move_tokens_and_shortages_stay_among_siblings(spark):
    rows = [(f"{d}{s}{i}", "w " * 10, lang, f"{s}", d) for d in ("p", "q") for lang in ("en", "de") for s in ("s1", "s2")
            for i in range(2 if (d, lang, s) == ("p", "en", "s1") else 40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, copies string").withColumnRenamed("copies", "dom")
    tokens, leaves = mixing.plan(docs, 0.5, 1, 3, {"domain": {"p": 3.0, "q": 1.0}}, F.col("dom"))
    got = {(r.domain, r.lang, r.source): r.budget for r in leaves.collect()}
    total = sum(len(r[1].split()) for r in rows) // 2
    by_domain = {d: sum(b for k, b in got.items() if k[0] == d) for d in "pq"}
    assert abs(by_domain["p"] - 0.75 * total) <= 4 and abs(by_domain["q"] - 0.25 * total) <= 4
    assert got["p", "en", "s1"] == 20 and got["p", "en", "s2"] == 400  # its sibling takes the shortage, as far as it can
    assert abs(got["p", "de", "s1"] - got["p", "de", "s2"]) <= 1
    mixed = mixing.mix(docs, 0.5, 1, 3, {"domain": {"p": 3.0, "q": 1.0}}, F.col("dom"))
    assert mixed.columns == docs.columns
    used = {(r.dom, r.lang, r.source): r.n for r in mixed.groupBy("dom", "lang", "source").agg((F.count("*") * 10).alias("n")).collect()}
    assert all(abs(b - used.get(k, 0)) < 10 for k, b in got.items())
    assert 0 <= total - sum(used.values()) < 10  # what no whole document of a leaf fits is handed on
    assert mixed.exceptAll(docs).count() == 0


def test_unused_tokens_go_to_siblings_before_ancestors(spark):
    schema = "domain string, lang string, source string, tokens long, epochs int, used long, next_key string, next_tokens long, lang_budget long, domain_budget long, total_budget long"
    leaves = spark.createDataFrame([
        ("a", "x", "1", 100, 0, 40, "k", 8, 100, 130, 200),   # x has 10 left: they pay the smaller of its two documents
        ("a", "x", "2", 100, 0, 50, "k", 9, 100, 130, 200),
        ("a", "y", "3", 100, 0, 25, "k", 7, 30, 130, 200),    # y's 5 and x's 2 together pay y's offer in the domain
        ("b", "z", "4", 100, 0, 60, "k", 20, 70, 70, 200),    # 10 left in the whole tree pay x's other one, not this one
        ("b", "z", "5", 0, 0, None, None, None, 70, 70, 200),
    ], schema)
    assert sorted(map(tuple, mixing.hand_on(leaves).collect())) == [("a", "x", "1"), ("a", "x", "2"), ("a", "y", "3")]
    assert mixing.hand_on(leaves.limit(0)).collect() == []


def test_thousand_named_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "en", f"src{i % 3}") for i in range(60)], "doc_id long, text string, lang string, source string")
    named = {"source": {f"s{i}": 2.0 for i in range(1500)} | {"src1": 4.0}}
    _, leaves = mixing.plan(docs, 0.3, 1, 3, named)
    got = {r.source: r.budget for r in leaves.collect()}
    assert got["src1"] > 3 * got["src0"] and got["src0"] == got["src2"]


def test_many_leaves_meet_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "en", f"src{i % 5}") for i in range(200)], "doc_id long, text string, lang string, source string")
    want = mixing.mix(docs, 1.3, 3).collect()
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert brute.sort_rows(mixing.mix(docs, 1.3, 3).collect()) == brute.sort_rows(want)
    with pytest.raises(ValueError):
        mixing.plan(docs, 1.0, 1, 1, {"source": {"src1": 0.0}})


def test_rendezvous_weights_and_growth(spark):
    docs = spark.range(20000).withColumnRenamed("id", "k").withColumn("shard", F.lit("old"))
    got = sharding.assign(docs, ["k"], [1.0, 2.0, 0.0, 1.0], next_weight=4.0).collect()
    share = np.bincount([r.shard for r in got], minlength=4) / len(got)
    assert np.allclose(share, [0.25, 0.5, 0, 0.25], atol=0.02)
    moved = [r for r in got if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {4} and abs(len(moved) / len(got) - 0.5) < 0.02
    with pytest.raises(ValueError):
        sharding.choose_shard(F.lit("a"), [0.0])


def test_composite_keys_do_not_run_together(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc")], "x string, y string")
    keys = [r[0] for r in rows.select(sharding.record_key(["x", "y"])).collect()]
    assert len(set(keys[:3])) == 3 and keys[2] == keys[3]


def test_licence_variants(spark):
    mit = licenses.TEMPLATES["mit-text"]
    docs = spark.createDataFrame(
        [(1, "a first line\nlicensed UNDER the apache licence version 2.0\na last line", 0), (2, mit.replace("Software", "Program", 1).replace(". ", ".\n"), 0),
         (3, "Released under the", 0), (4, None, 0), (5, "license", 0), (6, mit + " " + "word " * 200, 0)], "doc_id long, text string, score int")
    got = {(r.doc_id, r.first_line, r.last_line, r.license): r.score for r in licenses.scan(docs).collect()}
    assert set(got) == {(1, 1, 1, "apache-2.0"), (2, 0, 0, "mit-text")}
    assert got[1, 1, 1, "apache-2.0"] == 1.0 and 0.9 < got[2, 0, 0, "mit-text"] < 1


def test_size_bounds_lose_no_match():
    loose = licenses.Templates(licenses.TEMPLATES, 0.85)
    for name, text in licenses.TEMPLATES.items():
        words = sum(licenses.lines_of(text), [])
        for cut in range(len(words)):
            part = words[cut:]
            best = max((2 * sum((brute.Counter(zip(part, part[1:])) & brute.Counter(zip(w, w[1:]))).values()) / (len(part) + len(w) - 2)
                        for w in [sum(licenses.lines_of(t), []) for t in licenses.TEMPLATES.values()] if len(part) > 1), default=0)
            found = loose.best(part)
            assert (found is not None) == (best >= 0.85) and (found is None or abs(found[1] - best) < 1e-12), name


def _windows(words, templates, least):
    """All windows of words against all templates, the best first, none that overlaps a better one."""
    found = []
    for name, text in templates.items():
        want = sum(licenses.lines_of(text), [])
        m, counts = len(want) - 1, brute.Counter(zip(want, want[1:]))
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                part = words[a:b]
                common = sum((brute.Counter(zip(part, part[1:])) & counts).values())
                score = 2 * common / (b - a - 1 + m)
                if score >= least:
                    found.append((-(3 * common - (b - a - 1) - m), name, a, b, score))
    kept = []
    for _, name, a, b, score in sorted(found):
        if all(b <= x or y <= a for x, y, _, _ in kept):
            kept.append((a, b, name, score))
    return sorted(kept)


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_those_of_all_windows(seed):
    rng = random.Random(seed)
    templates = {"a": "one two three four", "b": "one two three four one two five one two", "c": "two three two three two three", "d": "five six"}
    least = rng.choice([0.7, 0.85, 1.0])
    known = licenses.Templates(templates, least)
    for _ in range(60):
        words = []
        while len(words) < 30:
            words += rng.choice([rng.choice([*templates.values()]).split(), [rng.choice(["one", "two", "three", "four", "five", "six", "x"])]])
        got, want = known.within(words), _windows(words, templates, least)
        assert [w[:3] for w in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_licences_within_lines_and_across_paragraphs(spark):
    header = licenses.TEMPLATES["apache-2.0-header"].replace("You may obtain", "\n\n You may obtain").replace("Unless", "\n\nUnless")
    docs = spark.createDataFrame([
        (1, "This project is licensed under the Apache License, Version 2.0."), (2, "This library is released under the MIT License."),
        (3, "Released under the MIT License. See LICENSE for details."), (4, header + "\n\ndef code():\n    return 1\n" * 30),
        (5, "word " * 300 + licenses.TEMPLATES["mit-text"] + " word" * 300 + " " + licenses.TEMPLATES["isc"]),
        (6, "no license\n\nin the text of this software"), (7, "Released under\nthe MIT License."), (8, "Licensed under the BSD License.")], "doc_id long, text string")
    got = sorted((r.doc_id, r.first_line, r.last_line, r.license) for r in licenses.scan(docs, within=True).collect())
    assert got == [(1, 0, 0, "apache-2.0"), (2, 0, 0, "mit"), (3, 0, 0, "mit"), (4, 0, 4, "apache-2.0-header"), (5, 0, 0, "isc"),
                   (5, 0, 0, "mit-text"), (7, 0, 1, "mit"), (8, 0, 0, "bsd-notice")]


def test_every_whole_licence_is_found_alone_and_in_a_longer_document(spark):
    texts = {k: t for k, t in licenses.whole_texts().items() if k not in licenses.TEMPLATES}
    assert {"apache-2.0-full", "bsd-2-clause-full", "bsd-3-clause", "gpl-2.0", "gpl-3.0-full", "isc-full", "lgpl-2.1", "lgpl-3.0", "mit-full", "mpl-2.0-full"} <= set(texts)
    around = "some other words of a long file that say nothing of the kind\n\n" * 120
    rows = [(k, t) for k, t in texts.items()] + [(f"{k} within", around + t + "\n" + around) for k, t in texts.items()]
    rows += [(f"{k} joined", " ".join((around + t + around).split())) for k, t in texts.items()]
    got = licenses.scan(spark.createDataFrame(rows, "file string, text string").repartition(4), licenses.whole_texts(), within=True).collect()
    for name in texts:
        for kind in (name, f"{name} within", f"{name} joined"):
            assert max((r.score for r in got if r.file == kind and r.license == name), default=0) > 0.99, kind


def test_pieces_bound_bytes():
    from roadworthy.llm.arrow import pieces

    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (3, 3, 10, 1, 1)] + [None]})
    assert [p.column("t").to_pylist() for p in pieces(iter([batch]), "t", 6)] == [["aaa", "aaa"], ["a" * 10], ["a", "a", None]]
