"""The vantage-point search prunes, keeps its recall on any table, and defines repeated query ids."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadworthy.llm import vptree
from roadworthy.llm.queries import ANN_K, ANN_RECALL

SF01 = "/root/testdata/sf0.1"


def recall(got, want, k):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(found.get(q, set()) & {i for i, _ in w[:k]}) for q, w in want.items()) / sum(len(w[:k]) for w in want.values())


def test_whole_table_is_pruned(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute.nearest(rows, ANN_K)
    trees = vptree.index(df, rows=800).persist()
    asked = vptree.asked_rows(df.where("vec_id % 100 = 0"))
    factor = vptree.choose_factor(trees, asked, ANN_K, ANN_RECALL)
    assert factor > 3
    measured = {}
    for f in (1.0, factor):
        found = vptree.visits(trees, asked, ANN_K, f)
        measured[f] = found.agg(F.sum("measured")).first()[0] / (asked.count() * len(rows))
    assert measured[factor] < 0.9 and measured[1.0] <= 1
    assert recall(vptree.search(trees, asked, ANN_K, 1.0).collect(), want, ANN_K) == 1
    assert recall(vptree.search(trees, asked, ANN_K, factor).collect(), want, ANN_K) >= 0.93


@pytest.mark.parametrize("dims", [2, 10])
def test_factor_suits_the_table(spark, dims):
    rng = np.random.default_rng(dims)
    data = rng.normal(size=(1000, dims)).round(3)
    data[400:520] = data[100]  # copies: the tenth neighbour of one query is at distance zero
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(df, df.where("vec_id % 100 = 0"), k=10, factor=None, recall=0.96, rows=300).collect()
    assert recall(got, brute.nearest(rows, 10), 10) >= 0.95
    with pytest.raises(ValueError):
        vptree.choose_factor(vptree.index(df), vptree.asked_rows(df), 10, 0.0)


def test_repeated_query_id_is_one_query_of_all_its_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(400)] + [(100, [9.0, 9.0, 9.0, 9.0]), (100, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(df, df.where("vec_id = 100"), k=6, rows=100, block=1).orderBy("rank").collect()
    pairs = {(float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for n, q in rows if n == 100 for i, v in rows if i != 100}
    assert [(r.vec_id, r["rank"]) for r in got] == [(i, n + 1) for n, (_, i) in enumerate(sorted(pairs)[:6])]
    assert np.allclose([r.score for r in got], [d for d, _ in sorted(pairs)[:6]])
