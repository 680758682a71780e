"""The corpus pipeline: every stage on awkward and generated documents against a plain version."""

from __future__ import annotations

from collections import Counter, defaultdict

import brute
import pytest

import corpus_pipeline
from roadworthy.llm.queries import MIX_SEED, SHARDS, SIMHASH_BITS, SIMHASH_SHINGLE, mix_sql
from test_queries import awkward, empty, folder  # noqa: F401

SF0001 = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("where", ["awkward", SF0001])
def test_every_stage(spark, where, request, tmp_path):
    import duckdb

    d = folder(where, request)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = f"{tmp_path}/{name}"
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        made[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == before.columns
            assert not rows_of(docs) - rows_of(before)  # a subset, repeats included

    before, after = made["near_duplicates"]
    texts = [(r.doc_id, r.text) for r in before.collect()]
    groups = brute.linked([brute.simhash(t, SIMHASH_SHINGLE) for _, t in texts], SIMHASH_BITS)
    least = defaultdict(list)
    for (i, _), g in zip(texts, groups):
        least[g].append((i is None, i or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in after.collect()) == Counter(min(v) for v in least.values())

    before, after = made["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = brute.decontaminated([(r.doc_id, r.text) for r in before.collect()], items)
    assert Counter(r.doc_id for r in after.collect()) == Counter(i for i, *_, dirty in clean if not dirty)

    before, after = made["mixing"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/decontamination/*.parquet')")
    want = con.execute(f"SELECT doc_id, copies FROM ({mix_sql(corpus_pipeline.MIX_SHARE, 1, MIX_SEED)})").fetchall()
    assert all(n == 1 for _, n in want)
    assert Counter(r.doc_id for r in after.collect()) == Counter(i for i, _ in want)

    before, after = made["sharding"]
    kept = [c for c in before.columns if c != "shard"]  # replaced by the stage's own
    assert rows_of(after.select(*kept)) == rows_of(before.select(*kept))
    slots = defaultdict(list)
    for r in after.collect():
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(SHARDS))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_applies_all_stages(spark, request):
    got = corpus_pipeline.run(spark, SF0001)
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF0001)
    assert rows_of(got.drop("slot")) == rows_of(docs.drop("slot"))


def test_quality_stage_keeps_good_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, d).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = [i for i, q in label.items() if q == 1]
    bad = [i for i, q in label.items() if q == 0]
    assert len(kept & set(good)) >= 0.98 * len(good) and len(kept & set(bad)) <= 0.1 * len(bad)


def test_empty_documents(spark, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, empty).collect() == []
