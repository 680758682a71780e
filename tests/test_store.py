"""The stored, refreshable fact."""

from __future__ import annotations

from dataclasses import replace

import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.operators import facts, segments
from roadworthy.plans.pipeline import documents, run_statistics
from roadworthy.session import session_setting, temporary_dir
from roadworthy.sources.bindings import Sources, bind
from roadworthy.sources.fact_store import SHARD, FactStore


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _fact(src):
    return facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel)


@pytest.fixture
def store(spark):
    with temporary_dir(spark, "store-test") as base:
        made = FactStore(spark, base, buckets=4)
        yield made
        made.forget()


def _files(spark, store, table):
    """Every data file of a stored table with its time of writing."""
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.base}/{table}/*/*.parquet")
    fs = jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(f.getPath()): f.getModificationTime() for f in fs.globStatus(jp)}


def test_unchanged_inputs_rewrite_nothing_and_changed_prefixes_only_themselves(spark, store):
    src = bind(spark, SF0001)
    first = store.refresh(src)
    assert set(first.rewritten) == {"reports", "vehicles", "fuel", "fact"}
    assert _rows(store.fact()) == _rows(_fact(src).select(*store.fact().columns))
    before = {t: _files(spark, store, t) for t in store.names}
    again = store.refresh(src)
    assert again.rewritten == {} and {t: _files(spark, store, t) for t in store.names} == before
    # One plate's price changes: only its prefix of the vehicles and the fact is rewritten.
    plate = F.col(P.KENTEKEN) == F.lit("17")
    changed = replace(src, vehicles=src.vehicles.withColumn(P.CATALOGUSPRIJS, F.when(plate, F.lit("5")).otherwise(F.col(P.CATALOGUSPRIJS))))
    done = store.refresh(changed)
    assert done.rewritten == {"vehicles": ["1"], "fact": ["1"]}
    after = {t: _files(spark, store, t) for t in store.names}
    assert after["reports"] == before["reports"] and after["fuel"] == before["fuel"]
    same = lambda files: {f: t for f, t in files.items() if f"{SHARD}=1/" not in f}
    assert same(after["fact"]) == same(before["fact"]) and after["fact"] != before["fact"]
    assert _rows(store.fact()) == _rows(_fact(changed).select(*store.fact().columns))


def test_joins_of_stored_inputs_need_no_exchange(spark, store):
    src = bind(spark, SF0001)
    store.refresh(src)
    with session_setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = store.joined()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Bucketed: true" in plan
        some = store.joined(["1"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in some and "PartitionFilters: [(shard" in some or "PartitionFilters: [isnotnull(shard" in some


def _small(spark, vehicles, reports):
    text = lambda names: ", ".join(f"{n} string" for n in names)
    return Sources(
        vehicles=spark.createDataFrame(vehicles, text([P.KENTEKEN, P.VOERTUIGSOORT, P.MERK, P.HANDELSBENAMING, P.DATUM_EERSTE_TOELATING,
                                                       P.CATALOGUSPRIJS])),
        inspections=spark.createDataFrame(reports, text([P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.SOORT_MELDING])),
        defects=spark.createDataFrame([], text([P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.GEBREK_ID, P.AANTAL_GEBREKEN])),
        codes=spark.createDataFrame([], text([P.GEBREK_ID, P.GEBREK_OMSCHRIJVING])),
        fuel=spark.createDataFrame([], text([P.KENTEKEN, P.BRANDSTOF])),
    )


def test_vanished_prefixes_odd_plates_and_empty_inputs(spark, store):
    car = lambda k: (k, P.KIND_PASSENGER, "vw", "golf", "20100101", None)
    seen = lambda k, day="20200101": (k, day, "930", "periodieke controle")
    plates = ["A1", "B1", "b2", "-3", None, ""]
    full = _small(spark, [car(k) for k in plates], [seen(k) for k in plates])
    assert store.refresh(full).rewritten["fact"] == ["A", "B", "other"]
    assert _rows(store.fact()) == _rows(_fact(full).select(*store.fact().columns))
    less = _small(spark, [car(k) for k in plates], [seen(k) for k in plates if k != "B1"])
    done = store.refresh(less)
    assert done.rewritten == {"reports": [], "fact": []} and done.dropped == {"reports": ["B"], "fact": ["B"]}
    assert _rows(store.fact()) == _rows(_fact(less).select(*store.fact().columns))
    # A new session's catalog finds the files again.
    store.forget()
    reopened = FactStore(spark, store.base, buckets=4)
    assert _rows(reopened.fact()) == _rows(_fact(less).select(*store.fact().columns))
    none = _small(spark, [], [])
    assert set(reopened.refresh(none).dropped["fact"]) == {"A", "B", "other"} - {"B"} | {"B"}
    assert reopened.fact().collect() == [] and reopened.refresh(none).rewritten == {}


def test_a_run_on_the_stored_fact_publishes_the_same(spark, store):
    src = bind(spark, SF0001)
    with temporary_dir(spark, "run") as one, temporary_dir(spark, "run") as other:
        plain, stored = (documents(run_statistics(spark, src, P.TEST_SF0001, base_dir=d, store=s)) for d, s in ((one, None), (other, store)))
        for name, doc in plain.items():
            assert sorted(doc.toJSON().collect()) == sorted(stored[name].toJSON().collect()), name
    with pytest.raises(ValueError):
        run_statistics(spark, src, P.TEST_SF0001, exposure="coverage", store=store)
    with session_setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = segments.age_moments(store.fact(), clustered=True)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and f"hashpartitioning({P.KENTEKEN}" not in plan  # the partial sums alone
