"""Indexed search, locale order, stored lookup and reduced joins."""

from __future__ import annotations

import random
import re

from conftest import SF0001, SF001, rows
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.operators import defects as D
from roadworthy.operators import explore as X
from roadworthy.operators import fuel as FU
from roadworthy.operators import lookup as L
from roadworthy.operators import search_index as S
from roadworthy.session import temporary_dir
from roadworthy.sources.bindings import Sources, bind
from roadworthy.sources.plate_store import PlateStore


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_indexed_search_equals_the_scan(spark):
    rnd = random.Random(5)
    words = ["red", "Redred", "ÉCLAIR", "b", "", "a b", "x_y", "100%", "été"]
    data = [(i, rnd.choice([None, *words]), rnd.choice([None, *words]) if i % 3 else " ".join(rnd.sample(words, 3))) for i in range(300)]
    view = spark.createDataFrame(data, "k int, merk string, model string")
    with temporary_dir(spark, "search") as base:
        index = S.build(view, ["k", "merk"], ["merk", "model"], f"{base}/index", files=4)
        for text in ("red", "REDR", "r", "é", "écl red", "_", "%", "a b", "nothing", "redredred", "ed d", "", "  "):
            want = view.where(X.multi_term_search(["merk", "model"], text))
            got = S.search(index, view, ["merk", "model"], text)
            assert rows(got, "k") == rows(want, "k"), text
        again = S.search(S.open_index(spark, f"{base}/index"), view, ["merk", "model"], "redr")
        assert again.count() == view.where(X.multi_term_search(["merk", "model"], "redr")).count() > 0
        plan = _plan(S.candidates(index, "redr x"))
        pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
        assert "In(piece, [edr,red])" in pushed and "StringStartsWith(piece,x)" in pushed
        empty = S.build(view.where("false"), ["k"], ["merk"], f"{base}/none")
        assert S.search(empty, view.where("false"), ["merk"], "red").collect() == []


def test_locale_order_and_search(spark):
    codes = ["zebra", "Éclair", "eclair", "Zoo", "b-2", "B#1", "Äpfel", "apfel", "10", "9"]
    idx = spark.createDataFrame([(c, "Rem " + c) for c in codes], "defect_code string, description string")
    got = [r.defect_code for r in D.code_search(idx, "", "nl").collect()]
    assert got == ["10", "9", "apfel", "Äpfel", "b-2", "B#1", "eclair", "Éclair", "zebra", "Zoo"]
    assert [r.defect_code for r in D.code_search(idx, "éCL", "UNICODE").collect()] == ["Éclair"]
    assert [r.defect_code for r in D.code_search(idx, "rem z").collect()] == ["Zoo", "zebra"]


def _scanned(df):
    """(rows that left the Parquet readers, files opened) of a collected frame."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    found = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("numOutputRows").value() for m in found), sum(m.apply("numFiles").value() for m in found)


def test_a_few_plates_open_few_row_groups(spark):
    plates = spark.range(200_000).select(
        F.concat(F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 3 + 1).cast("int")), F.lpad(F.col("id") * 2, 7, "0")).alias(P.KENTEKEN))
    reports = plates.select("*", F.lit("20200101").alias(P.MELD_DATUM), F.lit("0930").alias(P.MELD_TIJD), F.lit("x").alias(P.SOORT_MELDING),
                            F.lit(None).cast("string").alias(P.VERVALDATUM_KEURING))
    defects = reports.select(P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, F.lit("1").alias(P.GEBREK_ID), F.lit("1").alias(P.AANTAL_GEBREKEN)).limit(10)
    src = Sources(vehicles=plates, inspections=reports, defects=defects, codes=spark.range(0), fuel=spark.range(0))
    with temporary_dir(spark, "plates") as base:
        store = PlateStore(spark, base)
        store.write(src, files=24, distinct_plates=20_000, row_group_bytes=64_000)
        held, absent = "A" + f"{30_000 * 2:07d}", "A" + f"{30_000 * 2 + 1:07d}"
        found = store.find("inspections", [held])
        read, files = _scanned(found)
        assert found.count() == 1 and read < 15_000 and files <= 12  # one range of one prefix, of 200,000 rows and 24 files
        # A plate that no row has, though it lies within the range of a row group: the Bloom filter answers.
        assert _scanned(store.find("inspections", [absent]))[0] == 0
        assert store.find("inspections", []).collect() == []


def test_stored_lookup_equals_the_batch_lookup(spark):
    src = bind(spark, SF001)
    typed = ["10-01", " 12-34", "12.34", "17", None, "", "ZZ-99-99", "x'; --1"]
    with temporary_dir(spark, "plates") as base:
        store = PlateStore(spark, base)
        store.write(src)
        df = spark.createDataFrame([(t,) for t in typed], "typed_plate string")
        want = L.vehicle_history(df, src.inspections, src.defects, src.codes)
        got = store.history(typed, src.codes)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 10
        want = L.lookup_vehicles(df, src.vehicles, src.inspections, "2024-01-01")
        assert sorted(map(repr, store.vehicles(typed, "2024-01-01").collect())) == sorted(map(repr, want.collect()))


def test_a_repeated_plate_meets_itself_once(spark):
    fuel = spark.range(3000).select(F.lit("A").alias(P.KENTEKEN), F.when(F.col("id") % 3 == 0, "Diesel").otherwise("x").alias(P.BRANDSTOF))
    vehicles = spark.range(200).select(F.lit("A").alias(P.KENTEKEN), F.lit(" vw").alias(P.MERK), F.lit(None).cast("string").alias(P.HANDELSBENAMING))
    counted = {r.fuel_type: r.n for r in FU.fuel_with_vehicle_counts(fuel, vehicles).collect()}
    assert counted == {"Diesel": 1000 * 200, "other": 2000 * 200}
    got = FU.fuel_with_vehicle(fuel, vehicles).groupBy("fuel_type", P.MERK, P.HANDELSBENAMING).count().collect()
    assert {tuple(r) for r in got} == {("Diesel", "VW", None, 200_000), ("other", "VW", None, 400_000)}


def test_shares_of_all_defects_need_no_window_over_codes(spark):
    src = bind(spark, SF0001)
    top = D.top_defects(src.defects, src.codes, 5, denominator="all")
    assert "Window" not in _plan(top)
    assert sum(r.percentage for r in D.top_defects(src.defects, src.codes, 10 ** 6, denominator="all").collect()) > 99
