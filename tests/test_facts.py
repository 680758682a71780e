"""Fact build (A1-A5, J1-J3) on hand-made frames and on the bound test tables."""

from __future__ import annotations

import pytest
from conftest import SF001, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions import normalize as N
from roadworthy.operators import facts
from roadworthy.sources.bindings import bind

INSP = "kenteken string, meld_datum_door_keuringsinstantie string, meld_tijd_door_keuringsinstantie string, " \
       "soort_melding_ki_omschrijving string"
DEF = "kenteken string, meld_datum_door_keuringsinstantie string, meld_tijd_door_keuringsinstantie string, " \
      "gebrek_identificatie string, aantal_gebreken_geconstateerd string"
VEH = "kenteken string, voertuigsoort string, merk string, handelsbenaming string, datum_eerste_toelating string, " \
      "catalogusprijs string"
FUEL = "kenteken string, brandstof_omschrijving string"


def test_time_normalisation(spark):
    df = spark.createDataFrame([(None,), ("9",), ("930",), (" 1200\t",), ("12345",)], "t string")
    got = [r[0] for r in df.select(N.normalized_time(F.col("t"))).collect()]
    assert got == ["0000", "0009", "0930", "1200", "12345"]


def test_report_kind_strip_rule(spark):
    df = spark.createDataFrame([("\tPERIODIEKE CONTROLE \n",), ("Periodieke Controle",), ("tachograaf",), (None,)],
                               "k string")
    got = [r[0] for r in df.select(N.is_periodic_report(F.col("k"))).collect()]
    assert got == [True, True, False, None]


def test_primary_inspection_keeps_earliest_time(spark):
    insp = spark.createDataFrame([
        ("AB1", "20200101", "1300", "Periodieke controle"),
        ("AB1", "20200101", "930", "Periodieke controle"),
        ("AB1", "20200101", "0800", "tachograaf"),
        ("AB1", "20210101", "1000", "periodieke controle"),
    ], INSP)
    got = rows(facts.primary_inspections(insp), P.MELD_DATUM)
    assert [(r[P.MELD_DATUM], r[P.MELD_TIJD], r["insp_year"]) for r in got] == [
        ("20200101", "0930", 2020), ("20210101", "1000", 2021)]


def test_defect_counts_null_quantity_is_one(spark):
    d = spark.createDataFrame([
        ("AB1", "20200101", "930", "A1", None), ("AB1", "20200101", "0930", "A2", "3"),
    ], DEF)
    got = rows(facts.defect_counts(d))
    assert got == [{P.KENTEKEN: "AB1", P.MELD_DATUM: "20200101", P.MELD_TIJD: "0930", "defect_count": 4}]


def test_bad_quantity_strict_and_tolerant(spark):
    d = spark.createDataFrame([("AB1", "20200101", "0930", "A1", "x")], DEF)
    with pytest.raises((PySparkException, Exception)):
        facts.defect_counts(d).collect()
    got = rows(facts.defect_counts(d, on_bad="one"))
    assert got[0]["defect_count"] == 1


def test_bad_year_is_strict(spark):
    insp = spark.createDataFrame([("AB1", "20x00101", "0930", "Periodieke controle")], INSP)
    with pytest.raises(Exception):
        facts.primary_inspections(insp).collect()


@pytest.mark.parametrize("fuels,expected", [
    (["LPG", "Elektriciteit"], "LPG"),
    (["Elektriciteit", "Diesel"], "Hybrid"),
    (["Elektriciteit"], "Elektriciteit"),
    (["Diesel", "Benzine"], "Diesel"),
    ([None], "Other"),
])
def test_primary_fuel_precedence(spark, fuels, expected):
    f = spark.createDataFrame([("AB1", x) for x in fuels], FUEL)
    assert rows(facts.primary_fuel(f))[0]["primary_fuel"] == expected


def test_vehicle_without_fuel_rows_is_other(spark):
    insp = spark.createDataFrame([("AB1", "20200101", "0930", "Periodieke controle")], INSP)
    veh = spark.createDataFrame([("AB1", "Personenauto", "vw", "golf", "20100101", None)], VEH)
    d = spark.createDataFrame([], DEF)
    f = spark.createDataFrame([], FUEL)
    got = rows(facts.inspection_stats(insp, veh, d, f))
    assert got[0]["primary_fuel"] == "Other" and got[0]["defect_count"] == 0
    assert got[0][P.CATALOGUSPRIJS] == 0.0 and got[0]["age_at_inspection"] == 10
    assert got[0][P.MERK] == "VW"


def test_duplicate_vehicle_deterministic(spark):
    veh = spark.createDataFrame([
        ("AB1", "Personenauto", "Zeta", "x", "20100101", "100"),
        ("AB1", "Personenauto", "alfa", "y", "20110101", "200"),
        ("AB2", "Motorfiets", "moto", "z", "20100101", "1"),
    ], VEH)
    got = rows(facts.vehicle_attributes(veh))
    assert len(got) == 1 and got[0][P.MERK] == "ALFA" and got[0]["vehicle_type_group"] == "consumer"


def test_age_sanity_range_drops_rows(spark):
    insp = spark.createDataFrame([
        ("AB1", "20090101", "0930", "Periodieke controle"),  # before registration
        ("AB1", "20200101", "0930", "Periodieke controle"),
    ], INSP)
    veh = spark.createDataFrame([("AB1", "Bedrijfsauto", "vw", "golf", "20100101", "5")], VEH)
    got = rows(facts.inspection_stats(insp, veh, spark.createDataFrame([], DEF), spark.createDataFrame([], FUEL)))
    assert [r["insp_year"] for r in got] == [2020]
    assert got[0]["vehicle_type_group"] == "commercial"


def test_bound_fact_counts_match_fixtures(spark):
    src = bind(spark, SF001)
    fact = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel)
    r = fact.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(P.KENTEKEN).alias("v"),
                 F.sum("defect_count").alias("d")).first()
    assert (r["n"], r["v"], r["d"]) == (17_798, 1_306, 28_713)


def test_fact_plan_prunes_scan_columns(spark):
    src = bind(spark, SF001)
    fact = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel)
    plan = fact._jdf.queryExecution().executedPlan().toString()
    # lineitem is read with only the columns the binding needs
    assert "l_extendedprice" not in plan


def test_folded_reduction_equals_three_steps(spark):
    src = bind(spark, SF001)
    folded = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel)
    steps = facts.join_fact(facts.primary_inspections(src.inspections), facts.vehicle_attributes(src.vehicles),
                            facts.primary_fuel(src.fuel), facts.defect_counts(src.defects))
    assert folded.exceptAll(steps).count() == 0 and steps.exceptAll(folded).count() == 0
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(meld_tijd" not in plan  # no sort-based aggregate over raw reports


def test_folded_reduction_edge_cases(spark):
    insp = spark.createDataFrame([
        ("AB1", "20200101", "1300", "Periodieke controle"),
        ("AB1", "20200101", "930", "Periodieke controle"),
        ("AB1", "20200101", "0800", "tachograaf"),
    ], INSP)
    d = spark.createDataFrame([
        ("AB1", "20200101", "0930", "A", "2"), ("AB1", "20200101", "930", "B", None),
        ("AB1", "20200101", "1300", "C", "5"), ("AB1", "20200101", "0800", "D", "7"),
        ("AB1", "20200102", "0930", "E", "1"),
    ], DEF)
    got = rows(facts.primary_reports_with_counts(insp, d))
    assert got == [{P.KENTEKEN: "AB1", P.MELD_DATUM: "20200101", P.MELD_TIJD: "0930", "defect_count": 3,
                    "insp_year": 2020}]


def test_logical_tables_load_and_match_binding(spark):
    from roadworthy.session import shared_dir
    from roadworthy.sources import tables

    src = bind(spark, SF001)
    base = shared_dir(spark, "logical")
    landed = {"voertuigen": src.vehicles, "meldingen": src.inspections.drop(P.VERVALDATUM_KEURING),
              "geconstateerde_gebreken": src.defects, "gebreken": src.codes, "brandstof": src.fuel}
    for name, df in landed.items():
        df.write.parquet(f"{base}/{name}.parquet")
    loaded = tables.load_sources(spark, base)
    assert loaded.inspections.columns[-1] == P.VERVALDATUM_KEURING  # missing optional column -> null
    a = facts.inspection_stats(loaded.inspections, loaded.vehicles, loaded.defects, loaded.fuel)
    b = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
