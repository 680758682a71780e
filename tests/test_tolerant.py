"""Junk values end to end, and folders on a cluster."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.operators import facts, segments
from roadworthy.session import ensure_checkpoint_dir, shared_dir
from roadworthy.sources.bindings import Sources

VEHICLES = [("A1", "Personenauto", "X", "M", "20000101", "1000", None), ("A2", "Personenauto", "X", "M", "onbekend", "n/a", None),
            ("A3", "Bedrijfsauto", "Y", None, "20050101", "duur", None)]
REPORTS = [("A1", "20200101", "900", "periodieke controle", None), ("A1", "kapot", "900", "periodieke controle", None),
           ("A2", "20200101", "900", "periodieke controle", None), ("A3", "20200101", "1000", "periodieke controle", None)]
DEFECTS = [("A1", "20200101", "900", "203", "veel"), ("A1", "20200101", "900", "999", "2"), ("A3", "20200101", "1000", "203", None)]


def tables(spark):
    text = lambda *names: ", ".join(f"{n} string" for n in names)
    return Sources(
        vehicles=spark.createDataFrame(VEHICLES, text(P.KENTEKEN, P.VOERTUIGSOORT, P.MERK, P.HANDELSBENAMING,
                                                      P.DATUM_EERSTE_TOELATING, P.CATALOGUSPRIJS, P.VERVALDATUM_APK)),
        inspections=spark.createDataFrame(REPORTS, text(P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.SOORT_MELDING, P.VERVALDATUM_KEURING)),
        defects=spark.createDataFrame(DEFECTS, text(P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.GEBREK_ID, P.AANTAL_GEBREKEN)),
        codes=spark.createDataFrame([("203", "band"), ("203", "banden")], text(P.GEBREK_ID, P.GEBREK_OMSCHRIJVING)),
        fuel=spark.createDataFrame([("A1", "Diesel")], text(P.KENTEKEN, P.BRANDSTOF)),
    )


def test_junk_ends_a_strict_run_and_is_replaced_in_a_tolerant_one(spark):
    src = tables(spark)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel).collect()
    fact = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel, on_bad="one")
    got = {(r[P.KENTEKEN], r[P.MELD_DATUM]): (r["defect_count"], r[P.CATALOGUSPRIJS], r["age_at_inspection"]) for r in fact.collect()}
    assert got == {("A1", "20200101"): (3, 1000.0, 20), ("A3", "20200101"): (1, 0.0, 15)}
    rejected = {(r["table"], r["column"], r["value"]): r["rows"]
                for r in facts.rejected_values(src.inspections, src.vehicles, src.defects).collect()}
    assert rejected == {("meldingen", P.MELD_DATUM, "kapot"): 1, ("voertuigen", P.DATUM_EERSTE_TOELATING, "onbekend"): 1,
                        ("voertuigen", P.CATALOGUSPRIJS, "n/a"): 1, ("voertuigen", P.CATALOGUSPRIJS, "duur"): 1,
                        ("geconstateerde_gebreken", P.AANTAL_GEBREKEN, "veel"): 1}


def test_tolerant_command_line(spark, tmp_path):
    from roadworthy.__main__ import main

    src = tables(spark)
    for name, df in (("voertuigen", src.vehicles), ("meldingen", src.inspections), ("geconstateerde_gebreken", src.defects),
                     ("gebreken", src.codes), ("brandstof", src.fuel)):
        df.write.parquet(f"{tmp_path}/in/{name}.parquet")
    paths = main(["--tables", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--on-bad", "one"])
    assert len(paths) == 9 and spark.read.json(paths["rejected_values"]).count() == 5
    top = spark.read.json(paths["defect_stats"]).first()
    assert [(d["defect_code"], d["defect_description"], d["count"]) for d in top["top_defects"]] == [
        ("203", "banden", 2), ("999", P.UNKNOWN_DEFECT_DESCRIPTION, 2)]
    meta = json.loads(spark.read.text(paths["metadata"]).first()[0])
    assert meta["pipeline_stage"] == 2 and meta["source"]


def test_segments_from_moments_keep_fractions(spark):
    fact = spark.createDataFrame([(str(i), "X", "M", "consumer", "Diesel", 3, 1, 0.1) for i in range(3)],
                                 f"{P.KENTEKEN} string, {P.MERK} string, {P.HANDELSBENAMING} string, vehicle_type_group string, "
                                 f"primary_fuel string, age_at_inspection int, defect_count bigint, {P.CATALOGUSPRIJS} double")
    r = segments.brand_segments(fact, 1).first()
    assert r["sum_defects_per_vehicle_year_rates"] == pytest.approx(1.0, abs=1e-15)
    assert r["sum_sq_defects_per_vehicle_year_rates"] == pytest.approx(1 / 3, abs=1e-15)


class _Cluster:
    """A session on a cluster without a shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

        @staticmethod
        def getConf():
            return {}

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Cluster())
    assert os.path.basename(shared_dir(spark, "x")).startswith("x-")


def test_expiry_of_equal_times_is_the_earliest_given(spark):
    rows = [("A", "20200101", "900", "periodieke controle", e) for e in ("20230101", None, "20220101")]
    reports = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in (
        P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.SOORT_MELDING, P.VERVALDATUM_KEURING)))
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in (
        P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.GEBREK_ID, P.AANTAL_GEBREKEN)))
    one = facts.primary_inspections(reports, with_expiry=True).first()[P.VERVALDATUM_KEURING]
    two = facts.primary_reports_with_counts(reports, none, with_expiry=True).first()[P.VERVALDATUM_KEURING]
    assert one == two == "20220101"


def test_least_file_size_of_each_table(spark, tmp_path):
    from roadworthy.sources import ingest as I

    spark.range(100).write.parquet(f"{tmp_path}/gebreken.parquet")
    got = {r["table"]: r["message"].split(":")[0] for r in I.table_file_checks(spark, str(tmp_path), ["gebreken", "brandstof"]).collect()}
    assert got == {"gebreken": "too small", "brandstof": "missing"}
    assert I.table_file_checks(spark, str(tmp_path), ["gebreken"], {"gebreken": 100}).first()["ok"]
