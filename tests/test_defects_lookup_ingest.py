"""Classifier, filter modes, lookup and ingest checks on hand-made frames."""

from __future__ import annotations

from conftest import rows
import pytest
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions import classify as C
from roadworthy.functions import formatting as FM
from roadworthy.operators import defects as D
from roadworthy.operators import lookup as L
from roadworthy.session import shared_dir
from roadworthy.sources import ingest as I

CODES = "gebrek_identificatie string, gebrek_omschrijving string"
INSP = ("kenteken string, meld_datum_door_keuringsinstantie string, meld_tijd_door_keuringsinstantie string, "
        "soort_melding_ki_omschrijving string")
DEF = ("kenteken string, meld_datum_door_keuringsinstantie string, meld_tijd_door_keuringsinstantie string, "
       "gebrek_identificatie string, aantal_gebreken_geconstateerd string")


def test_classifier_examples(spark):
    df = spark.createDataFrame([("203",), (" ac1 ",), ("AC3",), ("OP7",), ("AP1",), ("999",), (None,)], "c string")
    got = [r[0] for r in df.select(C.is_reliability(F.col("c"))).collect()]
    assert got == [False, False, True, False, False, True, True]
    cats = [r[0] for r in df.select(C.wear_category(F.col("c"))).collect()]
    assert cats == ["tires", "tires", None, "administrative", "administrative", None, None]


def test_wear_code_list_size():
    assert len(C.ALL_WEAR_CODES) == 68 and len(set(C.ALL_WEAR_CODES)) == 68


def test_overrides_win(spark):
    df = spark.createDataFrame([("203",), ("999",)], "c string")
    got = [r[0] for r in df.select(C.computed_is_reliability(F.col("c"), None, {"203": True, "999": False})).collect()]
    assert got == [True, False]


@pytest.mark.parametrize("turn", [1, -1])
def test_code_index_of_repeated_codes_ignores_layout(spark, turn):
    data = [("1", "old"), ("1", "new"), ("1", None), ("", "empty"), (None, "null"), ("2", None)][::turn]
    codes = spark.createDataFrame(data, CODES).repartition(3)
    got = {r["defect_code"]: r["description"] for r in D.code_index(codes).collect()}
    assert got == {"1": "old", "2": ""}


def test_top_defects_of_repeated_codes(spark):
    codes = spark.createDataFrame([("1", "a"), ("1", "b")], CODES)
    defects = spark.createDataFrame([("P", "20200101", "1000", "1", "3")],
                                    ", ".join(f"{c} string" for c in (P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.GEBREK_ID, P.AANTAL_GEBREKEN)))
    assert [(r["defect_description"], r["count"]) for r in D.top_defects(defects, codes).collect()] == [("b", 3)]


def test_filtered_defects_are_exact(spark):
    """One of three defects included: 3,000,000 defects leave exactly 1,000,000."""
    from roadworthy.operators import explore as X

    seg = spark.createDataFrame(
        [("VW", "consumer", "Benzine", 10, 100, 3_000_000.0, 50.0, 1.0, 1.0, 1.0, 1.0, 1)],
        "merk string, vehicle_type_group string, primary_fuel string, vehicle_count bigint, total_inspections bigint, "
        "total_defects double, total_vehicle_years double, sum_defects_per_vehicle_year_rates double, "
        "sum_sq_defects_per_vehicle_year_rates double, sum_sq_defect_counts double, sum_catalog_price double, count_with_price bigint")
    bd = spark.createDataFrame([("VW", "203", 2), ("VW", "999", 1)], "merk string, defect_code string, count bigint")
    ex = spark.createDataFrame([("203",)], "defect_code string")
    got = X.explore_segments(seg, X.ViewFilter(), ratios=D.filtered_ratio(bd, [P.MERK], ex, "reliability")).first()
    assert got["filtered_defects"] == 1_000_000 and got["filtered_defects_per_vehicle_year"] == 20_000.0


def test_filter_modes_and_ratio(spark):
    idx = spark.createDataFrame([("203", "tire"), ("999", "x")], "defect_code string, description string")
    bd = spark.createDataFrame([("VW", "203", 3), ("VW", "999", 1), ("VW", "555", 4), ("BMW", "203", 2)],
                               "merk string, defect_code string, count bigint")
    ex = D.excluded_codes(idx, "reliability")
    assert [r[0] for r in ex.collect()] == ["203"]
    r = {x[P.MERK]: x["defect_ratio"] for x in D.filtered_ratio(bd, [P.MERK], ex, "reliability").collect()}
    assert r == {"VW": 0.625, "BMW": 0.0}  # code 555 is not in the index: stays included
    r_all = {x[P.MERK]: x["defect_ratio"] for x in D.filtered_ratio(bd, [P.MERK], D.excluded_codes(idx, "all"),
                                                                    "all").collect()}
    assert r_all == {"VW": 1.0, "BMW": 1.0}
    toggled = D.excluded_codes(idx, "reliability", toggled=["203", "999"])
    assert [r[0] for r in toggled.collect()] == ["999"]
    s = rows(D.code_counts_summary(idx, ex))[0]
    assert s == {"active_defect_count": 1, "total_defect_count": 2}


def test_plate_normalise_and_lookup(spark):
    typed = spark.createDataFrame([("AB-123-C",), ("ab",), ("ZZ-999-Z",)], "typed_plate string")
    veh = spark.createDataFrame([("AB123C", "Personenauto", "TEST", "MODEL", "20200101", None, "20990101")],
                                "kenteken string, voertuigsoort string, merk string, handelsbenaming string, "
                                "datum_eerste_toelating string, catalogusprijs string, vervaldatum_apk string")
    insp = spark.createDataFrame([("AB123C", "20250101", "1200", "Afgekeurd")]
                                 + [("AB123C", f"2024{m:02d}01", "0900", "Goedgekeurd") for m in range(1, 13)] * 5,
                                 INSP)
    quote = "A' OR '1'='1"
    defects = spark.createDataFrame([("AB123C", "20250101", "1200", quote, "1")]
                                    + [("AB123C", "20240101", "0900", "X", "2")] * 110, DEF)
    codes = spark.createDataFrame([(quote, "Beschrijving")], CODES)
    v = {r["typed_plate"]: r for r in L.lookup_vehicles(typed, veh, insp, "2024-06-01").collect()}
    assert v["AB-123-C"]["kenteken"] == "AB123C" and v["AB-123-C"]["status"] == "found"
    assert v["AB-123-C"]["certificate"] == "valid" and v["AB-123-C"]["reports"] == 61
    assert v["ab"]["status"] == "invalid" and v["ZZ-999-Z"]["status"] == "not_found"
    h = L.vehicle_history(typed, insp, defects, codes)
    top = [r for r in h.collect() if r["report_rank"] == 1]
    assert len(top) == 1 and top[0]["defect_code"] == quote and top[0]["description"] == "Beschrijving"
    assert top[0]["passed"] is False and top[0]["report_date"] == "01-01-2025"
    # Five January reports with 110 defect rows each (date-only attachment), and the newest one's.
    assert h.where(F.col("defect_rank").isNotNull()).count() == 551
    # A page of 50 reports and 100 defect rows does not reach January.
    assert L.recent_defects(typed, defects).count() == 100
    page = L.vehicle_history(typed, insp, defects, codes, max_reports=50, max_defects=100)
    assert page.where(F.col("defect_rank").isNotNull()).count() == 1


def test_formatting(spark):
    df = spark.createDataFrame([(1234567, 1234.5678, 0.15, "GOLF VARIANT", "20240131", "2024")],
                               "n bigint, d double, p double, s string, dt string, bad string")
    r = df.select(FM.number_format(F.col("n")).alias("a"), FM.decimal_format(F.col("d")).alias("b"),
                  FM.percentage_format(F.col("p")).alias("c"), FM.name_casing(F.col("s")).alias("e"),
                  FM.compact_date_display(F.col("dt")).alias("f"), FM.compact_date_display(F.col("bad")).alias("g"),
                  ).first()
    assert (r.a, r.b, r.c, r.e, r.f, r.g) == ("1 234 567", "1.234,57", "15.0%", "Golf Variant", "31-01-2024", "2024")


def test_tolerant_union_and_reconcile(spark):
    base = shared_dir(spark, "test-shards")
    a = spark.createDataFrame([("1AB", "x")], "kenteken string, merk string")
    b = spark.createDataFrame([("2CD", "y", "z")], "kenteken string, merk string, extra string")
    header_only = spark.createDataFrame([], "kenteken string, merk string")
    for name, df in (("a", a), ("b", b), ("c", header_only)):
        I.write_csv(df, f"{base}/{name}")
    frames = [I.read_csv_strings(spark, f"{base}/{n}") for n in ("a", "b", "c")]
    schema = I.union_schema(frames)
    assert [f.name for f in schema.fields] == ["kenteken", "merk", "extra"]
    merged = I.tolerant_union(frames, schema)
    assert sorted(r["kenteken"] for r in merged.collect()) == ["1AB", "2CD"]
    source = a.unionByName(b, allowMissingColumns=True)
    rep = rows(I.reconcile(source, frames, merged))[0]
    assert rep["ok"] and rep["shard_rows"] == rep["source_rows"] == 2
    I.assert_reconciled(I.reconcile(source, frames, merged))
    assert not I.reconcile(source.union(source), frames, merged).first()["ok"]


def test_shards_keep_every_plate(spark):
    """Plates that no prefix covers go to a shard of their own."""
    plates = ["1A", "ab", "-9", None, "", "Z1", "Z2"]
    df = spark.createDataFrame([(p, "x") for p in plates], "kenteken string, merk string")
    groups = I.write_shards(df, shared_dir(spark, "test-all"), drop_columns={"Z": ["merk"]})
    frames = [I.read_csv_strings(spark, g) for g in groups]
    merged = I.tolerant_union(frames, I.union_schema(frames))
    assert len(groups) == 2
    assert I.reconcile(df, frames, merged).first()["ok"]
    got = sorted((r["kenteken"] or "", r["merk"] or "") for r in merged.collect())
    assert got == sorted((p or "", "" if (p or "").startswith("Z") else "x") for p in plates)


def test_shard_coverage_flags_lowercase(spark):
    df = spark.createDataFrame([("AB1",), ("ab1",), ("9X",)], "kenteken string")
    got = {r["shard"]: (r["rows"], r["covered"]) for r in I.shard_counts(df).collect()}
    assert got == {"A": (1, True), "9": (1, True), None: (1, False)}


def test_duplicate_audit_and_fingerprint(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "")], "x string, y string")
    r = rows(I.duplicate_audit(df))[0]
    assert (r["total_rows"], r["distinct_rows"], r["duplicate_rows"]) == (3, 2, 1)
    f1 = I.fingerprint(df).first()
    f2 = I.fingerprint(df.orderBy(F.desc("x"))).first()
    assert f1 == f2
    f3 = I.fingerprint(spark.createDataFrame([("a", None), ("a", None), ("b", None)], "x string, y string")).first()
    assert f3 != f1
    two = lambda *data: I.fingerprint(spark.createDataFrame(list(data), "x string, y string")).first()
    assert two(("1", "x"), ("1", "x"), ("2", "y")) != two(("9", "z"), ("9", "z"), ("2", "y"))  # equal pairs
    assert two(("a", None)) != two(("a", "\\N")) != two(("a", "n"))
    assert two(("a", "b:c")) != two(("a:b", "c")) and two(("a1:b", "")) != two(("a", "b"))
    empty = I.fingerprint(spark.createDataFrame([], "x string")).first()
    assert (empty["rows"], empty["digest_high"]) == (0, "0")


def test_validate_table(spark):
    df = spark.createDataFrame([], "a string")
    r = rows(I.validate_table("t", df, 1, ["a", "b"]))[0]
    assert r["ok"] is False and r["message"].startswith("missing columns")


def test_history_is_complete_and_pages_are_explicit(spark):
    """Four reports with 40 defects each: every report shows its defects."""
    days = ["20200101", "20210101", "20220101", "20230101"]
    reports = spark.createDataFrame([("AB12", d, "1000", "Goedgekeurd") for d in days],
                                    f"{P.KENTEKEN} string, {P.MELD_DATUM} string, {P.MELD_TIJD} string, {P.SOORT_MELDING} string")
    defects = spark.createDataFrame([("AB12", d, "1000", f"{i:03d}", "1") for d in days for i in range(40)],
                                    ", ".join(f"{c} string" for c in (P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.GEBREK_ID, P.AANTAL_GEBREKEN)))
    codes = spark.createDataFrame([("001", "one")], CODES)
    typed = spark.createDataFrame([("ab-12",), ("ab12",)], "typed_plate string")
    full = L.vehicle_history(typed, reports, defects, codes)
    assert full.count() == 160 and full.where("defect_code is null").count() == 0
    assert sorted(r["defect_rank"] for r in full.collect()) == list(range(1, 161))
    page = L.vehicle_history(typed, reports, defects, codes, max_reports=3, max_defects=60)
    assert page.groupBy("report_rank").count().orderBy("report_rank").collect() == [(1, 40), (2, 20), (3, 1)]


def test_recent_rows_equal_a_plain_ranking(spark):
    from conftest import SF001
    from pyspark.sql import Window

    from roadworthy.sources.bindings import bind

    src = bind(spark, SF001)
    typed = src.vehicles.select(F.col(P.KENTEKEN).alias("typed_plate"))
    order = [F.col(P.MELD_DATUM).desc(), F.col(P.MELD_TIJD).desc(), F.col(P.SOORT_MELDING).asc()]
    valid = src.inspections.where(F.length(P.KENTEKEN) >= 4)
    plain = valid.withColumn("report_rank", F.row_number().over(Window.partitionBy(P.KENTEKEN).orderBy(*order)))
    plain = plain.where("report_rank <= 5").select(P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, "report_rank")
    got = L.recent_reports(typed, src.inspections, 5).select(*plain.columns)
    assert plain.exceptAll(got).count() == 0 and got.exceptAll(plain).count() == 0


def test_included_plus_excluded_is_total(spark):
    from conftest import SF001

    from roadworthy.operators import facts
    from roadworthy.sources.bindings import bind

    src = bind(spark, SF001, code_offset=200)
    fact = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel)
    bd = D.brand_breakdown(src.defects, fact)
    idx = D.code_index(src.codes)
    ex = D.excluded_codes(idx, "reliability")
    r = D.filtered_ratio(bd, [P.MERK], ex, "reliability")
    excluded = bd.join(ex, "defect_code", "left_semi").groupBy(P.MERK).agg(F.sum("count").alias("x"))
    j = r.join(excluded, P.MERK, "left").select(
        (F.col("included_count") + F.coalesce(F.col("x"), F.lit(0)) - F.col("total_count")).alias("d"))
    assert j.where(F.col("d") != 0).count() == 0
    assert ex.count() > 0  # codes 200-299 include wear-and-tear codes


def test_file_checks(spark):
    from conftest import SF001

    ok = I.file_checks(spark, f"{SF001}/supplier.parquet", 100).first()
    assert ok["exists"] and ok["files"] == 1 and ok["ok"]
    small = I.file_checks(spark, f"{SF001}/supplier.parquet", 10**9).first()
    assert not small["ok"] and small["message"].startswith("too small")
    missing = I.file_checks(spark, f"{SF001}/nope.parquet", 1).first()
    assert missing["message"] == "missing"
