"""Segments, rankings, invariants of the moments."""

from __future__ import annotations

import math

from conftest import SF001, rows
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.operators import explore as X
from roadworthy.operators import facts, rankings, segments
from roadworthy.sources.bindings import bind

FACT = ("kenteken string, meld_datum_door_keuringsinstantie string, meld_tijd_door_keuringsinstantie string, "
        "merk string, handelsbenaming string, catalogusprijs double, vehicle_type_group string, primary_fuel string, "
        "insp_year int, age_at_inspection int, defect_count bigint")


def _fact(spark, data):
    return spark.createDataFrame(data, FACT)


def test_single_inspection_std_null(spark):
    f = _fact(spark, [("A", "20200101", "0930", "VW", "GOLF", 0.0, "consumer", "Diesel", 2020, 5, 2)])
    r = rows(segments.brand_segments(f, 1))[0]
    assert r["std_defects_per_inspection"] is None and r["std_defects_per_vehicle_year"] is None
    assert r["defects_per_vehicle_year"] == 0.4 and r["count_with_price"] == 0


def test_zero_exposure_rate_is_zero(spark):
    f = _fact(spark, [("A", "20200101", "0930", "VW", "GOLF", 10.0, "consumer", "Diesel", 2020, 0, 3),
                      ("B", "20200101", "0930", "VW", "GOLF", 10.0, "consumer", "Diesel", 2020, 0, 1)])
    r = rows(segments.brand_segments(f, 1))[0]
    assert r["defects_per_vehicle_year"] == 0.0
    # clip to 1 in the per-vehicle-year rate
    assert r["sum_defects_per_vehicle_year_rates"] == 4.0


def test_null_model_groups_but_does_not_join(spark):
    f = _fact(spark, [("A", "20200101", "0930", "VW", None, 0.0, "consumer", "Diesel", 2020, 5, 1),
                      ("B", "20200101", "0930", "VW", None, 0.0, "consumer", "Diesel", 2020, 5, 1)])
    seg = segments.model_segments(f, 1)
    got = rows(seg)
    assert len(got) == 1 and got[0]["vehicle_count"] == 2
    nested = rows(segments.nest_per_age(seg, segments.per_age(f, P.MODEL_KEYS, 1), P.MODEL_KEYS))
    assert nested[0]["per_year_stats"] == {}


def test_moment_std_matches_stddev_samp(spark):
    src = bind(spark, SF001)
    fact = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel).cache()
    seg = segments.brand_segments(fact, 1)
    merged = X.pooled_std(X.merge_segments(seg, [P.MERK]))
    direct = fact.groupBy(P.MERK).agg(F.stddev_samp("defect_count").alias("s"), F.count(F.lit(1)).alias("n"))
    a = {r[P.MERK]: r["std_defects_per_inspection"] for r in merged.collect()}
    b = {r[P.MERK]: r["s"] for r in direct.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert math.isclose(a[k], b[k], rel_tol=1e-5, abs_tol=1e-6)
    # sum of segment inspections without thresholds equals the fact rows
    assert seg.agg(F.sum("total_inspections")).first()[0] == fact.count()
    fact.unpersist()


def test_ranking_order_and_tiebreak(spark):
    data = []
    # brand X: rate 0 (no defects); Y and Z tie on rate, Z has more vehicles
    for i in range(3):
        data.append((f"x{i}", "20200101", "0930", "X", "M", 0.0, "consumer", "Diesel", 2020, 4, 0))
    for i in range(2):
        data.append((f"y{i}", "20200101", "0930", "Y", "M", 0.0, "consumer", "Diesel", 2020, 4, 2))
    for i in range(4):
        data.append((f"z{i}", "20200101", "0930", "Z", "M", 0.0, "consumer", "Diesel", 2020, 4, 2))
    data.append(("c1", "20200101", "0930", "C", "M", 0.0, "commercial", "Diesel", 2020, 4, 9))
    f = _fact(spark, data)
    seg = segments.brand_segments(f, 1)
    r = rows(rankings.brand_ranking(seg, 1), "ranking", "rank")
    least = [x[P.MERK] for x in r if x["ranking"].startswith("least")]
    most = [x[P.MERK] for x in r if x["ranking"].startswith("most")]
    assert most == ["X", "Z", "Y"] and least == ["Z", "Y", "X"]  # commercial C excluded
    parity = rows(rankings.brand_ranking(seg, 1, zero_rate_as_unknown=True), "ranking", "rank")
    assert [x[P.MERK] for x in parity if x["ranking"].startswith("most")] == ["Z", "Y", "X"]


def test_brand_threshold_applies_before_rollup(spark):
    data = [(f"a{i}", "20200101", "0930", "A", "M", 0.0, "consumer", "Diesel", 2020, 4, 1) for i in range(3)]
    data += [("b0", "20200101", "0930", "A", "M", 0.0, "consumer", "LPG", 2020, 4, 1)]
    seg = segments.brand_segments(_fact(spark, data), 2)
    r = rows(rankings.brand_ranking(seg, 1))
    assert r[0]["vehicle_count"] == 3  # the 1-vehicle LPG segment vanished (D6)


def test_per_age_map_keys_are_strings(spark):
    f = _fact(spark, [("A", "20200101", "0930", "VW", "G", 0.0, "consumer", "Diesel", 2020, 5, 1),
                      ("A", "20210101", "0930", "VW", "G", 0.0, "consumer", "Diesel", 2021, 6, 0)])
    seg = segments.brand_segments(f, 1)
    nested = rows(segments.nest_per_age(seg, segments.per_age(f, P.BRAND_KEYS, 1), P.BRAND_KEYS))
    assert set(nested[0]["per_year_stats"]) == {"5", "6"}


def test_age_window_over_all_ages_equals_totals(spark):
    src = bind(spark, SF001)
    fact = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel)
    seg = segments.brand_segments(fact, 1)
    pa = segments.per_age(fact, P.BRAND_KEYS, 1)
    w = X.explore_segments(seg, X.ViewFilter(age_range=(0, 100)), pa)
    full = X.explore_segments(seg, X.ViewFilter())
    a = {r[P.MERK]: (r["total_inspections"], r["filtered_defects"]) for r in w.collect()}
    b = {r[P.MERK]: (r["total_inspections"], r["filtered_defects"]) for r in full.collect()}
    assert a == b


def test_pipeline_rollups_equal_direct(spark):
    from roadworthy.operators import defects as D
    from roadworthy.plans.pipeline import run_statistics

    src = bind(spark, SF001)
    out = run_statistics(spark, src, P.TEST_SF001, checkpoint=True)
    fact = out.fact
    direct_pa = segments.per_age(fact, P.BRAND_KEYS, P.TEST_SF001.age_bracket)
    assert out.brand_per_age.exceptAll(direct_pa).count() == 0
    assert direct_pa.exceptAll(out.brand_per_age).count() == 0
    direct_bd = D.brand_breakdown(src.defects, fact)
    assert out.brand_breakdown.exceptAll(direct_bd).count() == 0
    assert direct_bd.exceptAll(out.brand_breakdown).count() == 0


def test_documents_round_trip(spark):
    from roadworthy.plans.pipeline import documents, run_statistics
    from roadworthy.session import shared_dir
    from roadworthy.sources import publish

    t = P.TEST_SF001
    out = run_statistics(spark, bind(spark, SF001), t, checkpoint=True)
    docs = documents(out)
    paths = publish.write_documents({k: docs[k] for k in ("brand_stats", "metadata", "defect_stats")},
                                    shared_dir(spark, "docs-test"))
    # explicit schema: without it JSON inference turns the per-age map into a struct
    back = publish.read_document(spark, paths["brand_stats"], docs["brand_stats"].schema)
    long = publish.explode_per_age(back, P.BRAND_KEYS)
    want = out.brand_per_age.join(out.brand_segments.select(*P.BRAND_KEYS), list(P.BRAND_KEYS), "left_semi")
    cols = [*P.BRAND_KEYS, "age_at_inspection", "vehicle_count", "total_inspections", "total_defects"]
    assert long.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(long.select(*cols)).count() == 0
    meta = publish.read_document(spark, paths["metadata"]).first()
    assert meta["counts"]["total_inspections"] == out.fact.count()
    assert len(meta["stats"]["yearly_trend"]) == out.yearly_trend.count()
    ds = publish.read_document(spark, paths["defect_stats"]).first()
    assert len(ds["top_defects"]) == t.top_codes
    counts = [d["count"] for d in ds["top_defects"]]
    assert counts == sorted(counts, reverse=True) and ds["total_defects"] == sum(counts)


def test_pipeline_coverage_exposure(spark):
    from roadworthy.plans.pipeline import run_statistics

    src = bind(spark, SF001)
    t = P.TEST_SF001
    out = run_statistics(spark, src, t, checkpoint=False, exposure="coverage")
    direct = segments.brand_segments(
        facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel, with_coverage=True),
        t.brand, exposure="coverage")
    assert out.brand_segments.exceptAll(direct).count() == 0
    age = segments.brand_segments(facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel), t.brand)
    # coverage years differ from summed ages, so the rates differ
    assert out.brand_segments.select("total_vehicle_years").exceptAll(age.select("total_vehicle_years")).count() > 0


def test_breakdown_document_null_model_keys(spark):
    from roadworthy.sources import publish

    bd = spark.createDataFrame([("A", None, "X", 2), ("B", None, "X", 3), ("A", "M", "X", 1)],
                               "merk string, handelsbenaming string, defect_code string, count bigint")
    got = {r["key"]: r["defects"] for r in publish.breakdown_document(bd, [P.MERK, P.HANDELSBENAMING]).collect()}
    assert got == {None: {"X": 5}, "A|M": {"X": 1}}


def test_explore_mean_age_under_coverage_exposure(spark):
    src = bind(spark, SF001)
    cov_fact = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel, with_coverage=True)
    age_view = X.explore_segments(segments.brand_segments(cov_fact, 1), X.ViewFilter())
    cov_view = X.explore_segments(segments.brand_segments(cov_fact, 1, exposure="coverage"), X.ViewFilter())
    a = {r[P.MERK]: r["avg_age_years"] for r in age_view.collect()}
    b = {r[P.MERK]: r["avg_age_years"] for r in cov_view.collect()}
    assert a == b  # the mean age does not depend on the exposure definition


def test_nested_maps_are_ordered(spark):
    f = _fact(spark, [("A", "20200101", "0930", "VW", "G", 0.0, "consumer", "Diesel", 2020, a, 1)
                      for a in (12, 3, 10, 2)])
    seg = segments.brand_segments(f, 1)
    nested = segments.nest_per_age(seg, segments.per_age(f, P.BRAND_KEYS, 1), P.BRAND_KEYS)
    keys = nested.select(F.map_keys("per_year_stats")).first()[0]
    assert keys == ["2", "3", "10", "12"]


def test_rankings_document_shape(spark):
    from roadworthy.plans.pipeline import run_statistics
    from roadworthy.sources import publish

    out = run_statistics(spark, bind(spark, SF001), P.TEST_SF001, checkpoint=False)
    doc = publish.rankings_document(out.brand_ranking, out.model_ranking).first()
    for name in ("most_reliable_brands", "least_reliable_brands", "most_reliable_models", "least_reliable_models"):
        assert [e["rank"] for e in doc[name]] == list(range(1, 11))
    assert doc["most_reliable_models"][0]["handelsbenaming"] is not None
    rates = [e["defects_per_vehicle_year"] for e in doc["most_reliable_brands"]]
    assert rates == sorted(rates)


def test_brand_selection_of_any_length(spark):
    df = spark.createDataFrame([(f"B{i}",) for i in range(2000)], "merk string")
    few, many = tuple(f"B{i}" for i in range(3)), tuple(f"B{i}" for i in range(1500))
    assert X.brand_selection(df, few).count() == 3 and X.brand_selection(df, many).count() == 1500
    assert X.brand_selection(df, ()).count() == 2000
    for chosen in (few, many):
        assert "Join" not in X.brand_selection(df, chosen)._jdf.queryExecution().executedPlan().toString()


def test_segments_are_equal_to_the_bit_however_the_fact_is_dealt(spark):
    src = bind(spark, SF001)
    fact = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel, with_coverage=True)
    # Prices and rates whose doubles do not add up alike in every order.
    fact = fact.withColumn(P.CATALOGUSPRIJS, F.col(P.CATALOGUSPRIJS) + F.lit(0.1)).cache()
    one, other = fact.repartition(3, "insp_year", P.MELD_TIJD), fact.orderBy(F.md5(F.concat(P.KENTEKEN, P.MELD_DATUM))).repartition(23)
    for build in (lambda f: segments.brand_segments(f, 1), lambda f: segments.model_segments(f, 1),
                  lambda f: segments.brand_segments(f, 1, "coverage")):
        a, b = (sorted(map(tuple, build(f).collect()), key=repr) for f in (one, other))
        assert a == b and len(a) > 50
    fact.unpersist()


def test_vehicles_seen_first_at_an_age_add_up_to_distinct_vehicles(spark):
    f = _fact(spark, [(k, f"20{20 + i}0101", "0930", "VW", None, 0.0, "consumer", "Diesel", 2020 + i, a, 1)
                      for k, seen in (("A", (3, 4, 7)), ("B", (4,)), ("C", (7, 3)), (None, (4, 5))) for i, a in enumerate(seen)])
    ages = {r["age_at_inspection"]: (r["vehicle_count"], r["first_vehicles"]) for r in segments.age_moments(f).collect()}
    assert ages == {3: (2, 2), 4: (2, 1), 5: (0, 0), 7: (2, 0)}  # a null plate is no vehicle
