"""Plan-shape checks for the scale properties the README claims."""

from __future__ import annotations

from conftest import SF001
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions import classify as C
from roadworthy.operators import facts, lookup, profile, segments
from roadworthy.sources import ingest as I
from roadworthy.sources.bindings import bind


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _fact(spark):
    src = bind(spark, SF001)
    return src, facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel)


def test_lookup_ranks_day_by_day(spark):
    """No window orders a plate's raw rows in one task, and nothing is broadcast by hint."""
    src, _ = _fact(spark)
    typed = src.vehicles.select(F.col(P.KENTEKEN).alias("typed_plate"))
    plan = _plan(lookup.recent_reports(typed, src.inspections))
    ranks = [line for line in plan.splitlines() if "row_number()" in line and "Window [" in line]
    assert ranks and all(f"windowspecdefinition({P.KENTEKEN}#" in r and f"{lookup.DAY}#" in r for r in ranks)


def test_tasks_are_given_a_bounded_part_of_a_shuffle(spark):
    """Merged shuffle partitions stay small where the session names no size; a size it names is kept."""
    from roadworthy.session import ADVISORY, configure

    plain, named = spark.newSession(), spark.newSession()
    plain.conf.unset(ADVISORY)
    named.conf.set(ADVISORY, "64m")
    configure(plain), configure(named)
    assert plain.conf.get(ADVISORY) == "16m" and named.conf.get(ADVISORY) == "64m"
    rows = plain.range(2_500_000, numPartitions=4).select(F.md5(F.col("id").cast("string")).alias("k"))  # some 90 MB shuffled
    plain.conf.set("spark.sql.shuffle.partitions", "40")
    plain.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    tasks = rows.repartition("k").select(F.spark_partition_id().alias("task")).distinct().count()
    assert 4 <= tasks < 40  # 64 MB a task would be 2


def test_classifier_is_an_expression_not_a_join(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("c"))
    plan = _plan(df.select(C.is_reliability(F.col("c"))))
    assert "Join" not in plan and ("INSET" in plan.upper() or " IN (" in plan.upper())


def test_age_bands_without_join(spark):
    _, fact = _fact(spark)
    plan = _plan(I.age_band_stats(fact))
    assert "Generate" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_summary_has_no_expand(spark):
    _, fact = _fact(spark)
    plan = _plan(profile.dataset_summary(segments.model_moments(fact)))
    assert "Expand" not in plan


def test_publishing_reads_the_fact_three_times(spark):
    """Moments by age, breakdown and yearly trend; the documents read only these."""
    from roadworthy.plans.pipeline import documents, run_statistics
    from roadworthy.session import temporary_dir

    src = bind(spark, SF001)
    with temporary_dir(spark, "plan-test") as work:
        out = run_statistics(spark, src, P.TEST_SF001, base_dir=work)
        import os

        assert sorted(os.listdir(work.removeprefix("file:"))) == [
            "age_moments", "brand_moments", "inspection_stats", "model_breakdown", "model_fuel", "model_moments", "top_defects",
            "yearly_trend"]
        plan = _plan(documents(out)["metadata"])
        assert "inspection_stats" not in plan and f"hashpartitioning({P.KENTEKEN}" not in plan
        for name, doc in documents(out).items():
            assert "inspection_stats" not in _plan(doc), name
    assert not os.path.exists(work.removeprefix("file:"))


def test_segments_single_distinct_two_phase(spark):
    _, fact = _fact(spark)
    plan = _plan(segments.brand_segments(fact, 1))
    assert "Expand" not in plan  # one distinct aggregate: no row multiplication


def test_moments_shuffle_the_fact_once_by_plate(spark):
    _, fact = _fact(spark)
    stored = spark.createDataFrame([], fact.schema)
    plan = _plan(segments.age_moments(stored))
    assert plan.count(f"hashpartitioning({P.KENTEKEN}#") == 1
    assert plan.count("Exchange") == 2  # by plate, then the partial sums by segment and age


def test_binding_scan_is_pruned(spark):
    src = bind(spark, SF001)
    plan = _plan(src.defects.select(P.KENTEKEN))
    assert "l_extendedprice" not in plan and "l_comment" not in plan
    assert "l_returnflag" in plan  # the filter column is read and pushed


def test_recent_days_filter_reaches_parquet(spark):
    from roadworthy.session import shared_dir

    path = shared_dir(spark, "raw-reports")
    spark.createDataFrame([("AB1", "20240101"), ("AB2", "20231201")],
                          f"{P.KENTEKEN} string, {P.MELD_DATUM} string").write.parquet(path)
    raw = spark.read.parquet(path)
    plan = _plan(I.recent_days(raw, "2024-01-31", 30))
    assert "PushedFilters: [IsNotNull(meld_datum_door_keuringsinstantie), GreaterThanOrEqual(" in plan
    assert [r[0] for r in I.recent_days(raw, "2024-01-31", 30).collect()] == ["AB1"]
