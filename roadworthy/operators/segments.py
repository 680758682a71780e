"""Brand and model segment statistics from mergeable moments.

A segment is (brand, usage group, primary fuel), optionally with the model.
Besides the published measures each row carries sums and sums of squares so
later filters can merge segments without touching the fact table again.

Scale notes: the fact is shuffled once, by plate, and reduced to one row per
vehicle and age; a segment holding a third of all rows is so spread over many
tasks, and what is shuffled by segment afterwards is combined map-side.  All
sums are exact, so documents do not change from run to run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions.normalize import clip_age, guarded_ratio, rnd


#: Prices are added as decimals of this type, so that no order of addition shows in the sum.
EXACT = "decimal(28,10)"


def age_moments(fact: DataFrame, exposure: str = "age", clustered: bool = False) -> DataFrame:
    """Whole-number sums per (brand, model, type, fuel) and age, unfiltered.

    Everything the segments publish follows from these rows, at any level of
    grouping and in any order of addition: counts, defects and their squares,
    prices (as decimals), and ``first_vehicles``, the vehicles seen at
    this age for the first time in their segment, which add up to the distinct vehicles over all ages.
    The fact is read once and shuffled once, by plate; not at all if its rows of a plate already
    lie together (``clustered``, as in the stored fact).

    ``exposure="coverage"`` adds the documented coverage years (D1; needs a fact
    built ``with_coverage``)."""
    d, price = F.col("defect_count"), F.col(P.CATALOGUSPRIJS)
    whole = ["total_inspections", "total_defects", "inspections_with_defects", "sum_sq_defect_counts", "sum_catalog_price",
             "count_with_price", *(["sum_coverage_years"] if exposure != "age" else [])]
    vehicle = [*P.MODEL_KEYS, P.KENTEKEN]
    per_vehicle = (fact if clustered else fact.repartition(P.KENTEKEN)).groupBy(*vehicle, "age_at_inspection").agg(
        F.count(F.lit(1)).alias("total_inspections"),
        F.sum(d).alias("total_defects"),
        F.count_if(d > 0).alias("inspections_with_defects"),
        F.sum(d * d).alias("sum_sq_defect_counts"),
        F.sum(price.cast(EXACT)).alias("sum_catalog_price"),
        F.count_if(price > 0).alias("count_with_price"),
        F.max(price).alias("max_catalog_price"),
        *([F.sum(F.col("coverage_years").cast(EXACT)).alias("sum_coverage_years")] if exposure != "age" else []),
    )
    # A window of one vehicle holds at most one row an age.
    first = per_vehicle.withColumn("_first", F.min("age_at_inspection").over(Window.partitionBy(*vehicle)))
    return first.groupBy(*P.MODEL_KEYS, "age_at_inspection").agg(
        F.count(P.KENTEKEN).alias("vehicle_count"),
        F.count_if(F.col(P.KENTEKEN).isNotNull() & (F.col("age_at_inspection") == F.col("_first"))).alias("first_vehicles"),
        *[F.sum(c).alias(c) for c in whole],
        F.max("max_catalog_price").alias("max_catalog_price"),
    )


def per_age_of(ages: DataFrame) -> DataFrame:
    """``per_age_base`` from ``age_moments``."""
    return ages.select(*P.MODEL_KEYS, "age_at_inspection", "vehicle_count", "total_inspections",
                       F.col("total_defects").cast("double").alias("total_defects"))


def moments_of(ages: DataFrame, keys: Sequence[str] = P.MODEL_KEYS) -> DataFrame:
    """Counts and sums per segment of ``keys`` from ``age_moments``, unfiltered and unrounded.

    All sums are of whole numbers or decimals; both sums of rates (defects by age, ages
    below one counting as one) are divided age by age and added from the
    least age to the greatest, at most 101 terms, so their bits do not depend on how
    the rows were dealt."""
    exposures = [c for c in ages.columns if c == "sum_coverage_years"]
    sums = ["total_inspections", "total_defects", "inspections_with_defects", "sum_sq_defect_counts", "sum_catalog_price",
            "count_with_price", *exposures]
    n, age = F.col("total_inspections"), F.col("age_at_inspection")
    per_age = ages if list(keys) == list(P.MODEL_KEYS) else ages.groupBy(*keys, "age_at_inspection").agg(
        F.sum("first_vehicles").alias("first_vehicles"), *[F.sum(c).alias(c) for c in sums],
        F.max("max_catalog_price").alias("max_catalog_price"))
    entry = F.struct(age.alias("age"), F.col("total_defects").alias("d"), F.col("sum_sq_defect_counts").alias("d2"))
    total = per_age.groupBy(*keys).agg(
        F.sum("first_vehicles").alias("vehicle_count"), *[F.sum(c).alias(c) for c in sums],
        F.sum(age * n).alias("sum_age_years"), F.max("max_catalog_price").alias("max_catalog_price"),
        F.array_sort(F.collect_list(entry)).alias("_ages"))

    def rates(value: str, power: int) -> F.Column:
        clip = lambda e: clip_age(e["age"]).cast("double")
        below = lambda e: clip(e) if power == 1 else clip(e) * clip(e)
        return F.aggregate("_ages", F.lit(0.0), lambda s, e: s + e[value].cast("double") / below(e))

    years = F.col("sum_coverage_years" if exposures else "sum_age_years").cast("double")
    return total.select(
        *keys, "vehicle_count", "total_inspections", "total_defects", "inspections_with_defects",
        F.col("sum_age_years").cast("double").alias("sum_age_years"), years.alias("total_vehicle_years"),
        rates("d", 1).alias("sum_defects_per_vehicle_year_rates"), rates("d2", 2).alias("sum_sq_defects_per_vehicle_year_rates"),
        "sum_sq_defect_counts", F.col("sum_catalog_price").cast("double").alias("sum_catalog_price"), "count_with_price",
        "max_catalog_price")


def model_moments(fact: DataFrame, exposure: str = "age") -> DataFrame:
    """``moments_of`` the model level, from the fact.

    ``exposure="age"`` (the original code) sums the age at inspection as
    vehicle-years; ``"coverage"`` sums the documented coverage years of each
    inspection instead (D1; needs a fact built ``with_coverage``)."""
    return moments_of(age_moments(fact, exposure))


def _sample_std(total: F.Column, squares: F.Column, n: F.Column) -> F.Column:
    """Sample standard deviation from sums; null for fewer than two values."""
    variance = (squares - total * total / n) / (n - 1)
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), variance)))


def segment_measures(ages: DataFrame, keys: Sequence[str], with_defect_found: bool = True,
                     exposure: str = "age") -> DataFrame:
    """The 2.5 measure list per segment of ``keys``, from ``age_moments`` (or ``moments_of`` them at these keys).

    The sums that are merged again later (rates, prices) are not rounded."""
    m = moments_of(ages, keys) if "age_at_inspection" in ages.columns else ages
    n = F.col("total_inspections")
    rate = F.col("sum_defects_per_vehicle_year_rates")
    return m.select(
        *keys, "vehicle_count", "total_inspections", F.col("total_defects").cast("double").alias("total_defects"),
        *(["inspections_with_defects"] if with_defect_found else []),
        rnd(_sample_std(F.col("total_defects").cast("double"), F.col("sum_sq_defect_counts").cast("double"), n), 4)
        .alias("std_defects_per_inspection"),
        rnd(F.col("sum_age_years") / n, 2).alias("avg_age_years"),
        "total_vehicle_years",
        rnd(_sample_std(rate, F.col("sum_sq_defects_per_vehicle_year_rates"), n), 4).alias("std_defects_per_vehicle_year"),
        "sum_defects_per_vehicle_year_rates", "sum_sq_defects_per_vehicle_year_rates",
        F.col("sum_sq_defect_counts").cast("double").alias("sum_sq_defect_counts"),
        "sum_catalog_price", "count_with_price",
        # vehicle-years that are no ages: keep the age sum for mean ages
        *(["sum_age_years"] if exposure != "age" else []),
    )


def _derive(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("avg_defects_per_inspection", rnd(F.col("total_defects") / F.col("total_inspections"), 4))
        .withColumn("defects_per_vehicle_year", guarded_ratio(F.col("total_defects"), F.col("total_vehicle_years"), 6))
        .withColumn("total_vehicle_years", rnd(F.col("total_vehicle_years"), 4))
    )


def brand_segments_of(ages: DataFrame, threshold: int = P.DEFAULT.brand, exposure: str = "age") -> DataFrame:
    """(brand, type, fuel) segments with at least ``threshold`` vehicles."""
    return _derive(segment_measures(ages, P.BRAND_KEYS, True, exposure).where(F.col("vehicle_count") >= threshold))


def model_segments_of(ages: DataFrame, threshold: int = P.DEFAULT.model, exposure: str = "age") -> DataFrame:
    """A7 + W1: (brand, model, type, fuel) segments of models whose vehicles,
    summed over their segments, reach ``threshold``."""
    seg = segment_measures(ages, P.MODEL_KEYS, False, exposure)
    w = Window.partitionBy(P.MERK, P.HANDELSBENAMING)
    return _derive(seg.withColumn("total_model_count", F.sum("vehicle_count").over(w)).where(
        F.col("total_model_count") >= threshold))


def brand_segments(fact: DataFrame, threshold: int = P.DEFAULT.brand, exposure: str = "age") -> DataFrame:
    return brand_segments_of(age_moments(fact, exposure), threshold, exposure)


def model_segments(fact: DataFrame, threshold: int = P.DEFAULT.model, exposure: str = "age") -> DataFrame:
    return model_segments_of(age_moments(fact, exposure), threshold, exposure)


def by_rate(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments in publishing order."""
    return segments.orderBy("defects_per_vehicle_year", *keys)


def model_totals(fact: DataFrame) -> DataFrame:
    """W1 on its own: vehicles per model segment and per model over all segments."""
    seg = fact.groupBy(*P.MODEL_KEYS).agg(F.count_distinct(P.KENTEKEN).alias("vehicle_count"))
    w = Window.partitionBy(P.MERK, P.HANDELSBENAMING)
    return seg.withColumn("total_model_count", F.sum("vehicle_count").over(w))


def by_age(per_age_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-age rows in publishing order."""
    return per_age_rows.orderBy(*keys, "age_at_inspection")


def per_age(fact: DataFrame, keys: Sequence[str], threshold: int = P.DEFAULT.age_bracket) -> DataFrame:
    """Per segment and age: vehicles, inspections, defects, average (long form)."""
    return (
        fact.groupBy(*keys, "age_at_inspection")
        .agg(
            F.count_distinct(P.KENTEKEN).alias("vehicle_count"),
            F.count(F.lit(1)).alias("total_inspections"),
            F.sum("defect_count").cast("double").alias("total_defects"),
        )
        .where(F.col("vehicle_count") >= threshold)
        .withColumn("avg_defects_per_inspection", rnd(F.col("total_defects") / F.col("total_inspections"), 4))
    )


def per_age_base(fact: DataFrame) -> DataFrame:
    """Unfiltered per-age rows at the finest segment level (model keys).

    Every vehicle has exactly one model segment, so distinct vehicles, counts
    and defect sums of any coarser level are exact sums of these rows
    (``per_age_rollup``); one pass over the fact serves brand and model level.
    """
    return fact.groupBy(*P.MODEL_KEYS, "age_at_inspection").agg(
        F.count_distinct(P.KENTEKEN).alias("vehicle_count"),
        F.count(F.lit(1)).alias("total_inspections"),
        F.sum("defect_count").cast("double").alias("total_defects"),
    )


def per_age_rollup(base: DataFrame, keys: Sequence[str], threshold: int = P.DEFAULT.age_bracket) -> DataFrame:
    """A8 from ``per_age_base``: identical to ``per_age(fact, keys, threshold)``."""
    return (
        base.groupBy(*keys, "age_at_inspection")
        .agg(
            F.sum("vehicle_count").alias("vehicle_count"),
            F.sum("total_inspections").alias("total_inspections"),
            F.sum("total_defects").alias("total_defects"),
        )
        .where(F.col("vehicle_count") >= threshold)
        .withColumn("avg_defects_per_inspection", rnd(F.col("total_defects") / F.col("total_inspections"), 4))
    )


def age_bounds(age_base: DataFrame) -> DataFrame:
    """Global minimum and maximum age at inspection, null -> 0, from the fact or ``per_age_base``."""
    return age_base.agg(
        F.coalesce(F.min("age_at_inspection"), F.lit(0)).alias("min_age"),
        F.coalesce(F.max("age_at_inspection"), F.lit(0)).alias("max_age"),
    )


def nest_per_age(segments: DataFrame, per_age_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A10 + J7: attach the per-age rows to each segment as a map keyed by the
    age as a string (empty map when a segment has none).

    The grouping is per segment and holds at most one entry per age (0-100),
    so no group can grow with the data.
    """
    # Entries are sorted by age (numerically) so a document is byte-stable
    # from run to run; collect order alone depends on task timing.
    entry = F.struct(
        F.col("age_at_inspection").alias("age"),
        F.struct(
            F.col("age_at_inspection").cast("string").alias("key"),
            F.struct("vehicle_count", "total_inspections", "total_defects", "avg_defects_per_inspection")
            .alias("value"),
        ).alias("kv"),
    )
    entries = per_age_rows.groupBy(*keys).agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["kv"])).alias("per_year_stats")
    )
    empty = F.create_map().cast("map<string,struct<vehicle_count:bigint,total_inspections:bigint,"
                                "total_defects:double,avg_defects_per_inspection:double>>")
    # Plain equality: a null brand or model does not match.
    joined = segments.join(entries, list(keys), "left")
    return joined.withColumn("per_year_stats", F.coalesce(F.col("per_year_stats"), empty))
