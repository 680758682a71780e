"""Dataset profile and metadata.

All outputs are small aggregates of the model-level moments and per-age rows
(``segments.age_moments``); only the yearly trend
reads the fact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions.normalize import rnd


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge one-row global aggregates side by side without a join.

    Each frame contributes its own columns; the union is folded by one global
    aggregate where every column has exactly one non-null contributor.
    """
    cols: list[str] = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def dataset_summary(moments: DataFrame) -> DataFrame:
    """A11 + A15: one row of dataset counts and the zero-defect rate, from ``segments.model_moments``
    (a vehicle has one model segment, so vehicles add up)."""
    n, found = F.col("total_inspections"), F.col("inspections_with_defects")
    total = F.coalesce(F.sum(n), F.lit(0).cast("bigint"))
    zero = F.coalesce(F.sum(n - found), F.lit(0).cast("bigint"))
    of_group = lambda g: F.coalesce(
        F.sum(F.when(F.col("vehicle_type_group") == g, F.col("vehicle_count"))), F.lit(0).cast("bigint"))
    return moments.agg(
        total.alias("total_inspections"),
        F.sum("total_defects").alias("total_defects"),
        F.coalesce(F.sum("vehicle_count"), F.lit(0).cast("bigint")).alias("total_vehicles"),
        F.coalesce(F.max("max_catalog_price").cast("bigint"), F.lit(0).cast("bigint")).alias("max_price"),
        zero.alias("zero_defect_inspections"),
        of_group(P.GROUP_CONSUMER).alias("consumer_vehicles"),
        of_group(P.GROUP_COMMERCIAL).alias("commercial_vehicles"),
        F.when(total > 0, rnd(zero / total, 4)).otherwise(F.lit(0.0)).alias("zero_defect_rate"),
    )


def zero_defect_rate(moments: DataFrame) -> DataFrame:
    """A15 on its own."""
    return dataset_summary(moments).select("zero_defect_rate")


def fuel_domain(moments: DataFrame) -> DataFrame:
    """Distinct primary fuels (sorted when collected for publishing)."""
    return moments.select("primary_fuel").distinct()


def yearly_trend(fact: DataFrame, min_inspections: int = P.DEFAULT.yearly_trend) -> DataFrame:
    """Inspections, defects and average per inspection year."""
    return (
        fact.groupBy("insp_year")
        .agg(F.count(F.lit(1)).alias("inspections"), F.sum("defect_count").alias("total_defects"))
        .withColumn("avg_defects_per_inspection", rnd(F.col("total_defects") / F.col("inspections"), 4))
        .where(F.col("inspections") >= min_inspections)
    )


def fleet_age(age_base: DataFrame, min_vehicles: int = P.DEFAULT.fleet_age_vehicles,
              lo: int = P.DEFAULT.fleet_age_min, hi: int = P.DEFAULT.fleet_age_max) -> DataFrame:
    """Per age: inspections, defects, vehicles, average; age in [lo, hi], from
    ``segments.per_age_base`` (at one age a vehicle is in one of its rows)."""
    return (
        age_base.where(F.col("age_at_inspection").between(lo, hi))
        .groupBy("age_at_inspection")
        .agg(
            F.sum("total_inspections").alias("total_inspections"),
            F.sum("total_defects").cast("bigint").alias("total_defects"),
            F.sum("vehicle_count").alias("vehicle_count"),
        )
        .withColumn("avg_defects_per_inspection", rnd(F.col("total_defects") / F.col("total_inspections"), 4))
        .where(F.col("vehicle_count") >= min_vehicles)
    )


def filter_ranges(brand_segments: DataFrame, model_segments: DataFrame, summary: DataFrame,
                  bounds: DataFrame) -> DataFrame:
    """Slider ranges over brand and model segments, price and age."""
    both = brand_segments.select("vehicle_count", "total_inspections").unionByName(
        model_segments.select("vehicle_count", "total_inspections")
    )
    seg = both.agg(
        F.coalesce(F.max("vehicle_count"), F.lit(0).cast("bigint")).alias("fleet_max"),
        F.coalesce(F.min("total_inspections"), F.lit(0).cast("bigint")).alias("inspections_min"),
        F.coalesce(F.max("total_inspections"), F.lit(0).cast("bigint")).alias("inspections_max"),
    )
    return combine_rows(
        seg,
        summary.select(F.col("max_price").alias("price_max")),
        bounds.select(F.col("min_age").alias("age_min"), F.col("max_age").alias("age_max")),
    )


def metadata_flat(brand_segments: DataFrame, model_segments: DataFrame, summary: DataFrame, bounds: DataFrame,
                  t: P.Thresholds = P.DEFAULT) -> DataFrame:
    """The metadata document as one flat row (timestamp left out)."""
    ranges = filter_ranges(brand_segments, model_segments, summary, bounds)
    return combine_rows(
        ranges,
        brand_segments.agg(F.count(F.lit(1)).alias("brands")),
        model_segments.agg(F.count(F.lit(1)).alias("models")),
        summary.select(
            F.col("total_vehicles").alias("vehicles_processed"), "total_inspections", "total_defects",
            "consumer_vehicles", "commercial_vehicles", "zero_defect_rate",
        ),
    ).select(
        F.lit(t.brand).alias("threshold_brand"),
        F.lit(t.model).alias("threshold_model"),
        F.lit(t.age_bracket).alias("threshold_age_bracket"),
        "*",
    )
