"""Top/bottom rankings of brands and models.

Consumer segments (already cut at the segment threshold, D6) are rolled up
per brand or per model, cut at the ranking threshold and ordered by defects
per vehicle-year.  Each list is a distributed top-k (``orderBy().limit()``
plans as TakeOrderedAndProject: per-partition top-k, then one merge of at most
k rows per partition), and only those k rows are numbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions.normalize import rnd

MOST, LEAST = "most_reliable", "least_reliable"


def ranking_rollup(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum consumer segments per key; rate = defects / vehicle-years (0 if none)."""
    agg = (
        segments.where(F.col("vehicle_type_group") == P.GROUP_CONSUMER)
        .groupBy(*keys)
        .agg(
            F.sum("vehicle_count").alias("vehicle_count"),
            F.sum("total_inspections").alias("total_inspections"),
            F.sum("total_defects").alias("total_defects"),
            F.sum("total_vehicle_years").alias("total_vehicle_years"),
        )
    )
    rate = F.when(
        F.col("total_vehicle_years") > 0, F.col("total_defects") / F.col("total_vehicle_years")
    ).otherwise(F.lit(0.0))
    return agg.withColumn("defects_per_vehicle_year", rate)


def _one_list(rolled: DataFrame, keys: Sequence[str], name: str, descending: bool, k: int,
              zero_rate_as_unknown: bool) -> DataFrame:
    rate = F.col("defects_per_vehicle_year")
    if zero_rate_as_unknown:
        # Parity with the original sort key ``rate or inf``.
        rate = F.when(rate == 0, F.lit(float("inf"))).otherwise(rate)
    order = [rate.desc() if descending else rate.asc(), F.col("vehicle_count").desc()] + [
        F.col(c).asc_nulls_first() for c in keys
    ]
    top = rolled.withColumn("_r", rate).orderBy(*order).limit(k)
    w_order = [F.col("_r").desc() if descending else F.col("_r").asc(), F.col("vehicle_count").desc()] + [
        F.col(c).asc_nulls_first() for c in keys
    ]
    return top.select(
        F.lit(name).alias("ranking"),
        F.row_number().over(Window.orderBy(*w_order)).alias("rank"),
        *keys,
        rnd(F.col("defects_per_vehicle_year"), 6).alias("defects_per_vehicle_year"),
        F.col("total_inspections"),
        F.col("vehicle_count"),
    )


def rankings(segments: DataFrame, keys: Sequence[str], threshold: int, k: int = 10,
             zero_rate_as_unknown: bool = False) -> DataFrame:
    """Both lists for one level (brand or model) in long form."""
    rolled = ranking_rollup(segments, keys).where(F.col("vehicle_count") >= threshold)
    level = "brands" if list(keys) == [P.MERK] else "models"
    return _one_list(rolled, keys, f"{MOST}_{level}", False, k, zero_rate_as_unknown).unionByName(
        _one_list(rolled, keys, f"{LEAST}_{level}", True, k, zero_rate_as_unknown)
    )


def brand_ranking(brand_segments: DataFrame, threshold: int = P.DEFAULT.brand_ranking, k: int = 10,
                  zero_rate_as_unknown: bool = False) -> DataFrame:
    return rankings(brand_segments, [P.MERK], threshold, k, zero_rate_as_unknown)


def model_ranking(model_segments: DataFrame, threshold: int = P.DEFAULT.model_ranking, k: int = 10,
                  zero_rate_as_unknown: bool = False) -> DataFrame:
    return rankings(model_segments, [P.MERK, P.HANDELSBENAMING], threshold, k, zero_rate_as_unknown)


def best_worst_spread(ranking: DataFrame) -> DataFrame:
    """Worst brand rate / best brand rate; null if either is 0 or absent."""
    first = ranking.where(F.col("rank") == 1)
    best = F.max(F.when(F.col("ranking").startswith(MOST), F.col("defects_per_vehicle_year")))
    worst = F.max(F.when(F.col("ranking").startswith(LEAST), F.col("defects_per_vehicle_year")))
    return first.agg(
        rnd(F.when((best > 0) & (worst > 0), worst / best), 6).alias("reliability_ratio")
    )
