"""Distinct vehicles that merge (A6-A8, A11, A14, D12): exact bitmaps.

Every vehicle gets a dense number, in the order of its segment and plate, so
that the vehicles of one segment have neighbouring numbers.  The numbers of the
vehicles seen in a segment at an age are kept as bitmaps of 32,768 bits; a large
segment has many of them, and one that is no larger than a few thousand
vehicles has one or two.  The union of bitmaps counts a vehicle once,
whatever ages, segments or other rows of the table are put together, which sums
of per-age counts do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions.normalize import rnd
from roadworthy.operators import rank_index

AGE = "age_at_inspection"


def vehicle_numbers(fact: DataFrame, base: str, rows: int = rank_index.ROWS) -> DataFrame:
    """(segment, plate, number): dense numbers from 1 of the fact's vehicles, by segment and plate."""
    vehicles = fact.where(F.col(P.KENTEKEN).isNotNull()).select(*P.MODEL_KEYS, P.KENTEKEN).distinct()
    order = [F.col(c).asc_nulls_first() for c in (*P.MODEL_KEYS, P.KENTEKEN)]
    return rank_index.build(vehicles, order, base, rows).numbered().withColumnRenamed("position", "number")


def age_bitmaps(fact: DataFrame, numbers: DataFrame) -> DataFrame:
    """(segment, age, bucket, vehicles): bitmaps of the vehicles of each model segment and age.

    Vehicle and age are made distinct first, by a hash aggregate on whole
    numbers, so a bitmap is built from each bit once."""
    same = numbers.select(P.KENTEKEN, "number", *[F.col(c).alias("_" + c) for c in P.MODEL_KEYS])
    on = [F.col(c).eqNullSafe(F.col("_" + c)) for c in P.MODEL_KEYS]
    seen = fact.select(P.KENTEKEN, *P.MODEL_KEYS, AGE).distinct()
    held = seen.join(same, P.KENTEKEN).where(on[0] & on[1] & on[2] & on[3])
    number = F.col("number")
    return held.groupBy(*P.MODEL_KEYS, AGE, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("vehicles"))


def distinct_vehicles(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct vehicles of each group of ``keys`` over the given bitmaps."""
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("vehicles").alias("vehicles"))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("vehicles")).alias("vehicle_count"))


def age_window(per_age_rows: DataFrame, bitmaps: DataFrame, kept: Column, keys: Sequence[str], lo: int, hi: int) -> DataFrame:
    """A29 with true distinct vehicles: sums over ages lo..hi of the segments ``kept``
    (a condition on the segment columns), every vehicle counted once.

    ``per_age_rows`` are the model-level rows of ``segments.per_age_base``."""
    inside = kept & F.col(AGE).between(lo, hi)
    sums = per_age_rows.where(inside).groupBy(*keys).agg(
        F.sum("total_inspections").alias("total_inspections"), F.sum("total_defects").alias("total_defects"))
    counts = distinct_vehicles(bitmaps.where(inside), keys).select(*[F.col(c).alias("_" + c) for c in keys], "vehicle_count")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col("_" + c))
    return sums.join(counts, on).select(
        *keys, "vehicle_count", "total_inspections", "total_defects",
        rnd(F.col("total_defects") / F.col("total_inspections"), 4).alias("avg_defects_per_inspection"))


def band_vehicles(bitmaps: DataFrame) -> DataFrame:
    """Distinct vehicles of each (overlapping) age band, from the bitmaps."""
    from roadworthy.sources.ingest import age_band_rows

    return distinct_vehicles(age_band_rows(bitmaps), ["age_band"])
