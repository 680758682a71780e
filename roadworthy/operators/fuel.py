"""Fuel mix per brand and model.

The model level is computed once (distinct vehicles per brand, model and fuel
bucket) and the brand level is rolled up from it, so the fuel rows are read
and de-duplicated a single time.  The pivot lists its five values explicitly,
which keeps it a single aggregation (no extra job to discover the values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions import normalize as N

BUCKETS = list(P.FUEL_BREAKDOWN_FIELDS)


#: Copies that one row stands for at most when repeated rows are written out again.
COPIES = 1 << 16


def fuel_with_vehicle_counts(fuel: DataFrame, vehicles: DataFrame) -> DataFrame:
    """J5 with multiplicities: each different (plate, fuel, brand, model) once, with the number ``n`` of joined rows.

    Both sides are reduced to different rows and their counts first, map-side,
    so a plate repeated m times there and n times here meets itself once, not m x n times."""
    f = fuel.groupBy(P.KENTEKEN, N.fuel_bucket(F.col(P.BRANDSTOF)).alias("fuel_type")).agg(F.count(F.lit(1)).alias("_f"))
    v = vehicles.groupBy(
        P.KENTEKEN, N.upper_strip(F.col(P.MERK)).alias(P.MERK), N.upper_strip(F.col(P.HANDELSBENAMING)).alias(P.HANDELSBENAMING),
    ).agg(F.count(F.lit(1)).alias("_v"))
    return f.join(v, P.KENTEKEN, "inner").select(
        P.KENTEKEN, "fuel_type", P.MERK, P.HANDELSBENAMING, (F.col("_f") * F.col("_v")).alias("n"))


def fuel_with_vehicle(fuel: DataFrame, vehicles: DataFrame) -> DataFrame:
    """J5 + P12: fuel rows with the vehicle's brand and model (vehicles are not
    de-duplicated or type-filtered here, as in the original).

    Counted rows are written out again in chunks of ``COPIES``, which are spread
    over tasks before the copies are made."""
    counted = fuel_with_vehicle_counts(fuel, vehicles)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("_chunk")
    chunks = counted.select("*", chunk).withColumn(
        "_size", F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("_chunk") * COPIES)).hint("rebalance")
    return chunks.select(
        P.KENTEKEN, "fuel_type", P.MERK, P.HANDELSBENAMING, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size"))).alias("_copy")).drop("_copy")


def fuel_by_model(fuel: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Distinct vehicles per (brand, model, fuel bucket).

    Counting distinct plates is insensitive to repeated rows, so both sides
    are reduced to distinct (plate, bucket) and (plate, brand, model) first;
    the distinct is combined map-side, so a plate repeated a huge number of
    times on either side reaches the join as a handful of rows."""
    f = fuel.select(P.KENTEKEN, N.fuel_bucket(F.col(P.BRANDSTOF)).alias("fuel_type")).distinct()
    v = vehicles.select(
        P.KENTEKEN,
        N.upper_strip(F.col(P.MERK)).alias(P.MERK),
        N.upper_strip(F.col(P.HANDELSBENAMING)).alias(P.HANDELSBENAMING),
    ).distinct()
    # After both distincts each (plate, bucket, brand, model) occurs once, so a
    # plain count per group is the distinct-plate count (no distinct phase).
    return (
        f.join(v, P.KENTEKEN, "inner")
        .groupBy(P.MERK, P.HANDELSBENAMING, "fuel_type")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def fuel_by_brand(model_level: DataFrame) -> DataFrame:
    """Brand roll-up of the model level (sum of model counts)."""
    return model_level.groupBy(P.MERK, "fuel_type").agg(F.sum("count").alias("count"))


def pivot_breakdown(level: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with the five fuel columns, missing -> 0."""
    wide = level.groupBy(*keys).pivot("fuel_type", BUCKETS).agg(F.sum("count"))
    return wide.select(*keys, *[F.coalesce(F.col(b), F.lit(0)).cast("bigint").alias(b) for b in BUCKETS])


def attach_breakdown(segments: DataFrame, wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segment rows with their brand's / model's fuel columns (zeros if none).

    Keys join by plain equality, so a null model gets zeros (D14)."""
    j = segments.join(wide, list(keys), "left")
    return j.select(*segments.columns, *[F.coalesce(F.col(b), F.lit(0).cast("bigint")).alias(b) for b in BUCKETS])


def pct(c, total):
    """Integer percent, half rounded up, 0 when the total is 0."""
    return F.when(total > 0, F.floor((F.lit(200) * c + total) / (F.lit(2) * total))).otherwise(F.lit(0)).cast("bigint")
