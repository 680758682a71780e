"""Sharding by weighted rendezvous hashing.

Every (record key, shard) pair has a hash; the record goes to the shard with
the smallest ``-ln(u) / weight``, u being the hash as a number in (0, 1).  The
hash of a pair depends on nothing else, so a further shard takes records only
into itself, a removed shard gives up only its own, and a shard's share of the
records is its share of the weights.

Defined results: a null key counts as the empty string; rows with equal keys
share a shard; an empty table gives an empty result; an input column called
like an output column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _draw(key: Column, shard: int) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return -F.log((h.cast("double") + F.lit(0.5)) / F.lit(2.0**53))


def record_key(keys: Sequence[str]) -> Column:
    """Record key as text; columns are length-prefixed so that they cannot run together."""
    cols = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    if len(cols) == 1:
        return cols[0]
    return F.concat(*[p for c in cols for p in (F.length(c).cast("string"), F.lit(":"), c)])


def choose_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard number (int) of a key under the given shard weights."""
    bad = [w for w in weights if not (w >= 0 and math.isfinite(w))]
    if bad or not any(weights):
        raise ValueError("weights must be finite, not negative and not all zero")
    scored = [
        F.struct((_draw(key, i) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    best = scored[0] if len(scored) == 1 else F.array_min(F.array(*scored))
    return best["shard"].cast("int")


def number_within(df: DataFrame, group: str, order: Sequence[str], out: str = "slot", buckets: int = 4096) -> DataFrame:
    """Gapless numbers from 0 within each group, without sorting a group in one task.

    A group is cut into ``buckets`` by a hash of the first order column; rows
    are numbered inside each bucket, and the buckets' counts (at most
    ``buckets`` rows a group) give each bucket's first number.  The order is
    (bucket, ``order``); rows equal in all of ``order`` are interchangeable.
    """
    bucket = F.pmod(F.xxhash64(F.col(order[0])), F.lit(buckets)).cast("int")
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*[F.col(c) for c in order])
    numbered = keyed.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, [group, "_bucket"])
        .withColumn(out, (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_start", "_rank")
    )


def assign(
    df: DataFrame,
    keys: Sequence[str],
    weights: Sequence[float],
    next_weight: float | None = 1.0,
    ties: Sequence[str] = (),
) -> DataFrame:
    """All rows with ``shard``, ``slot`` (gapless in the shard) and ``grown_shard``.

    ``grown_shard`` is the shard after one more of weight ``next_weight`` is
    added (null where that is None).  ``ties`` orders rows with equal keys.
    """
    key = record_key(keys)
    grown = F.lit(None).cast("int") if next_weight is None else choose_shard(key, [*weights, next_weight])
    placed = df.withColumns({"_key": key, "shard": choose_shard(key, weights), "grown_shard": grown})
    return number_within(placed, "shard", ["_key", *ties]).drop("_key")
