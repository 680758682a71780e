"""Rank index and distinct vehicles that merge."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.operators import distinct, rank_index
from roadworthy.session import temporary_dir


def _index(spark, base, n=5000, rows=400):
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 50 != 1, F.col("id") * 7919 % 1000 / 7.0).alias("v"))
    return df, rank_index.build(df, rank_index.view_order("v", True, ["k"]), base, rows)


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1] is None, r[1] or 0, r[0]))


def test_pages_and_numbers_equal_the_sorted_table(spark):
    with temporary_dir(spark, "rank") as base:
        df, index = _index(spark, base)
        want = _sorted(df)
        got = [tuple(r)[:2] for r in sorted(index.numbered().collect(), key=lambda r: r.position)]
        assert got == want
        assert sorted(r.position for r in index.numbered().collect()) == list(range(1, 5001))
        for number in (1, 8, 9, 73, 100, 101):
            assert list(map(tuple, index.page(number, 50).collect())) == want[(number - 1) * 50:number * 50]
        assert index.pages(50) == 100 and index.pages(49) == 103
        sizes = {r["_range"]: r["rows"] for r in index.ranges().collect()}
        # A value that a third of the rows share is spread by the tie-break.
        assert sum(sizes.values()) == 5000 and max(sizes.values()) < 3 * 400
        with pytest.raises(ValueError):
            index.page(0, 50)


def test_a_deep_page_reads_only_its_ranges(spark):
    with temporary_dir(spark, "rank") as base:
        _, index = _index(spark, base)
        page = index.page(73, 50)
        plan = page._jdf.queryExecution().executedPlan().toString()
        [pruned] = [p for p in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan) if "_range" in p]
        assert 1 <= len(re.findall(r"(?<![#\d])\d+", pruned.replace("isnotnull", ""))) <= 2, pruned
        held = spark.read.parquet(f"{base}/rows").where("_range in (" + ",".join(re.findall(r"(?<![#\d])\d+", pruned)) + ")").count()
        assert held < 2 * 3 * 400


def test_empty_and_tiny_tables(spark):
    with temporary_dir(spark, "rank") as base:
        df = spark.createDataFrame([], "k long, v double")
        index = rank_index.build(df, rank_index.view_order("v", False, ["k"]), base)
        assert index.numbered().collect() == [] and index.page(1, 10).collect() == [] and index.pages(10) == 1
    with temporary_dir(spark, "rank") as base:
        df = spark.createDataFrame([(1, None), (2, 5.0)], "k long, v double")
        index = rank_index.build(df, rank_index.view_order("v", False, ["k"]), base)
        assert [r.k for r in index.page(1, 10).collect()] == [1, 2]


FACT = f"{P.KENTEKEN} string, merk string, handelsbenaming string, vehicle_type_group string, primary_fuel string, age_at_inspection int"


def test_a_vehicle_seen_at_many_ages_counts_once(spark):
    rows = [("A", "VW", None, "consumer", "Diesel", a) for a in (3, 4, 5, 5)] + [("B", "VW", "GOLF", "consumer", "LPG", 5)]
    rows += [("C", "VW", None, "consumer", "Diesel", 9), (None, "VW", None, "consumer", "Diesel", 4), ("A'", "BMW", "X", "commercial", "Diesel", 4)]
    with temporary_dir(spark, "distinct") as base:
        fact = spark.createDataFrame(rows, FACT)
        bitmaps = distinct.age_bitmaps(fact, distinct.vehicle_numbers(fact, base, rows=2))
        count = lambda df, *keys: {tuple(r)[:-1]: r.vehicle_count for r in distinct.distinct_vehicles(df, keys).collect()}
        assert count(bitmaps, "merk") == {("VW",): 3, ("BMW",): 1}
        assert count(bitmaps.where("age_at_inspection between 3 and 5"), "merk") == {("VW",): 2, ("BMW",): 1}
        assert count(bitmaps, "merk", "handelsbenaming") == {("VW", None): 2, ("VW", "GOLF"): 1, ("BMW", "X"): 1}


def test_a_large_segment_has_many_bitmaps(spark):
    n = 100_000
    fact = spark.range(n).select(
        F.concat(F.lit("P"), "id").alias(P.KENTEKEN), F.lit("VW").alias("merk"), F.lit("GOLF").alias("handelsbenaming"), F.lit("consumer").alias("vehicle_type_group"),
        F.lit("LPG").alias("primary_fuel"), F.explode(F.array(F.lit(4), (F.col("id") % 3 + 4).cast("int"))).alias("age_at_inspection"))
    with temporary_dir(spark, "distinct") as base:
        bitmaps = distinct.age_bitmaps(fact, distinct.vehicle_numbers(fact, base, rows=20_000)).cache()
        per_age = {r["age_at_inspection"]: r["count"] for r in bitmaps.groupBy("age_at_inspection").count().collect()}
        assert per_age[4] == -(-n // 32768)
        assert distinct.distinct_vehicles(bitmaps, ["merk"]).first().vehicle_count == n
        bitmaps.unpersist()
