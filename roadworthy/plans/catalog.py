"""Registered queries: one Spark builder (and, where SQL can express it, one
DuckDB oracle statement) per operator of the inventory.

Each builder takes ``(spark, sf_dir)``, binds the whole test tables and runs
the library operator on them; thresholds are the scaled test values of
FIXTURES.md part D (the library defaults stay the original ones).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.operators import facts
from roadworthy.sources.bindings import Sources, bind

T = P.TEST_SF001


@dataclass
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: Callable[[], str] | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: Callable[[], str] | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return deco


def sources(spark: SparkSession, sf_dir: str, code_offset: int = 0) -> Sources:
    from roadworthy.session import configure

    configure(spark)
    return bind(spark, sf_dir, code_offset)


def fact_of(src: Sources) -> DataFrame:
    return facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel)


def six_digits(segments: DataFrame) -> DataFrame:
    """Segments with the sums of fractions rounded, whose last bits depend on the order of summation."""
    from roadworthy.functions.normalize import rnd

    sums = ("sum_defects_per_vehicle_year_rates", "sum_sq_defects_per_vehicle_year_rates", "sum_catalog_price")
    return segments.withColumns({c: rnd(F.col(c), 6) for c in sums})


def positions(df: DataFrame) -> DataFrame:
    """A sorted view's rows with their position, so that a check of its rows also checks its order.

    For views of bounded length (codes, brands, years): rows are numbered in
    the order the operator gave them.
    """
    order = Window.orderBy("_at")
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("position", F.row_number().over(order)).drop("_at")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: v.build for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v.sql() for k, v in REGISTRY.items() if v.sql is not None}


def _load_all() -> None:
    # Importing the query modules fills REGISTRY.
    from roadworthy.plans import (  # noqa: F401
        q_defects,
        q_explore,
        q_facts,
        q_fuel,
        q_ingest,
        q_lookup,
        q_profile,
        q_publish,
        q_ranked,
        q_segments,
        q_store,
    )
