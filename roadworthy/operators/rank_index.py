"""Places in a sorted table, without sorting it in one task.

The table is cut into ranges of its order (about ``rows`` rows each, whatever
their number), each range written as one partition, and the rows before every
range are added up once.  A page then opens only the ranges that hold its
places, and the number of any row is the rows before its range plus its
place within the range, so no task handles more than one range.

The order should end with a unique tie-break; rows that tie in all of it are
numbered in no certain order, and stay in one range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

ROWS = 200_000
RANGE = "_range"


@dataclass
class RankIndex:
    """A sorted table below ``base``: ``rows``, partitioned by range, and ``ranges``, the rows before each."""

    spark: SparkSession
    base: str
    order: list[Column]
    total: int
    schema: object

    def ranges(self) -> DataFrame:
        """(range, rows, before), one row a range."""
        return self.spark.read.parquet(f"{self.base}/ranges")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/rows")

    def _numbered(self, rows: DataFrame, before: DataFrame) -> DataFrame:
        within = F.row_number().over(Window.partitionBy(RANGE).orderBy(*self.order)).cast("long")
        return rows.withColumn("_within", within).join(before.select(RANGE, "before"), RANGE).withColumn(
            "position", F.col("before") + F.col("_within")).drop(RANGE, "before", "_within")

    def numbered(self) -> DataFrame:
        """Every row with its ``position``, from 1."""
        return self._numbered(self._rows(), self.ranges())

    def slice(self, first: int, last: int) -> DataFrame:
        """The rows at positions ``first`` to ``last`` (from 1, both included), in order."""
        held = self.ranges().where((F.col("before") < last) & (F.col("before") + F.col("rows") >= first))
        ids = [r[RANGE] for r in held.select(RANGE).collect()]  # the ranges of one page
        rows = self._rows().where(F.col(RANGE).isin(*ids) if ids else F.lit(False))
        return self._numbered(rows, held).where(F.col("position").between(first, last)).orderBy("position")

    def page(self, number: int, size: int) -> DataFrame:
        """One page (from 1) in order; pages past the end are empty."""
        if number < 1 or size < 1:
            raise ValueError("pages and their size count from one")
        return self.slice((number - 1) * size + 1, number * size).drop("position")

    def pages(self, size: int) -> int:
        """Number of pages, at least one."""
        return max(1, -(-self.total // size))


def build(df: DataFrame, order: Sequence[Column], base: str, rows: int = ROWS) -> RankIndex:
    """Write ``df`` as a rank index below ``base`` (shared storage); ``df`` is computed once."""
    spark, order, base = df.sparkSession, list(order), base.rstrip("/")
    counted = Observation("rank-index")
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{base}/given")
    total = int(counted.get["rows"])
    given = spark.read.schema(df.schema).parquet(f"{base}/given")
    dealt = given.repartitionByRange(max(1, math.ceil(total / rows)), *order).withColumn(RANGE, F.spark_partition_id())
    dealt.sortWithinPartitions(RANGE, *order).write.mode("overwrite").option("compression", "zstd").partitionBy(RANGE).parquet(f"{base}/rows")
    schema = given.withColumn(RANGE, F.lit(0)).schema
    sizes = spark.read.schema(schema).parquet(f"{base}/rows").groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows"))
    # One row a range: this window is of ranges, not of the table's rows.
    before = F.coalesce(F.sum("rows").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("before", before).write.mode("overwrite").parquet(f"{base}/ranges")
    from roadworthy.session import remove_path

    remove_path(spark, f"{base}/given")
    return RankIndex(spark, base, order, total, schema)


def view_order(column: str, ascending: bool, tiebreak: Sequence[str]) -> list[Column]:
    """T5's order as columns: nulls last ascending, first descending; then the tie-break."""
    o = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_first()
    return [o, *[F.col(c).asc_nulls_first() for c in tiebreak]]
