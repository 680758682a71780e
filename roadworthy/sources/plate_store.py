"""The lookup's tables stored for a few plates at a time.

Each table is partitioned by the plate's prefix shard, and within it cut into
ranges and sorted by plate (then day and time, so a plate with a huge history spans files),
with a Parquet Bloom filter on the plate.  A lookup of typed plates lists the folders of their prefixes
only, and opens of their files only the row groups that can hold one of the plates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadworthy import params as P
from roadworthy.operators import lookup
from roadworthy.sources.bindings import Sources
from roadworthy.sources.fact_store import SHARD, with_shard
from roadworthy.sources.ingest import OTHER_SHARD, SHARD_PREFIXES

ORDER = {
    "vehicles": [P.KENTEKEN],
    "inspections": [P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD],
    "defects": [P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.GEBREK_ID],
}


class PlateStore:
    """The stored tables below ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def write(self, src: Sources, files: int | None = None, distinct_plates: int = 1_000_000, row_group_bytes: int | None = None) -> None:
        """Store the three tables; ``distinct_plates`` sizes the Bloom filter of a row group."""
        for name, order in ORDER.items():
            rows = with_shard(getattr(src, name))
            by = [SHARD, *order]
            dealt = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
            w = dealt.sortWithinPartitions(*by).write.mode("overwrite").partitionBy(SHARD).option("compression", "zstd")
            w = w.option(f"parquet.bloom.filter.enabled#{P.KENTEKEN}", "true").option(
                f"parquet.bloom.filter.expected.ndv#{P.KENTEKEN}", str(distinct_plates))
            if row_group_bytes:
                w = w.option("parquet.block.size", str(row_group_bytes))
            w.parquet(f"{self.base}/{name}")

    def _read(self, name: str) -> DataFrame:
        """A stored table; prefixes are text, also where all of them are digits."""
        path = f"{self.base}/{name}"
        fields = [T.StructField(f.name, T.StringType() if f.name == SHARD else f.dataType) for f in self.spark.read.parquet(path).schema.fields]
        return self.spark.read.schema(T.StructType(fields)).parquet(path)

    def find(self, name: str, plates: Sequence[str]) -> DataFrame:
        """The rows of some plates; prefixes are pruned, and the plates are pushed to the files."""
        shards = sorted({p[:1] if p[:1] in SHARD_PREFIXES else OTHER_SHARD for p in plates})
        df = self._read(name)
        if not plates:
            return df.where(F.lit(False)).drop(SHARD)
        return df.where(F.col(SHARD).isin(*shards) & F.col(P.KENTEKEN).isin(*plates)).drop(SHARD)

    def _typed(self, typed: Sequence[str | None]) -> tuple[DataFrame, list[str]]:
        df = self.spark.createDataFrame([(t,) for t in typed], "typed_plate string")
        valid = lookup.normalized_plates(df).where("valid").select(P.KENTEKEN).distinct()
        return df, sorted(r[0] for r in valid.collect())  # as many as were typed

    def history(self, typed: Sequence[str | None], codes: DataFrame, **kw) -> DataFrame:
        """J10 for a list of typed plates: ``lookup.vehicle_history`` over their rows alone."""
        df, plates = self._typed(typed)
        return lookup.vehicle_history(df, self.find("inspections", plates), self.find("defects", plates), codes, **kw)

    def vehicles(self, typed: Sequence[str | None], as_of: str) -> DataFrame:
        """``lookup.lookup_vehicles`` for a list of typed plates."""
        df, plates = self._typed(typed)
        return lookup.lookup_vehicles(df, self.find("vehicles", plates), self.find("inspections", plates), as_of)
