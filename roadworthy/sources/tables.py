"""Table registry and scans.

The five logical tables are addressed by name.  ``scan`` is lazy and keeps
Parquet predicate pushdown and column pruning; ``load`` projects the needed
columns up front.  Nothing is materialised here.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from roadworthy import params as P

# Source dataset id -> logical table name (fixed values of the open-data portal).
DATASETS = {
    "m9d7-ebf2": "voertuigen",
    "sgfe-77wx": "meldingen",
    "a34c-vvps": "geconstateerde_gebreken",
    "hx2c-gt7k": "gebreken",
    "8ys7-d773": "brandstof",
}


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


# Columns the pipeline reads, all strings as in the raw CSV exports.
SCHEMAS: dict[str, T.StructType] = {
    "voertuigen": _strings(
        P.KENTEKEN, P.VOERTUIGSOORT, P.MERK, P.HANDELSBENAMING, P.DATUM_EERSTE_TOELATING,
        P.CATALOGUSPRIJS, P.VERVALDATUM_APK,
    ),
    "meldingen": _strings(P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.SOORT_MELDING, P.VERVALDATUM_KEURING),
    "geconstateerde_gebreken": _strings(P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.GEBREK_ID, P.AANTAL_GEBREKEN),
    "gebreken": _strings(P.GEBREK_ID, P.GEBREK_OMSCHRIJVING),
    "brandstof": _strings(P.KENTEKEN, P.BRANDSTOF),
}


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a test-data directory."""
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


def scan(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Lazy scan of a logical table; fails fast if the path is absent."""
    if name not in SCHEMAS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(SCHEMAS)}")
    path = os.path.join(base_dir, f"{name}.parquet")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # type: ignore[union-attr]
    if not fs.exists(jvm_path):
        raise FileNotFoundError(f"dataset {name} not found at {path}")
    return spark.read.parquet(path)


def load(spark: SparkSession, base_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """S3: scan with an explicit column projection (pruned at the reader)."""
    df = scan(spark, base_dir, name)
    return df.select(*columns) if columns else df


def register_views(sources: dict[str, DataFrame]) -> None:
    """Expose logical tables as temp views for SQL users."""
    for name, df in sources.items():
        df.createOrReplaceTempView(name)


def load_sources(spark: SparkSession, base_dir: str):
    """The five logical tables from ``base_dir/<name>.parquet`` (the names of
    ``DATASETS``), each projected to the columns the pipeline uses, all text.

    Missing optional columns (the two expiry dates) are added as nulls, so
    tables exported without them still load."""
    from pyspark.sql import functions as F

    from roadworthy.sources.bindings import Sources

    def one(name: str) -> DataFrame:
        df = scan(spark, base_dir, name)
        cols = [
            (F.col(f.name).cast("string") if f.name in df.columns else F.lit(None).cast("string")).alias(f.name)
            for f in SCHEMAS[name].fields
        ]
        return df.select(*cols)

    return Sources(
        vehicles=one("voertuigen"),
        inspections=one("meldingen"),
        defects=one("geconstateerde_gebreken"),
        codes=one("gebreken"),
        fuel=one("brandstof"),
    )
