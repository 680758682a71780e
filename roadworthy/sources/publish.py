"""Sinks: the fact checkpoint and the published JSON documents.

Documents are written as JSON lines by the executors (one line per brand,
model, code, ...), never assembled on the driver.  Only the one-row
documents (metadata, headline) are single lines by nature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadworthy.functions import normalize as N
from roadworthy.operators import fuel as FU
from roadworthy.session import path_exists, remove_path
from roadworthy.sources import ingest

PER_YEAR = T.MapType(
    T.StringType(),
    T.StructType([
        T.StructField("vehicle_count", T.LongType()),
        T.StructField("total_inspections", T.LongType()),
        T.StructField("total_defects", T.DoubleType()),
        T.StructField("avg_defects_per_inspection", T.DoubleType()),
    ]),
)
FUEL_STRUCT = T.StructType([T.StructField(b, T.LongType()) for b in FU.BUCKETS])


def with_fuel_struct(segments_with_fuel: DataFrame) -> DataFrame:
    """J8 publishing shape: the five fuel columns as one ``fuel_breakdown`` struct."""
    return segments_with_fuel.withColumn("fuel_breakdown", F.struct(*FU.BUCKETS)).drop(*FU.BUCKETS)


def breakdown_document(breakdown_long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A18 publishing shape: one row per brand (or 'brand|model' key) with a
    code -> count map.  A group holds at most one entry per defect code."""
    key = F.col(keys[0]) if len(keys) == 1 else N.model_key(F.col(keys[0]), F.col(keys[1]))
    # Several (brand, model) pairs share the null key when the model is null;
    # summing per (key, code) first keeps every map key unique.
    per_code = breakdown_long.groupBy(key.alias("key"), "defect_code").agg(F.sum("count").alias("count"))
    return per_code.groupBy("key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("defect_code", "count")))).alias("defects")
    )


def write_json(df: DataFrame, path: str) -> str:
    """JSON lines, written in parallel by the executors."""
    df.write.mode("overwrite").option("compression", "none").json(path)
    return path


def write_documents(docs: Mapping[str, DataFrame], base: str) -> dict[str, str]:
    """Every document below ``base/<name>``."""
    return {name: write_json(df, f"{base}/{name}") for name, df in docs.items()}


def read_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a published document back (explicit schema when given)."""
    r = spark.read
    return (r.schema(schema) if schema is not None else r).json(path)


#: The partition of a published document: the prefix of its key, or one for all.
PREFIX, WHOLE = "prefix", "all"
#: Folder of the documents' fingerprints; readers of the output skip names that begin with an underscore.
TREE = "_fingerprints"


def document_prefix(key: str | None) -> Column:
    """Prefix shard of a document's row, by its key column."""
    if key is None:
        return F.lit(WHOLE)
    return F.coalesce(ingest.shard_of(F.upper(F.col(key))), F.lit(ingest.OTHER_SHARD))


def _leaves(spark: SparkSession, path: str) -> dict[str, tuple]:
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return {}
    return {r[PREFIX]: (r["rows"], r["digest_high"], r["digest_low"]) for r in spark.read.parquet(path).collect()}


def publish_changed(df: DataFrame, name: str, base: str, staging: str, key: str | None = None) -> list[str]:
    """S13 + S15: bring the document ``base/name`` up to ``df``; returns the prefixes written or removed.

    The document is JSON lines in one folder a prefix.  Its tree of fingerprints
    (one leaf a prefix, over the rows exactly as they are published) is kept beside the
    output: an unchanged document is not touched, of a changed one only the
    prefixes that differ are rewritten, and a prefix without rows left is removed.
    The tree is taken away before the first write and put back after the last, so a run
    that ended early leaves a document that the next one writes whole.
    At most 37 leaves a document reach the driver.  The rows of a file are in the
    order of ``df``; a prefix of many rows has several files."""
    spark, tree = df.sparkSession, f"{base}/{TREE}/{name}"
    placed = df.withColumns({PREFIX: document_prefix(key), "_at": F.monotonically_increasing_id()})
    staged = persist_table(placed, f"{staging}/{name}")  # computed once
    lines = staged.select(PREFIX, F.to_json(F.struct(*df.columns)).alias("line"))
    made = ingest.fingerprints(lines, [PREFIX])
    now = {r[PREFIX]: (r["rows"], r["digest_high"], r["digest_low"]) for r in made.collect()}
    before = _leaves(spark, tree)
    changed = sorted(p for p in before.keys() | now.keys() if before.get(p) != now.get(p))
    folder = f"{base}/{name}"
    # Folders without a leaf are leftovers of a run that ended early.
    found = {f.rsplit(f"{PREFIX}=", 1)[1] for f in ingest.list_dirs(spark, f"{folder}/{PREFIX}=*")}
    changed = sorted({*changed, *(found - now.keys())})
    if not changed:
        return []
    remove_path(spark, tree)
    rows = staged.where(F.col(PREFIX).isin(*changed)).hint("rebalance", F.col(PREFIX)).sortWithinPartitions(PREFIX, "_at")
    rows.drop("_at").write.mode("overwrite").option("compression", "none").option("partitionOverwriteMode", "dynamic").partitionBy(PREFIX).json(folder)
    for prefix in set(changed) - now.keys():
        remove_path(spark, f"{folder}/{PREFIX}={prefix}")
    leaves = spark.createDataFrame([(p, *d) for p, d in sorted(now.items())], f"{PREFIX} string, rows bigint, digest_high string, digest_low string")
    leaves.coalesce(1).write.mode("overwrite").parquet(tree)
    return changed


def read_published(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A document of ``publish_changed``, all its prefixes, without the prefix column."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def persist_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                  sort_within: Sequence[str] = ()) -> DataFrame:
    """Write zstd Parquet and return a scan of it (lineage cut; a lost
    executor re-reads files instead of recomputing the inputs).

    ``sort_within`` sorts each task's rows locally (no shuffle) so Parquet
    row-group statistics on those columns let later filters skip data; it is
    the scale-friendly alternative to ``partition_by`` on a column that every
    task holds all values of (that would write tasks x values small files)."""
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.select(*df.columns)


def explode_per_age(document: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S14 -> A28: the per-age map of a read-back segment document as long
    rows again, the input the exploration views merge."""
    e = document.select(*keys, F.explode("per_year_stats").alias("age", "s"))
    return e.select(*keys, F.col("age").cast("int").alias("age_at_inspection"), "s.*")


def metadata_document(metadata_flat: DataFrame, yearly: DataFrame, fleet: DataFrame,
                      fuel_domain: DataFrame, source: str = "Open Data") -> DataFrame:
    """A25 publishing shape: one row of nested structs and small arrays.

    The arrays hold one entry per inspection year, per age (at most 30) and
    per fuel class, so each collect is bounded by the calendar, not the data."""
    from roadworthy.operators.profile import combine_rows

    m = metadata_flat
    flat = m.select(
        F.struct(F.col("threshold_brand").alias("brand"), F.col("threshold_model").alias("model"),
                 F.col("threshold_age_bracket").alias("age_bracket")).alias("thresholds"),
        F.struct(
            F.struct(F.lit(0).cast("bigint").alias("min"), F.col("price_max").alias("max")).alias("price"),
            F.struct(F.lit(0).cast("bigint").alias("min"), F.col("fleet_max").alias("max")).alias("fleet"),
            F.struct(F.col("age_min").alias("min"), F.col("age_max").alias("max")).alias("age"),
            F.struct(F.col("inspections_min").alias("min"), F.col("inspections_max").alias("max"))
            .alias("inspections"),
        ).alias("ranges"),
        F.struct("brands", "models", "vehicles_processed", "total_inspections", "total_defects",
                 "consumer_vehicles", "commercial_vehicles").alias("counts"),
        F.col("zero_defect_rate"),
        F.lit(source).alias("source"),
        F.lit(2).alias("pipeline_stage"),
    )
    arrays = combine_rows(
        yearly.agg(F.sort_array(F.collect_list(F.struct("insp_year", "inspections", "total_defects",
                                                        "avg_defects_per_inspection"))).alias("yearly_trend")),
        fleet.agg(F.sort_array(F.collect_list(F.struct("age_at_inspection", "total_inspections", "total_defects",
                                                       "vehicle_count", "avg_defects_per_inspection")))
                  .alias("fleet_age_stats")),
        fuel_domain.agg(F.sort_array(F.collect_list("primary_fuel")).alias("fuel_types")),
    )
    both = combine_rows(flat, arrays)
    return both.select(
        "thresholds", "ranges", "fuel_types", "counts", "source", "pipeline_stage",
        F.struct("zero_defect_rate", "yearly_trend", "fleet_age_stats").alias("stats"),
    )


def defect_stats_document(top: DataFrame, headline: DataFrame) -> DataFrame:
    """A16/A17 publishing shape: the headline and the ordered top-code list
    (bounded by k) in one row."""
    from roadworthy.operators.profile import combine_rows

    ranked = top.select(
        F.struct(
            F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("defect_code").asc())).alias("pos"),
            "defect_code", "defect_description", "count", "percentage",
        ).alias("d")
    )
    lst = ranked.agg(F.transform(F.sort_array(F.collect_list("d")), lambda x: x.dropFields("pos"))
                     .alias("top_defects"))
    return combine_rows(headline, lst)


def rankings_document(brand_ranking: DataFrame, model_ranking: DataFrame) -> DataFrame:
    """T4 publishing shape: one row with the four ranking lists, each ordered
    by rank (every list holds at most k entries)."""
    from roadworthy.operators.profile import combine_rows

    def lists(r: DataFrame, with_model: bool) -> DataFrame:
        fields = ["rank", "merk", "defects_per_vehicle_year", "total_inspections"]
        if with_model:
            fields.append("handelsbenaming")
        level = "models" if with_model else "brands"
        return r.agg(*[
            F.sort_array(F.collect_list(F.when(F.col("ranking") == f"{kind}_{level}", F.struct(*fields))))
            .alias(f"{kind}_{level}")
            for kind in ("most_reliable", "least_reliable")
        ])

    return combine_rows(lists(brand_ranking, False), lists(model_ranking, True))
