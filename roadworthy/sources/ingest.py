"""Ingest: CSV shards to Parquet with schema tolerance and checks (S4-S10,
S15-S17, P38, P39).

The original downloads each table in disjoint plate-prefix shards, writes
every shard as CSV/Parquet, unions them with a tolerant schema and checks that
no row was lost.  On Spark the shards are files in one folder (or one folder
per shard); reading, unioning and counting are ordinary distributed jobs.
Files are written below the shared checkpoint folder, never a machine-local
temporary folder.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadworthy import params as P
from roadworthy.functions.normalize import coverage_years  # noqa: F401  (P38, re-exported)

# The 36 plate prefixes of the sharded download (digits, then letters).
SHARD_PREFIXES: tuple[str, ...] = tuple(string.digits + string.ascii_uppercase)
# Shard of every other plate, null and empty ones included.
OTHER_SHARD = "other"


# The writer would trim values otherwise.
_CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> str:
    """S4 (write side): every column as text with a header."""
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("overwrite").options(**_CSV).csv(path)
    return path


def read_csv_strings(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """S4 (read side): header row, no type inference - every column a string."""
    r = spark.read.option("header", True).option("inferSchema", False)
    return (r.schema(schema) if schema is not None else r).csv(path)


#: Column of a staged line that did not fit, and the flag the staging folder is partitioned by.
BAD_LINE, IS_BAD = "_bad_line", "_is_bad"


def stage_csv(spark: SparkSession, path: str | list[str], staging: str, names: Sequence[str] | None = None,
              header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Read CSV as strings and keep lines that do not fit apart.

    Returns (rows, quarantine): ``rows`` has the columns ``names`` (default: the
    header's); ``quarantine`` the whole text and the file of every line
    with too few or too many fields or broken quotes, which a
    plain read would pad with nulls or cut.  The lines are parsed once, into
    ``staging`` (shared storage), in one folder for the good and one for the bad,
    so reading either opens no file of the other."""
    if names is None:
        if not header:
            raise ValueError("without a header the names must be given")
        names = read_csv_strings(spark, path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD_LINE]])
    lines = (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", BAD_LINE).csv(path))
    staged = lines.select("*", F.input_file_name().alias("_file"), F.col(BAD_LINE).isNotNull().alias(IS_BAD))
    staged.write.mode("overwrite").option("compression", "zstd").partitionBy(IS_BAD).parquet(staging)
    back = spark.read.schema(T.StructType([*schema.fields, T.StructField("_file", T.StringType()),
                                           T.StructField(IS_BAD, T.BooleanType())])).parquet(staging)
    return back.where(~F.col(IS_BAD)).select(*names), back.where(IS_BAD).select(F.col(BAD_LINE).alias("line"), F.col("_file").alias("file"))


def to_parquet(df: DataFrame, path: str) -> str:
    """Zstd-compressed Parquet."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def shard_of(plate: Column) -> Column:
    """The prefix shard a plate belongs to; null when no shard covers it
    (the prefixes are case-sensitive, as the original predicates are)."""
    first = F.substring(plate, 1, 1)
    return F.when(first.isin(*SHARD_PREFIXES), first)


def shard_counts(df: DataFrame, plate_col: str = P.KENTEKEN) -> DataFrame:
    """S5 + coverage check: rows per shard; rows no shard covers appear under
    a null shard with ``covered = false``."""
    s = shard_of(F.col(plate_col))
    return df.groupBy(s.alias("shard")).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "covered", F.col("shard").isNotNull()
    )


def list_dirs(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching a glob on the cluster file system (sorted)."""
    jvm = spark.sparkContext._jvm  # type: ignore[union-attr]
    jp = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # type: ignore[union-attr]
    found = fs.globStatus(jp) or []
    return sorted(str(st.getPath().toString()) for st in found if st.isDirectory())


def write_shards(df: DataFrame, base: str, plate_col: str = P.KENTEKEN,
                 drop_columns: dict[str, Sequence[str]] | None = None,
                 extra_columns: dict[str, dict[str, Column]] | None = None) -> list[list[str]]:
    """Stage one CSV folder per shard (``base/shard=X``): every row lands in its
    prefix shard, or in ``OTHER_SHARD`` if no prefix fits.

    Returns the folders that exist, grouped by header, so that each group is
    read by one reader.  Shards with the common header are written by one partitioned job,
    rebalanced by shard: the rows of a small shard go to one task and those of a large one are split
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), so the number of files follows the size of the data, not tasks times shards;
    ``drop_columns`` / ``extra_columns`` make chosen shards differ in header,
    the way shards of a drifting export do, and are written on their own."""
    drop_columns = drop_columns or {}
    extra_columns = extra_columns or {}
    odd = sorted(set(drop_columns) | set(extra_columns))
    tagged = df.withColumn("shard", F.coalesce(shard_of(F.col(plate_col)), F.lit(OTHER_SHARD)))
    common = tagged.where(~F.col("shard").isin(*odd)) if odd else tagged
    common = common.select(*[F.col(c).cast("string").alias(c) for c in df.columns], "shard").hint("rebalance", F.col("shard"))
    common.write.mode("overwrite").options(**_CSV).partitionBy("shard").csv(base)
    for p in odd:
        part = tagged.where(F.col("shard") == p).drop("shard")
        if p in drop_columns:
            part = part.drop(*drop_columns[p])
        for name, col in extra_columns.get(p, {}).items():
            part = part.withColumn(name, col)
        write_csv(part, f"{base}/shard={p}")
    found = list_dirs(spark_of(df), f"{base}/shard=*")
    name = lambda path: path.rstrip("/").rsplit("shard=", 1)[1]
    groups = [[p for p in found if name(p) not in odd], *[[p for p in found if name(p) == o] for o in odd]]
    return [g for g in groups if g]


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def union_schema(frames: Iterable[DataFrame]) -> T.StructType:
    """Union of column names in first-seen order; the first type seen wins."""
    fields: dict[str, T.StructField] = {}
    for f in frames:
        for fld in f.schema.fields:
            fields.setdefault(fld.name, fld)
    return T.StructType(list(fields.values()))


def tolerant_union(frames: Sequence[DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """UNION ALL by name; missing columns become null, columns outside
    ``schema`` are dropped; the result has exactly ``schema``'s columns."""
    if not frames:
        raise ValueError("tolerant_union needs at least one frame")
    schema = schema or union_schema(frames)
    names = [f.name for f in schema.fields]

    def conform(df: DataFrame) -> DataFrame:
        cols = [
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
        return df.select(*cols)

    return reduce(lambda a, b: a.unionByName(b), [conform(f) for f in frames]).select(*names)


def merge_observed(df: DataFrame, base: str, schema: T.StructType, **drift) -> tuple[DataFrame, DataFrame]:
    """S5-S8 in one pass each way: (merged table, reconciliation report).

    ``df`` is staged as CSV shards (``write_shards``, which takes ``drift``) and merged into Parquet below
    ``base``.  The rows are counted while they are written and while they are read
    back, by observed metrics of those two jobs; no table is scanned again to be counted.
    The report is ``reconcile``'s row, with the number of rows of every group of shards read."""
    spark = df.sparkSession
    source = Observation("source")
    # The first job of the write sees every row, also those of shards that differ in header.
    groups = write_shards(df.observe(source, F.count(F.lit(1)).alias("rows")), f"{base}/shards", **drift)
    seen, frames = [], []
    for i, folders in enumerate(groups):
        frame = read_csv_strings(spark, folders)
        if frame.columns:
            seen.append(Observation(f"shards-{i}"))
            frames.append(frame.observe(seen[-1], F.count(F.lit(1)).alias("rows")))
    whole = Observation("merged")
    merged = tolerant_union(frames, schema) if frames else spark.createDataFrame([], schema)
    to_parquet(merged.observe(whole, F.count(F.lit(1)).alias("rows")), f"{base}/merged")
    read = [int(o.get["rows"]) for o in seen]
    row = (int(source.get["rows"]), sum(read), int(whole.get["rows"]), read)
    report = spark.createDataFrame([(*row, row[0] == row[1] == row[2])],
                                   "source_rows bigint, shard_rows bigint, merged_rows bigint, group_rows array<bigint>, ok boolean")
    return spark.read.schema(schema).parquet(f"{base}/merged"), report


def reconcile(source: DataFrame, shards: Sequence[DataFrame], merged: DataFrame) -> DataFrame:
    """The merged row count must equal the source's and the sum of the shards'.

    Returns a one-row report; ``assert_reconciled`` raises on a mismatch."""
    per = [s.agg(F.count(F.lit(1)).alias("n")) for s in shards]
    shard_sum = reduce(lambda a, b: a.unionByName(b), per).agg(F.sum("n").alias("shard_rows"))
    merged_n = merged.agg(F.count(F.lit(1)).alias("merged_rows"))
    from roadworthy.operators.profile import combine_rows

    source_n = source.agg(F.count(F.lit(1)).alias("source_rows"))
    return combine_rows(combine_rows(source_n, shard_sum), merged_n).withColumn(
        "ok", (F.col("source_rows") == F.col("shard_rows")) & (F.col("shard_rows") == F.col("merged_rows")))


def assert_reconciled(report: DataFrame) -> None:
    row = report.first()
    if row is None or not row["ok"]:
        raise ValueError(f"row count mismatch: {row}")


def validate_table(name: str, df: DataFrame, min_rows: int = 1,
                   required_columns: Sequence[str] = ()) -> DataFrame:
    """One check row per table: at least one column, ``min_rows`` rows and
    the required columns.  (The byte-size minimum of the original is a
    file-system check: ``path_bytes``.)"""
    missing = [c for c in required_columns if c not in df.columns]
    n = df.agg(F.count(F.lit(1)).alias("rows"))
    ok = (F.lit(len(df.columns) >= 1) & (F.col("rows") >= min_rows) & F.lit(not missing))
    msg = (
        F.when(F.lit(len(df.columns) < 1), F.lit("no columns"))
        .when(F.lit(bool(missing)), F.lit("missing columns: " + ",".join(missing)))
        .when(F.col("rows") < min_rows, F.concat(F.lit("too few rows: "), F.col("rows").cast("string")))
        .otherwise(F.lit("ok"))
    )
    return n.select(F.lit(name).alias("table"), ok.alias("ok"), msg.alias("message"), "rows",
                    F.lit(len(df.columns)).alias("columns"))


def path_bytes(spark: SparkSession, path: str) -> int:
    """Total bytes below a path (Hadoop file system; works for any scheme)."""
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    fs = jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # type: ignore[union-attr]
    return int(fs.getContentSummary(jp).getLength())


def file_checks(spark: SparkSession, path: str, min_bytes: int) -> DataFrame:
    """S9, file-system half: the path exists, holds data files and reaches a
    minimum size.  Only listing metadata travels to the driver (one row)."""
    jvm = spark.sparkContext._jvm  # type: ignore[union-attr]
    jp = jvm.org.apache.hadoop.fs.Path(path)
    fs = jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # type: ignore[union-attr]
    exists = bool(fs.exists(jp))
    files = nbytes = 0
    if exists:
        summary = fs.getContentSummary(jp)
        files, nbytes = int(summary.getFileCount()), int(summary.getLength())
    ok = exists and files >= 1 and nbytes >= min_bytes
    msg = ("missing" if not exists else "no files" if files < 1
           else f"too small: {nbytes} < {min_bytes} bytes" if nbytes < min_bytes else "ok")
    return spark.createDataFrame([(path, exists, files, nbytes, ok, msg)],
                                 "path string, exists boolean, files bigint, bytes bigint, ok boolean, message string")


#: Least size in bytes of each table's file, and of any other table's.
MIN_BYTES = {
    "voertuigen": 500_000_000,
    "meldingen": 250_000_000,
    "geconstateerde_gebreken": 100_000_000,
    "gebreken": 10_000,
    "brandstof": 50_000_000,
}
MIN_BYTES_OTHER = 10_000


def table_file_checks(spark: SparkSession, base_dir: str, names: Sequence[str],
                      min_bytes: dict[str, int] = MIN_BYTES) -> DataFrame:
    """The file check of every named table below ``base_dir``, each with its least size."""
    checks = [file_checks(spark, f"{base_dir}/{n}.parquet", min_bytes.get(n, MIN_BYTES_OTHER)).withColumn("table", F.lit(n))
              for n in names]
    return reduce(DataFrame.unionByName, checks)


def assert_files(checks: DataFrame) -> None:
    """Stop unless every checked table has its files; the error names those that do not."""
    bad = [f"{r['table']}: {r['message']}" for r in checks.where(~F.col("ok")).orderBy("table").collect()]  # one row a table
    if bad:
        raise ValueError("table files are not fit for a run: " + "; ".join(bad))


def duplicate_audit(df: DataFrame) -> DataFrame:
    """Total rows, distinct rows and exact duplicate rows.

    Grouping on all columns is map-side combined, so a heavily repeated row
    collapses before the shuffle."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def _digest_sums(digest: Column) -> list[Column]:
    """Row count and the sums, as text, of both halves of a 32-digit hexadecimal digest."""
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)").cast("decimal(28,0)"))
    text = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)").cast("string")
    return [F.count(F.lit(1)).alias("rows"), text(half(1)).alias("digest_high"), text(half(17)).alias("digest_low")]


def row_digest(columns: Sequence[Column]) -> Column:
    """MD5 of a row: every value with its length, a null as ``n``, so values cannot
    run together and null, empty text and any literal text differ."""
    value = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("n"))
    return F.md5(F.concat(F.lit(""), *[value(c.cast("string")) for c in columns]))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint: row count and the sums of both
    halves of a per-row MD5 (as text).  Sums, unlike XOR, count repeated rows."""
    return df.agg(*_digest_sums(row_digest([F.col(c) for c in df.columns])))


def fingerprints(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The fingerprint of each group of ``by`` over ``columns`` (default: all others)."""
    digest = row_digest([F.col(c) for c in (columns or [c for c in df.columns if c not in by])])
    return df.groupBy(*by).agg(*_digest_sums(digest))


def recent_days(df: DataFrame, as_of: str, days: int, date_col: str = P.MELD_DATUM) -> DataFrame:
    """Keep reports dated on or after ``as_of`` minus ``days`` (compact
    string comparison, so on raw tables the predicate reaches the Parquet scan)."""
    cutoff = F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyyMMdd")
    return df.where(F.col(date_col) >= cutoff)


def row_count(df: DataFrame) -> DataFrame:
    """``count(*)`` of a dataset as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def age_band_rows(fact: DataFrame) -> DataFrame:
    """Every fact row once per (overlapping) age band that contains it.

    The four bands are a literal array filtered per row and exploded - no
    join, whole-stage code generation keeps it in one pass."""
    bands = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                      for n, lo, hi in P.AGE_BANDS])
    hit = F.filter(bands, lambda b: F.col("age_at_inspection").between(b["lo"], b["hi"]))
    return fact.select("*", F.explode(hit).alias("b")).select("*", F.col("b.band").alias("age_band")).drop("b")


def age_band_stats(fact: DataFrame) -> DataFrame:
    """Vehicles, inspections, defects and defects per inspection per age band."""
    from roadworthy.functions.normalize import rnd

    return (
        age_band_rows(fact)
        .groupBy("age_band")
        .agg(
            F.count_distinct(P.KENTEKEN).alias("vehicle_count"),
            F.count(F.lit(1)).alias("total_inspections"),
            F.sum("defect_count").alias("total_defects"),
        )
        .withColumn("avg_defects_per_inspection", rnd(F.col("total_defects") / F.col("total_inspections"), 4))
    )
