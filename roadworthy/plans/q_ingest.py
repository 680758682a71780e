"""Registered queries: ingest round trips and checks.

Round-trip queries stage the bound tables as CSV shard files below the
shared checkpoint folder and read them back, as the sharded download lands
its files; the result must equal the bound table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions.normalize import plate_prefix
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, fact_of, register, sources
from roadworthy.session import shared_dir
from roadworthy.sources import ingest as I
from roadworthy.sources import tables

VEHICLE_COLS = [P.KENTEKEN, P.VOERTUIGSOORT, P.MERK, P.HANDELSBENAMING, P.DATUM_EERSTE_TOELATING, P.CATALOGUSPRIJS,
                P.VERVALDATUM_APK]
AS_OF, DAYS = "2001-12-31", 365


def _odd_plates(v):
    """Vehicles of which a third have a plate that no prefix covers: lower case, a sign, or none."""
    k, n = F.col(P.KENTEKEN), F.length(P.KENTEKEN) + F.col(P.KENTEKEN).cast("int")
    return v.withColumn(P.KENTEKEN, F.when(n % 9 == 0, F.concat(F.lit("x"), k)).when(n % 9 == 3, F.concat(F.lit("-"), k))
                        .when(n % 9 == 6, F.lit(None).cast("string")).otherwise(k))


ODD_PLATES = """
, odd AS (
  SELECT * REPLACE (CASE WHEN (length(kenteken) + CAST(kenteken AS INTEGER)) % 9 = 0 THEN 'x' || kenteken
                         WHEN (length(kenteken) + CAST(kenteken AS INTEGER)) % 9 = 3 THEN '-' || kenteken
                         WHEN (length(kenteken) + CAST(kenteken AS INTEGER)) % 9 = 6 THEN NULL ELSE kenteken END AS kenteken)
  FROM vehicles)"""


@register("s2_scan_projection", lambda: O.q(
    "SELECT l_partkey, CAST(l_shipdate AS DATE) AS ship_day, l_linestatus FROM lineitem WHERE l_returnflag = 'R'",
    T))
def s2_scan_projection(spark, sf_dir):
    """Lazy scan with pruned columns and a pushed filter."""
    df = tables.read_table(spark, sf_dir, "lineitem")
    return df.where(F.col("l_returnflag") == "R").select(
        "l_partkey", F.col("l_shipdate").cast("date").alias("ship_day"), "l_linestatus")


@register("s1_logical_views", lambda: O.q("""
SELECT 'm9d7-ebf2' AS dataset, 'voertuigen' AS name, count(*) AS "rows", count(DISTINCT kenteken) AS plates FROM vehicles
UNION ALL SELECT 'sgfe-77wx', 'meldingen', count(*), count(DISTINCT kenteken) FROM inspections
UNION ALL SELECT 'a34c-vvps', 'geconstateerde_gebreken', count(*), count(DISTINCT kenteken) FROM defects
UNION ALL SELECT 'hx2c-gt7k', 'gebreken', count(*), NULL FROM codes
UNION ALL SELECT '8ys7-d773', 'brandstof', count(*), count(DISTINCT kenteken) FROM fuel""", T))
def s1_logical_views(spark, sf_dir):
    """The logical tables by dataset id, as views for SQL users."""
    src = sources(spark, sf_dir)
    tables.register_views({"voertuigen": src.vehicles, "meldingen": src.inspections, "geconstateerde_gebreken": src.defects,
                           "gebreken": src.codes, "brandstof": src.fuel})
    plates = lambda n: "NULL" if n == "gebreken" else "count(DISTINCT kenteken)"
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{i}' AS dataset, '{n}' AS name, count(*) AS rows, CAST({plates(n)} AS BIGINT) AS plates FROM {n}"
        for i, n in tables.DATASETS.items()))


@register("s3_load_columns", lambda: O.q("SELECT kenteken, merk FROM vehicles WHERE handelsbenaming IS NOT NULL", T))
def s3_load_columns(spark, sf_dir):
    """S2 + S3: a logical table written under its name, loaded with chosen columns and a filter."""
    base = shared_dir(spark, "s3")
    I.to_parquet(sources(spark, sf_dir).vehicles, f"{base}/voertuigen.parquet")
    named = tables.scan(spark, base, "voertuigen").where(F.col(P.HANDELSBENAMING).isNotNull())
    return named.select(*tables.load(spark, base, "voertuigen", [P.KENTEKEN, P.MERK]).columns)


@register("p2_plate_prefix", lambda: O.q("""
SELECT coalesce(upper(substr(kenteken, 1, 1)), '') AS prefix, count(*) AS "rows" FROM odd GROUP BY ALL""", T, ODD_PLATES))
def p2_plate_prefix(spark, sf_dir):
    v = _odd_plates(sources(spark, sf_dir).vehicles)
    return v.groupBy(plate_prefix(F.col(P.KENTEKEN)).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))


@register("s4_csv_round_trip", lambda: O.q("SELECT * FROM vehicles", T))
def s4_csv_round_trip(spark, sf_dir):
    v = sources(spark, sf_dir).vehicles
    base = shared_dir(spark, "s4")
    I.write_csv(v, base + "/csv")
    back = I.read_csv_strings(spark, base + "/csv")
    I.to_parquet(back, base + "/parquet")
    return spark.read.parquet(base + "/parquet")


def _staged_shards(spark, sf_dir):
    """Vehicles, and the frames of their shards: shard '1' lacks the price column
    and shard '2' carries an extra column, as drifting exports do."""
    v = _odd_plates(sources(spark, sf_dir).vehicles.select(*VEHICLE_COLS))
    base = shared_dir(spark, "s7")
    groups = I.write_shards(v, base, drop_columns={"1": [P.CATALOGUSPRIJS]},
                            extra_columns={"2": {"extra_note": F.lit("x")}})
    return v, [f for f in (I.read_csv_strings(spark, g) for g in groups) if f.columns]


@register("s5_prefix_shards", lambda: O.q("""
SELECT CASE WHEN regexp_matches(substr(kenteken, 1, 1), '^[0-9A-Z]$') THEN substr(kenteken, 1, 1) END AS shard,
       count(*) AS "rows",
       coalesce(regexp_matches(substr(kenteken, 1, 1), '^[0-9A-Z]$'), false) AS covered
FROM odd GROUP BY ALL""", T, ODD_PLATES))
def s5_prefix_shards(spark, sf_dir):
    return I.shard_counts(_odd_plates(sources(spark, sf_dir).vehicles))


@register("s7_tolerant_union", lambda: O.q("""
SELECT kenteken, voertuigsoort, merk, handelsbenaming, datum_eerste_toelating,
       CASE WHEN starts_with(kenteken, '1') THEN NULL ELSE catalogusprijs END AS catalogusprijs, vervaldatum_apk
FROM odd""", T, ODD_PLATES))
def s7_tolerant_union(spark, sf_dir):
    _, shards = _staged_shards(spark, sf_dir)
    schema = tables.SCHEMAS["voertuigen"]
    return I.tolerant_union(shards, schema)


@register("s6_union_schema", lambda: O.q("""
SELECT position, name, 'string' AS type, filled FROM (
  SELECT 0 AS position, 'kenteken' AS name, count(kenteken) AS filled FROM odd
  UNION ALL SELECT 1, 'voertuigsoort', count(voertuigsoort) FROM odd
  UNION ALL SELECT 2, 'merk', count(merk) FROM odd
  UNION ALL SELECT 3, 'handelsbenaming', count(handelsbenaming) FROM odd
  UNION ALL SELECT 4, 'datum_eerste_toelating', count(datum_eerste_toelating) FROM odd
  UNION ALL SELECT 5, 'catalogusprijs', count(CASE WHEN starts_with(kenteken, '1') THEN NULL ELSE catalogusprijs END) FROM odd
  UNION ALL SELECT 6, 'vervaldatum_apk', count(vervaldatum_apk) FROM odd
  UNION ALL SELECT 7, 'extra_note', count(CASE WHEN starts_with(kenteken, '2') THEN 1 END) FROM odd)""", T, ODD_PLATES))
def s6_union_schema(spark, sf_dir):
    """The union schema of the staged shards: position, name, type and filled values of each column."""
    _, shards = _staged_shards(spark, sf_dir)
    sch = I.union_schema(shards)
    merged = I.tolerant_union(shards, sch)
    described = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"),
                                   F.lit(f.dataType.simpleString()).alias("type"), F.count(f.name).alias("filled"))
                          for i, f in enumerate(sch.fields)])
    return merged.agg(described.alias("d")).select(F.inline("d"))


@register("s8_reconciliation", lambda: O.q("""
SELECT count(*) AS source_rows, count(*) AS shard_rows, count(*) AS merged_rows, true AS ok FROM odd""", T, ODD_PLATES))
def s8_reconciliation(spark, sf_dir):
    """The three counts, observed while the shards are written, read back and merged."""
    return _merged(spark, sf_dir)[1].drop("group_rows")


def _merged(spark, sf_dir):
    v = _odd_plates(sources(spark, sf_dir).vehicles.select(*VEHICLE_COLS))
    return I.merge_observed(v, shared_dir(spark, "s8"), tables.SCHEMAS["voertuigen"], drop_columns={"1": [P.CATALOGUSPRIJS]},
                            extra_columns={"2": {"extra_note": F.lit("x")}})


@register("s8_merged_table", lambda: O.q("""
SELECT kenteken, voertuigsoort, merk, handelsbenaming, datum_eerste_toelating,
       CASE WHEN starts_with(kenteken, '1') THEN NULL ELSE catalogusprijs END AS catalogusprijs, vervaldatum_apk
FROM odd""", T, ODD_PLATES))
def s8_merged_table(spark, sf_dir):
    """S7 + S8: the table merged while it was counted."""
    return _merged(spark, sf_dir)[0]


@register("s8_separate_counts", lambda: O.q("""
SELECT count(*) AS source_rows, count(*) AS shard_rows, count(*) AS merged_rows, true AS ok FROM odd""", T, ODD_PLATES))
def s8_separate_counts(spark, sf_dir):
    """S8 for tables written elsewhere: the same counts by scans."""
    v, shards = _staged_shards(spark, sf_dir)
    merged = I.tolerant_union(shards, tables.SCHEMAS["voertuigen"])
    return I.reconcile(v, shards, merged)


_LINE = "concat_ws(',', " + ", ".join(f"coalesce({c}, '')" for c in VEHICLE_COLS) + ")"
_CUT = "concat_ws(',', " + ", ".join(f"coalesce({c}, '')" for c in VEHICLE_COLS[:-2]) + ")"
_BAD_LINES = f"""
, lines AS (
  SELECT *, CASE CAST(kenteken AS INTEGER) % 10 WHEN 3 THEN {_CUT} WHEN 6 THEN {_LINE} || ',more' ELSE {_LINE} END AS line FROM vehicles)"""


def _staged_lines(spark, sf_dir):
    """Vehicles as CSV lines, of which a tenth have two fields too few and a tenth one too many."""
    v = sources(spark, sf_dir).vehicles.select(*VEHICLE_COLS)
    text = lambda cols: F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cols])
    odd = F.col(P.KENTEKEN).cast("int") % 10
    line = (F.when(odd == 3, text(VEHICLE_COLS[:-2])).when(odd == 6, F.concat(text(VEHICLE_COLS), F.lit(",more")))
            .otherwise(text(VEHICLE_COLS)))
    base = shared_dir(spark, "s4-lines")
    v.select(line.alias("line")).write.text(f"{base}/lines")
    return I.stage_csv(spark, f"{base}/lines", f"{base}/staged", VEHICLE_COLS, header=False)


@register("s4_good_lines", lambda: O.q(
    f"SELECT {', '.join(VEHICLE_COLS)} FROM lines WHERE CAST(kenteken AS INTEGER) % 10 NOT IN (3, 6)", T, _BAD_LINES))
def s4_good_lines(spark, sf_dir):
    """The rows of the lines that fit, from shards that hold others too."""
    return _staged_lines(spark, sf_dir)[0]


@register("s4_quarantine", lambda: O.q("SELECT line FROM lines WHERE CAST(kenteken AS INTEGER) % 10 IN (3, 6)", T, _BAD_LINES))
def s4_quarantine(spark, sf_dir):
    """The whole text of every line that does not fit."""
    return _staged_lines(spark, sf_dir)[1].select("line")


@register("s9_table_checks", lambda: O.q("""
SELECT 'meldingen' AS "table", count(*) >= 1 AS ok, CASE WHEN count(*) >= 1 THEN 'ok' ELSE 'too few rows' END
       AS message, count(*) AS "rows", 5 AS columns FROM inspections
UNION ALL
SELECT 'gebreken', false, 'missing columns: gebrek_categorie', count(*), 2 FROM codes""", T))
def s9_table_checks(spark, sf_dir):
    src = sources(spark, sf_dir)
    a = I.validate_table("meldingen", src.inspections, 1, [P.KENTEKEN, P.MELD_DATUM])
    b = I.validate_table("gebreken", src.codes, 1, [P.GEBREK_ID, "gebrek_categorie"])
    return a.unionByName(b)


@register("s10_duplicate_audit", lambda: O.q("""
SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM inspections)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM inspections)) AS duplicate_rows
FROM inspections""", T))
def s10_duplicate_audit(spark, sf_dir):
    return I.duplicate_audit(sources(spark, sf_dir).inspections)


_DIGEST = "md5(" + " || ".join(f"coalesce(length({c}) || ':' || {c}, 'n')" for c in VEHICLE_COLS) + ")"


@register("s15_fingerprint", lambda: O.q(f"""
SELECT count(*) AS "rows", CAST(sum(CAST(('0x' || substr({_DIGEST}, 1, 16)) AS UBIGINT)) AS VARCHAR) AS digest_high,
       CAST(sum(CAST(('0x' || substr({_DIGEST}, 17, 16)) AS UBIGINT)) AS VARCHAR) AS digest_low
FROM vehicles""", T))
def s15_fingerprint(spark, sf_dir):
    return I.fingerprint(sources(spark, sf_dir).vehicles)


@register("s16_recent_days", lambda: O.q(f"""
SELECT * FROM inspections
WHERE meld_datum_door_keuringsinstantie >= strftime(DATE '{AS_OF}' - INTERVAL {DAYS} DAY, '%Y%m%d')""", T))
def s16_recent_days(spark, sf_dir):
    return I.recent_days(sources(spark, sf_dir).inspections, AS_OF, DAYS)


@register("s17_row_count", lambda: O.q("SELECT count(*) AS row_count FROM defects", T))
def s17_row_count(spark, sf_dir):
    return I.row_count(sources(spark, sf_dir).defects)


@register("p38_coverage_years", lambda: O.q(f"""
SELECT kenteken, meld_datum_door_keuringsinstantie,
       {O.R("CASE WHEN try_strptime(meld_datum_door_keuringsinstantie, '%Y%m%d') IS NULL OR try_strptime(vervaldatum_keuring, '%Y%m%d') IS NULL THEN 1.0 ELSE greatest(date_diff('day', CAST(try_strptime(meld_datum_door_keuringsinstantie, '%Y%m%d') AS DATE), CAST(try_strptime(vervaldatum_keuring, '%Y%m%d') AS DATE)) / 365.25, 0.25) END", 6)}
         AS coverage_years
FROM inspections""", T))
def p38_coverage_years(spark, sf_dir):
    from roadworthy.functions.normalize import rnd

    i = sources(spark, sf_dir).inspections
    return i.select(P.KENTEKEN, P.MELD_DATUM,
                    rnd(I.coverage_years(F.col(P.MELD_DATUM), F.col(P.VERVALDATUM_KEURING)), 6).alias("coverage_years"))


@register("p39_age_bands", lambda: O.q(f"""
SELECT b.band AS age_band, count(DISTINCT kenteken) AS vehicle_count, count(*) AS total_inspections,
       {O.SUMI('defect_count')} AS total_defects, {O.R('sum(defect_count) / count(*)', 4)} AS avg_defects_per_inspection
FROM fact f JOIN (VALUES {', '.join(f"('{n}', {lo}, {hi})" for n, lo, hi in P.AGE_BANDS)}) b(band, lo, hi)
  ON f.age_at_inspection BETWEEN b.lo AND b.hi
GROUP BY b.band""", T))
def p39_age_bands(spark, sf_dir):
    return I.age_band_stats(fact_of(sources(spark, sf_dir)))
