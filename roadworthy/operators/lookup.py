"""Batch vehicle lookup: plate -> vehicle, recent reports and their defects
(J10, W5, P34-P37).

The original answers one typed plate at a time with three remote requests.
Here a whole DataFrame of typed plates is answered with semi joins against
the three tables.  Histories are complete; the page sizes of the original's
display (50 reports, 100 defect rows) are explicit arguments.  Rows are
numbered day by day (see ``_ranked``), so a plate with a huge history is never
ordered in one task.  Defects attach to reports by date only, as in the
original display.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions import formatting as FM
from roadworthy.operators.defects import code_index


def normalized_plates(typed: DataFrame, column: str = "typed_plate") -> DataFrame:
    """Normalised plate and validity per typed input."""
    n = FM.normalize_plate(F.col(column))
    return typed.select(F.col(column), n.alias(P.KENTEKEN), FM.plate_is_valid(n).alias("valid"))


def _valid_keys(typed: DataFrame, column: str) -> DataFrame:
    return normalized_plates(typed, column).where("valid").select(P.KENTEKEN).distinct()


def lookup_vehicles(typed: DataFrame, vehicles: DataFrame, reports: DataFrame, as_of: str,
                    column: str = "typed_plate") -> DataFrame:
    """Per typed plate: status (invalid / not_found / found), the vehicle's
    attributes (deterministic first row when a plate repeats), the
    certificate status (P36) and the number of its reports."""
    plates = normalized_plates(typed, column)
    cols = [P.MERK, P.HANDELSBENAMING, P.DATUM_EERSTE_TOELATING, P.VOERTUIGSOORT, P.VERVALDATUM_APK]
    v = (
        vehicles.join(_valid_keys(typed, column), P.KENTEKEN, "left_semi")  # AQE: broadcast only if small
        .groupBy(P.KENTEKEN)
        .agg(F.min(F.struct(*cols)).alias("v"))
        .select(P.KENTEKEN, *[F.col("v." + c).alias(c) for c in cols], F.lit(True).alias("_found"))
    )
    n_rep = reports.join(_valid_keys(typed, column), P.KENTEKEN, "left_semi").groupBy(P.KENTEKEN).agg(
        F.count(F.lit(1)).alias("reports")
    )
    j = plates.join(v, P.KENTEKEN, "left").join(n_rep, P.KENTEKEN, "left")
    status = (
        F.when(~F.col("valid"), F.lit("invalid"))
        .when(F.col("_found").isNull(), F.lit("not_found"))
        .otherwise(F.lit("found"))
    )
    return j.select(
        column, P.KENTEKEN, status.alias("status"), P.MERK, P.HANDELSBENAMING,
        FM.compact_date_display(F.col(P.DATUM_EERSTE_TOELATING)).alias("first_admission"),
        F.when(status == "found", FM.certificate_status(F.col(P.VERVALDATUM_APK), as_of)).alias("certificate"),
        F.when(status == "found", F.coalesce(F.col("reports"), F.lit(0).cast("bigint"))).alias("reports"),
    )


# Working column of the day, and its value for a row without date (no date has it).
DAY, NO_DAY = "_day", "\u0000"


def _ranked(rows: DataFrame, typed: DataFrame, column: str, order: list, rank_col: str, k: int | None) -> DataFrame:
    """The looked-up plates' rows numbered per plate, newest day first, then by ``order``; the first k if given.

    One plan for every size: the plate set is a semi join, and a row's number
    is its number within (plate, day) plus the plate's rows on later days.  So
    a plate's history is ordered day by day, never whole in one task; the
    counts per day combine map-side, and a plate has at most one row a day of them.
    """
    # One key for the ranking, the counts and the later join of reports and
    # defects, so that rows are shuffled on it once; a missing day is a day of its own.
    mine = rows.join(_valid_keys(typed, column), P.KENTEKEN, "left_semi").withColumn(
        DAY, F.coalesce(F.col(P.MELD_DATUM), F.lit(NO_DAY)))
    per_day = mine.groupBy(P.KENTEKEN, DAY).agg(F.count(F.lit(1)).alias("_n"), F.max(P.MELD_DATUM).alias("_date"))
    later = Window.partitionBy(P.KENTEKEN).orderBy(F.col("_date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = per_day.select(P.KENTEKEN, DAY, F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))
    if k is not None:
        before = before.where(F.col("_before") < k)
    in_day = F.row_number().over(Window.partitionBy(P.KENTEKEN, DAY).orderBy(*order))
    numbered = mine.withColumn("_in_day", in_day).join(before, [P.KENTEKEN, DAY])
    out = numbered.withColumn(rank_col, (F.col("_before") + F.col("_in_day")).cast("int")).drop("_before", "_in_day")
    return out if k is None else out.where(F.col(rank_col) <= k)


def _report_order() -> list:
    return [F.col(P.MELD_TIJD).desc(), F.col(P.SOORT_MELDING).asc()]


def _defect_order() -> list:
    return [F.col(P.MELD_TIJD).desc(), F.col(P.GEBREK_ID).asc(), F.col(P.AANTAL_GEBREKEN).asc()]


def recent_reports(typed: DataFrame, reports: DataFrame, k: int | None = P.LOOKUP_MAX_REPORTS,
                   column: str = "typed_plate") -> DataFrame:
    """The k most recent reports per looked-up plate (date desc, then time desc); all with ``k=None``."""
    return _ranked(reports, typed, column, _report_order(), "report_rank", k).select(*reports.columns, "report_rank")


def recent_defects(typed: DataFrame, defects: DataFrame, k: int | None = P.LOOKUP_MAX_DEFECTS,
                   column: str = "typed_plate") -> DataFrame:
    """The first k defect rows per plate (most recent first, code as tie-break); all with ``k=None``."""
    return _ranked(defects, typed, column, _defect_order(), "defect_rank", k).select(*defects.columns, "defect_rank")


def vehicle_history(typed: DataFrame, reports: DataFrame, defects: DataFrame, codes: DataFrame,
                    result_column: str = P.SOORT_MELDING, column: str = "typed_plate",
                    max_reports: int | None = None, max_defects: int | None = None) -> DataFrame:
    """J10 in long form: one row per report and attached defect row (a report
    without defects has null defect columns).  The history is complete; the
    page sizes of a display are explicit arguments.

    The description join matches the code text literally (a code containing
    quotes is just a value here, no query text is built from it)."""
    rep = _ranked(reports, typed, column, _report_order(), "report_rank", max_reports).select(
        P.KENTEKEN, DAY, P.MELD_TIJD, "report_rank",
        FM.compact_date_display(F.col(P.MELD_DATUM)).alias("report_date"),
        FM.passed(F.col(result_column)).alias("passed"),
    )
    # A defect row without date belongs to no report, but counts in the ranks.
    dft = _ranked(defects, typed, column, _defect_order(), "defect_rank", max_defects).where(F.col(DAY) != NO_DAY).select(
        P.KENTEKEN, DAY, F.col(P.GEBREK_ID).alias("defect_code"),
        F.col(P.AANTAL_GEBREKEN).alias("defect_count"), "defect_rank",
    )
    # Code index: one description per code; an empty description counts as none.
    idx = code_index(codes)
    desc = idx.select("defect_code", F.when(F.col("description") != "", F.col("description")).alias("description"))
    dft = dft.join(desc, "defect_code", "left")
    return rep.join(dft, [P.KENTEKEN, DAY], "left").select(
        P.KENTEKEN, "report_rank", "report_date", P.MELD_TIJD, "passed", "defect_rank", "defect_code",
        "description", "defect_count",
    )


def uncached_codes(typed: DataFrame, defects: DataFrame, cached: DataFrame,
                   column: str = "typed_plate") -> DataFrame:
    """Distinct codes of the plates' defects whose description is not in
    ``cached`` (a frame with ``defect_code``): the set difference the
    original computes before fetching descriptions, as an anti join."""
    shown = defects.join(_valid_keys(typed, column), P.KENTEKEN, "left_semi").select(
        F.col(P.GEBREK_ID).alias("defect_code")).distinct()
    return shown.join(cached.select("defect_code"), "defect_code", "left_anti")
