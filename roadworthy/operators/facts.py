"""Inspection-grain fact table ``inspection_stats``.

Each input is reduced *before* the joins: report and defect rows together to
one row per vehicle and day (earliest report and its defect sum, see
``primary_reports_with_counts``), fuel rows to one row per vehicle and
vehicles to one row per plate.  The reductions bound the rows per plate that
reach a join (at most one per day), so even a plate holding a large share of
raw rows cannot overload one join task; the aggregations themselves combine
map-side.  The two remaining joins are equi-joins on the plate and share one
partitioning.  ``primary_inspections`` / ``defect_counts`` / ``join_fact`` are
the same steps one at a time (A1, A2, J1-J3), kept as separate operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions import normalize as N

FACT_COLUMNS = (
    P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.MERK, P.HANDELSBENAMING, P.CATALOGUSPRIJS,
    "vehicle_type_group", "primary_fuel", "insp_year", "age_at_inspection", "defect_count",
)


def primary_inspections(inspections: DataFrame, with_expiry: bool = False) -> DataFrame:
    """A1: periodic reports -> earliest normalised time per (plate, day), plus year.

    Later same-day reports are re-tests and are dropped (D16).  With
    ``with_expiry`` the expiry date of that earliest report is kept as well
    (for the documented coverage-years exposure, P38/D1).
    """
    cols = [P.KENTEKEN, P.MELD_DATUM, N.normalized_time(F.col(P.MELD_TIJD)).alias(P.MELD_TIJD)]
    aggs = [F.min(P.MELD_TIJD).alias(P.MELD_TIJD)]
    if with_expiry:
        cols.append(P.VERVALDATUM_KEURING)
        # Of several reports at that time, the earliest expiry date that is given.
        first = F.struct(P.MELD_TIJD, F.col(P.VERVALDATUM_KEURING).isNull().alias("none"), P.VERVALDATUM_KEURING)
        aggs.append(F.min(first)[P.VERVALDATUM_KEURING].alias(P.VERVALDATUM_KEURING))
    return (
        inspections.where(N.is_periodic_report(F.col(P.SOORT_MELDING)))
        .select(*cols)
        .groupBy(P.KENTEKEN, P.MELD_DATUM)
        .agg(*aggs)
        .withColumn("insp_year", N.year_of(F.col(P.MELD_DATUM)))
    )


def defect_counts(defects: DataFrame, on_bad: str = "raise") -> DataFrame:
    """A2: sum of defect quantities per report (plate, day, normalised time)."""
    return (
        defects.select(
            P.KENTEKEN,
            P.MELD_DATUM,
            N.normalized_time(F.col(P.MELD_TIJD)).alias(P.MELD_TIJD),
            N.defect_quantity(F.col(P.AANTAL_GEBREKEN), on_bad).alias("qty"),
        )
        .groupBy(P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD)
        .agg(F.sum("qty").alias("defect_count"))
    )


def fuel_indicators(fuel: DataFrame) -> DataFrame:
    """A3: per plate, whether any fuel row names each known fuel."""
    b = F.col(P.BRANDSTOF)

    def has(v: str):
        return F.coalesce(F.bool_or(b == F.lit(v)), F.lit(False))

    return fuel.groupBy(P.KENTEKEN).agg(
        has(P.FUEL_ELECTRIC).alias("has_electric"),
        has(P.FUEL_PETROL).alias("has_benzine"),
        has(P.FUEL_DIESEL).alias("has_diesel"),
        has(P.FUEL_LPG).alias("has_lpg"),
    )


def primary_fuel(fuel: DataFrame) -> DataFrame:
    """A4: one fuel class per plate, LPG > Hybrid > electric > diesel > petrol > Other."""
    ind = fuel_indicators(fuel)
    e, b, d, lpg = (F.col(c) for c in ("has_electric", "has_benzine", "has_diesel", "has_lpg"))
    return ind.select(
        P.KENTEKEN,
        F.when(lpg, F.lit(P.FUEL_LPG))
        .when(e & (b | d), F.lit(P.FUEL_HYBRID))
        .when(e, F.lit(P.FUEL_ELECTRIC))
        .when(d, F.lit(P.FUEL_DIESEL))
        .when(b, F.lit(P.FUEL_PETROL))
        .otherwise(F.lit(P.FUEL_OTHER_PRIMARY))
        .alias("primary_fuel"),
    )


def vehicle_attributes(vehicles: DataFrame, on_bad: str = "raise") -> DataFrame:
    """A5 with P5-P8: normalised attributes, consumer/commercial only, one row per plate.

    Duplicate plates keep the row that is smallest over all attribute columns,
    a deterministic choice (D13).  ``min(struct)`` is an aggregate, so a plate
    repeated many times is combined map-side instead of sorted in one task.
    """
    attrs = vehicles.select(
        P.KENTEKEN,
        N.upper_strip(F.col(P.MERK)).alias(P.MERK),
        N.upper_strip(F.col(P.HANDELSBENAMING)).alias(P.HANDELSBENAMING),
        F.col(P.DATUM_EERSTE_TOELATING),
        N.price(F.col(P.CATALOGUSPRIJS), on_bad == "raise").alias(P.CATALOGUSPRIJS),
        N.vehicle_type_group(F.col(P.VOERTUIGSOORT)).alias("vehicle_type_group"),
    ).where(F.col("vehicle_type_group").isin(P.GROUP_CONSUMER, P.GROUP_COMMERCIAL))
    cols = [P.MERK, P.HANDELSBENAMING, P.DATUM_EERSTE_TOELATING, P.CATALOGUSPRIJS, "vehicle_type_group"]
    return (
        attrs.groupBy(P.KENTEKEN)
        .agg(F.min(F.struct(*cols)).alias("v"))
        .select(P.KENTEKEN, *[F.col("v." + c).alias(c) for c in cols])
    )


def join_fact(prim: DataFrame, vehicles: DataFrame, fuel: DataFrame, counts: DataFrame) -> DataFrame:
    """J1-J3 + P9/P10: join the reduced inputs into the 11-column fact (plus
    ``coverage_years`` when the primary reports carry their expiry)."""
    age = F.col("insp_year") - N.year_of(F.col(P.DATUM_EERSTE_TOELATING))
    extra = ([N.coverage_years(F.col(P.MELD_DATUM), F.col(P.VERVALDATUM_KEURING)).alias("coverage_years")]
             if P.VERVALDATUM_KEURING in prim.columns else [])
    return (
        prim.join(vehicles, P.KENTEKEN, "inner")
        .withColumn("age_at_inspection", age)
        .where(F.col("age_at_inspection").between(P.AGE_MIN, P.AGE_MAX))
        .join(fuel, P.KENTEKEN, "left")
        .join(counts, [P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD], "left")
        .select(
            P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.MERK, P.HANDELSBENAMING, P.CATALOGUSPRIJS,
            "vehicle_type_group",
            F.coalesce(F.col("primary_fuel"), F.lit(P.FUEL_OTHER_PRIMARY)).alias("primary_fuel"),
            "insp_year",
            "age_at_inspection",
            F.coalesce(F.col("defect_count"), F.lit(0).cast("bigint")).alias("defect_count"),
            *extra,
        )
    )


def primary_reports_with_counts(inspections: DataFrame, defects: DataFrame, on_bad: str = "raise",
                                with_expiry: bool = False) -> DataFrame:
    """A1 + A2 + J3 as one reduction: each (plate, day) with its earliest
    periodic report time and the defect quantity of that report.

    Report rows and defect rows are unioned and reduced twice:

    1. per (plate, day, time): "is there a periodic report" and the defect
       sum - boolean/long buffers, so this raw-data aggregation is a hash
       aggregate that combines map-side;
    2. per (plate, day), over the times that have a report: the smallest
       (time, defect sum) pair, i.e. the earliest report and its defects.

    Identical to ``primary_inspections`` left-joined with ``defect_counts``
    on (plate, day, time), without re-keying the joined fact for that join.
    """
    t = N.normalized_time(F.col(P.MELD_TIJD)).alias(P.MELD_TIJD)
    exp = [F.col(P.VERVALDATUM_KEURING)] if with_expiry else []
    no_exp = [F.lit(None).cast("string").alias(P.VERVALDATUM_KEURING)] if with_expiry else []
    reports = inspections.where(N.is_periodic_report(F.col(P.SOORT_MELDING))).select(
        P.KENTEKEN, P.MELD_DATUM, t, F.lit(True).alias("_report"), F.lit(0).cast("bigint").alias("_qty"), *exp)
    found = defects.select(
        P.KENTEKEN, P.MELD_DATUM, t, F.lit(False).alias("_report"),
        N.defect_quantity(F.col(P.AANTAL_GEBREKEN), on_bad).alias("_qty"), *no_exp)
    per_time = reports.unionByName(found).groupBy(P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD).agg(
        F.bool_or("_report").alias("_report"), F.sum("_qty").alias("_qty"),
        *([F.min(P.VERVALDATUM_KEURING).alias(P.VERVALDATUM_KEURING)] if with_expiry else []))
    fields = [P.MELD_TIJD, "_qty"] + ([P.VERVALDATUM_KEURING] if with_expiry else [])
    per_day = per_time.where("_report").groupBy(P.KENTEKEN, P.MELD_DATUM).agg(F.min(F.struct(*fields)).alias("m"))
    return per_day.select(
        P.KENTEKEN, P.MELD_DATUM, F.col("m." + P.MELD_TIJD).alias(P.MELD_TIJD),
        F.col("m._qty").alias("defect_count"),
        *([F.col("m." + P.VERVALDATUM_KEURING).alias(P.VERVALDATUM_KEURING)] if with_expiry else []),
        N.year_of(F.col(P.MELD_DATUM), on_bad == "raise").alias("insp_year"),
    )


def join_reports(reports: DataFrame, vehicles: DataFrame, fuel: DataFrame, on_bad: str = "raise") -> DataFrame:
    """J1 + J2 + P9/P10 over ``primary_reports_with_counts``: both joins are on
    the plate, so they share one partitioning."""
    age = F.col("insp_year") - N.year_of(F.col(P.DATUM_EERSTE_TOELATING), on_bad == "raise")
    extra = ([N.coverage_years(F.col(P.MELD_DATUM), F.col(P.VERVALDATUM_KEURING)).alias("coverage_years")]
             if P.VERVALDATUM_KEURING in reports.columns else [])
    return (
        reports.join(vehicles, P.KENTEKEN, "inner")
        .withColumn("age_at_inspection", age)
        .where(F.col("age_at_inspection").between(P.AGE_MIN, P.AGE_MAX))
        .join(fuel, P.KENTEKEN, "left")
        .select(
            P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.MERK, P.HANDELSBENAMING, P.CATALOGUSPRIJS,
            "vehicle_type_group",
            F.coalesce(F.col("primary_fuel"), F.lit(P.FUEL_OTHER_PRIMARY)).alias("primary_fuel"),
            "insp_year",
            "age_at_inspection",
            "defect_count",
            *extra,
        )
    )


def inspection_stats(inspections: DataFrame, vehicles: DataFrame, defects: DataFrame, fuel: DataFrame,
                     on_bad: str = "raise", with_coverage: bool = False) -> DataFrame:
    """The whole fact build as one lazy plan (``with_coverage`` adds the
    documented coverage years per inspection, D1)."""
    return join_reports(
        primary_reports_with_counts(inspections, defects, on_bad, with_coverage),
        vehicle_attributes(vehicles, on_bad),
        primary_fuel(fuel),
        on_bad,
    )


def rejected_values(inspections: DataFrame, vehicles: DataFrame, defects: DataFrame) -> DataFrame:
    """Values that ``on_bad="one"`` replaces: table, column, value and number of rows.

    A quantity counts as 1 and a price as 0; a report or vehicle whose date has
    no year has no age and leaves the fact."""
    def bad(table: str, df: DataFrame, column: str, parsed: F.Column) -> DataFrame:
        return df.where(F.col(column).isNotNull() & parsed.isNull()).groupBy(
            F.lit(table).alias("table"), F.lit(column).alias("column"), F.col(column).alias("value")
        ).agg(F.count(F.lit(1)).alias("rows"))

    year = lambda c: N.year_of(F.col(c), strict=False)
    return (
        bad("meldingen", inspections, P.MELD_DATUM, year(P.MELD_DATUM))
        .unionByName(bad("voertuigen", vehicles, P.DATUM_EERSTE_TOELATING, year(P.DATUM_EERSTE_TOELATING)))
        .unionByName(bad("voertuigen", vehicles, P.CATALOGUSPRIJS, F.col(P.CATALOGUSPRIJS).try_cast("double")))
        .unionByName(bad("geconstateerde_gebreken", defects, P.AANTAL_GEBREKEN, F.col(P.AANTAL_GEBREKEN).try_cast("bigint")))
    )
