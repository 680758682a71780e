"""Registered queries: fuel breakdowns and the fuel view."""

from __future__ import annotations

from roadworthy import params as P
from roadworthy.operators import explore as X
from roadworthy.operators import fuel as FU
from roadworthy.operators import segments
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, fact_of, positions, register, six_digits, sources

FUEL_CTE = f"""
, fwv AS (
  SELECT f.kenteken,
         CASE WHEN f.brandstof_omschrijving IN ('Benzine', 'Diesel', 'Elektriciteit', 'LPG')
              THEN f.brandstof_omschrijving ELSE 'other' END AS fuel_type,
         {O.STRIP('upper(v.merk)')} AS merk, {O.STRIP('upper(v.handelsbenaming)')} AS handelsbenaming
  FROM fuel f JOIN vehicles v ON f.kenteken = v.kenteken),
fmodel AS (SELECT merk, handelsbenaming, fuel_type, count(DISTINCT kenteken) AS "count" FROM fwv GROUP BY ALL),
fbrand AS (SELECT merk, fuel_type, {O.SUMI('"count"')} AS "count" FROM fmodel GROUP BY ALL)"""


def _wide(src: str, keys: str) -> str:
    cols = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN fuel_type = '{b}' THEN \"count\" END), 0) AS BIGINT) AS \"{b}\""
        for b in FU.BUCKETS
    )
    return f"SELECT {keys}, {cols} FROM {src} GROUP BY {keys}"


WIDE_CTE = FUEL_CTE + f"""
, fwide_b AS ({_wide('fbrand', 'merk')}),
fwide_m AS ({_wide('fmodel', 'merk, handelsbenaming')})"""


def _attach(seg: str, wide: str, on: str) -> str:
    cols = ", ".join(f"CAST(coalesce(w.\"{b}\", 0) AS BIGINT) AS \"{b}\"" for b in FU.BUCKETS)
    return f"SELECT s.*, {cols} FROM {seg} s LEFT JOIN {wide} w ON {on}"


SEG_FUEL_CTE = WIDE_CTE + f"""
, bsegf AS ({_attach('bseg', 'fwide_b', 's.merk = w.merk')}),
msegf AS ({_attach('mseg', 'fwide_m', 's.merk = w.merk AND s.handelsbenaming = w.handelsbenaming')})"""

FUEL_VIEW = X.ViewFilter(view="brands", show_commercial=False, min_inspections=20, min_fleet=5)
FUEL_VIEW_MODELS = X.ViewFilter(view="models", fuels=("Benzine", "Diesel", "Hybrid"), search="brand#1",
                                max_fleet=30)


def fuel_view_sql(f: X.ViewFilter, src: str) -> str:
    from roadworthy.plans.q_explore import row_where_sql, search_sql

    keys = ", ".join(f.keys)
    insp = f"total_inspections >= {f.min_inspections}"
    if f.max_inspections < f.max_inspections_available:
        insp += f" AND total_inspections <= {f.max_inspections}"
    total = " + ".join(f'"{b}"' for b in FU.BUCKETS)

    def pct(c):
        return (f"CAST(CASE WHEN ({total}) > 0 THEN floor((200 * \"{c}\" + ({total})) / (2 * ({total}))) "
                f"ELSE 0 END AS BIGINT)")

    maxf = "" if f.max_fleet == X.INF else f" AND vehicle_count <= {f.max_fleet}"
    return f"""
SELECT *, {pct('Benzine')} AS petrol_pct, {pct('Diesel')} AS diesel_pct, {pct('Elektriciteit')} AS electric_pct
FROM (SELECT {keys}, {O.SUMI('vehicle_count')} AS vehicle_count,
             {', '.join(f'max("{b}") AS "{b}"' for b in FU.BUCKETS)}
      FROM {src} WHERE {row_where_sql(f)} AND {insp} AND {search_sql(f)} GROUP BY {keys})
WHERE vehicle_count >= {f.min_fleet}{maxf}"""


@register("j5_fuel_with_vehicle", lambda: O.q("SELECT * FROM fwv", T, FUEL_CTE))
def j5_fuel_with_vehicle(spark, sf_dir):
    src = sources(spark, sf_dir)
    return FU.fuel_with_vehicle(src.fuel, src.vehicles)


@register("j5_counted", lambda: O.q("SELECT kenteken, fuel_type, merk, handelsbenaming, count(*) AS n FROM fwv GROUP BY ALL", T, FUEL_CTE))
def j5_counted(spark, sf_dir):
    """J5 with multiplicities in place of repeated rows."""
    src = sources(spark, sf_dir)
    return FU.fuel_with_vehicle_counts(src.fuel, src.vehicles)


@register("t8_name_order", lambda: O.q(
    "SELECT merk, vehicle_count, CAST(row_number() OVER (ORDER BY merk COLLATE nl DESC, merk) AS INTEGER) AS position FROM ("
    + fuel_view_sql(FUEL_VIEW, "bsegf") + ")", T, SEG_FUEL_CTE))
def t8_name_order(spark, sf_dir):
    """The fuel view by name, in the order of the Dutch locale."""
    v = X.fuel_view(brand_segments_with_fuel(spark, sf_dir), FUEL_VIEW)
    return positions(X.fuel_view_sort(v, P.MERK, ascending=False, locale="nl").select(P.MERK, "vehicle_count"))


@register("a21_fuel_by_model", lambda: O.q("SELECT * FROM fmodel", T, FUEL_CTE))
def a21_fuel_by_model(spark, sf_dir):
    src = sources(spark, sf_dir)
    return FU.fuel_by_model(src.fuel, src.vehicles)


@register("a22_fuel_by_brand", lambda: O.q("SELECT * FROM fbrand", T, FUEL_CTE))
def a22_fuel_by_brand(spark, sf_dir):
    src = sources(spark, sf_dir)
    return FU.fuel_by_brand(FU.fuel_by_model(src.fuel, src.vehicles))


@register("a23_fuel_pivot_brand", lambda: O.q("SELECT * FROM fwide_b", T, WIDE_CTE))
def a23_fuel_pivot_brand(spark, sf_dir):
    src = sources(spark, sf_dir)
    return FU.pivot_breakdown(FU.fuel_by_brand(FU.fuel_by_model(src.fuel, src.vehicles)), [P.MERK])


@register("a23_fuel_pivot_model", lambda: O.q("SELECT * FROM fwide_m", T, WIDE_CTE))
def a23_fuel_pivot_model(spark, sf_dir):
    src = sources(spark, sf_dir)
    return FU.pivot_breakdown(FU.fuel_by_model(src.fuel, src.vehicles), [P.MERK, P.HANDELSBENAMING])


def brand_segments_with_fuel(spark, sf_dir):
    src = sources(spark, sf_dir)
    seg = segments.brand_segments(fact_of(src), T.brand)
    wide = FU.pivot_breakdown(FU.fuel_by_brand(FU.fuel_by_model(src.fuel, src.vehicles)), [P.MERK])
    return FU.attach_breakdown(seg, wide, [P.MERK])


def model_segments_with_fuel(spark, sf_dir):
    src = sources(spark, sf_dir)
    seg = segments.model_segments(fact_of(src), T.model)
    wide = FU.pivot_breakdown(FU.fuel_by_model(src.fuel, src.vehicles), [P.MERK, P.HANDELSBENAMING])
    return FU.attach_breakdown(seg, wide, [P.MERK, P.HANDELSBENAMING])


@register("j8_segments_with_fuel", lambda: O.q(O.six("bsegf"), T, SEG_FUEL_CTE))
def j8_segments_with_fuel(spark, sf_dir):
    return six_digits(brand_segments_with_fuel(spark, sf_dir))


@register("j8_model_segments_with_fuel", lambda: O.q(O.six("msegf"), T, SEG_FUEL_CTE))
def j8_model_segments_with_fuel(spark, sf_dir):
    return six_digits(model_segments_with_fuel(spark, sf_dir))


@register("a35_fuel_view", lambda: O.q(fuel_view_sql(FUEL_VIEW, "bsegf"), T, SEG_FUEL_CTE))
def a35_fuel_view(spark, sf_dir):
    return X.fuel_view(brand_segments_with_fuel(spark, sf_dir), FUEL_VIEW)


@register("a35_fuel_view_models", lambda: O.q(fuel_view_sql(FUEL_VIEW_MODELS, "msegf"), T, SEG_FUEL_CTE))
def a35_fuel_view_models(spark, sf_dir):
    return X.fuel_view(model_segments_with_fuel(spark, sf_dir), FUEL_VIEW_MODELS)


@register("t8_fuel_view_sort", lambda: O.q(
    "SELECT *, CAST(row_number() OVER (ORDER BY diesel_pct DESC, merk ASC) AS INTEGER) AS position FROM ("
    + fuel_view_sql(FUEL_VIEW, "bsegf") + ")",
    T, SEG_FUEL_CTE))
def t8_fuel_view_sort(spark, sf_dir):
    """The whole fuel view sorted by a percent column."""
    v = X.fuel_view(brand_segments_with_fuel(spark, sf_dir), FUEL_VIEW)
    return positions(X.fuel_view_sort(v, "diesel_pct", ascending=False))
