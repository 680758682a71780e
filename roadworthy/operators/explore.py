"""Filtered re-aggregation of published segments (the exploration tier).

The original recomputes these in the browser from the published documents;
here each view is a DataFrame job over the segment tables (A20, A27-A42,
J9, P22-P31, P40, P41, T5-T10).  Segment tables are small relative to the
fact (one row per brand/model x type x fuel), and every step is a filter,
a grouped sum or a per-key join, so nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions.normalize import rnd
from roadworthy.operators import fuel as FU

INF = math.inf


@dataclass(frozen=True)
class ViewFilter:
    """Filter state of the statistics and fuel views (defaults = no filter)."""

    view: str = "brands"  # "brands" or "models"
    show_consumer: bool = True
    show_commercial: bool = True
    fuels: tuple[str, ...] = ()  # empty = all
    brands: tuple[str, ...] = ()  # empty = all
    min_price: float = 0.0
    max_price: float = INF
    max_price_available: float = INF  # max applies only when below this
    search: str = ""
    age_range: tuple[int, int] | None = None  # None = inactive (D9)
    min_fleet: int = 0
    max_fleet: float = INF
    min_inspections: int = 0
    max_inspections: float = INF
    max_inspections_available: float = INF

    @property
    def keys(self) -> list[str]:
        return [P.MERK] if self.view == "brands" else [P.MERK, P.HANDELSBENAMING]


# -- row predicates (P22-P26) ------------------------------------------------

def usage_predicate(f: ViewFilter) -> Column:
    """consumer/commercial toggles."""
    g = F.col("vehicle_type_group")
    return (F.lit(f.show_consumer) & (g == P.GROUP_CONSUMER)) | (F.lit(f.show_commercial) & (g == P.GROUP_COMMERCIAL))


def membership(c: Column, values: Sequence[str]) -> Column:
    """Empty selection means everything."""
    return c.isin(*values) if values else F.lit(True)


def avg_price_col() -> Column:
    """P24 / A31 helper: average catalogue price of a segment, 0 if unknown."""
    return F.coalesce(F.try_divide(F.col("sum_catalog_price"), F.col("count_with_price")), F.lit(0.0))


def open_range(c: Column, lo: float, hi: float, hi_available: float) -> Column:
    """Lower bound always; upper bound only when it is below the available max."""
    cond = c >= F.lit(lo)
    if hi < hi_available:
        cond = cond & (c <= F.lit(hi))
    return cond


def price_predicate(f: ViewFilter) -> Column:
    """P24."""
    return open_range(avg_price_col(), f.min_price, f.max_price, f.max_price_available)


def search_predicate(q: str, view: str) -> Column:
    """Case-insensitive substring on brand (and model in the model view)."""
    if not q:
        return F.lit(True)
    q = q.lower()
    hit = F.lower(F.col(P.MERK)).contains(q)
    if view == "models":
        hit = hit | F.coalesce(F.lower(F.col(P.HANDELSBENAMING)).contains(q), F.lit(False))
    return hit


def multi_term_search(cols: Sequence[str], text: str) -> Column:
    """Every space-separated term occurs in one of the string columns."""
    terms = [t for t in text.lower().split(" ") if t]
    if not terms:
        return F.lit(True)
    cond = F.lit(True)
    for t in terms:
        any_col = F.lit(False)
        for c in cols:
            any_col = any_col | F.coalesce(F.lower(F.col(c).cast("string")).contains(t), F.lit(False))
        cond = cond & any_col
    return cond


def brand_selection(df: DataFrame, brands: Sequence[str]) -> DataFrame:
    """P23 for brands: a literal IN list of the user's selection, whatever its length."""
    return df.where(membership(F.col(P.MERK), brands))


def row_filter(segments: DataFrame, f: ViewFilter) -> DataFrame:
    kept = segments.where(usage_predicate(f) & membership(F.col("primary_fuel"), f.fuels) & price_predicate(f))
    return brand_selection(kept, f.brands)


# -- merge (A27, A28, A30, A31) ---------------------------------------------

def merge_segments(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge filtered segments per view key from their moments."""
    has_found = "inspections_with_defects" in segments.columns
    aggs = [
        F.count(F.lit(1)).alias("n_segments"),
        F.sum("vehicle_count").alias("vehicle_count"),
        F.sum("total_inspections").alias("total_inspections"),
        F.sum("total_defects").alias("total_defects"),
        F.sum("total_vehicle_years").alias("total_vehicle_years"),
        F.sum("sum_defects_per_vehicle_year_rates").alias("sum_defects_per_vehicle_year_rates"),
        F.sum("sum_sq_defects_per_vehicle_year_rates").alias("sum_sq_defects_per_vehicle_year_rates"),
        F.sum("sum_sq_defect_counts").alias("sum_sq_defect_counts"),
        F.sum("sum_catalog_price").alias("sum_catalog_price"),
        F.sum("count_with_price").alias("count_with_price"),
    ]
    if has_found:
        aggs.append(F.sum("inspections_with_defects").alias("inspections_with_defects"))
    # Σ age: its own column under the coverage exposure, else the vehicle-years
    age_sum = "sum_age_years" if "sum_age_years" in segments.columns else "total_vehicle_years"
    aggs.append(F.sum(age_sum).alias("_age_sum"))
    return segments.groupBy(*keys).agg(*aggs)


def pooled_std(merged: DataFrame) -> DataFrame:
    """A30 + A31: standard deviations from moments and the average price."""
    n = F.col("total_inspections")
    sx, sx2 = F.col("sum_defects_per_vehicle_year_rates"), F.col("sum_sq_defects_per_vehicle_year_rates")
    mean = sx / n
    pop = F.sqrt(F.greatest(F.lit(0.0), sx2 / n - mean * mean))
    d, d2 = F.col("total_defects"), F.col("sum_sq_defect_counts")
    samp = F.sqrt(F.greatest(F.lit(0.0), (d2 - d * d / n) / (n - 1)))
    return (
        merged.withColumn("std_defects_per_vehicle_year",
                          F.when((n > 1) & sx.isNotNull() & sx2.isNotNull(), rnd(pop, 6)))
        .withColumn("std_defects_per_inspection", F.when((n > 1) & d2.isNotNull(), rnd(samp, 6)))
        .withColumn("avg_catalog_price",
                    F.when(F.col("count_with_price") > 0,
                           rnd(F.col("sum_catalog_price") / F.col("count_with_price"), 6)))
    )


def merge_per_age(per_age_rows: DataFrame, segments_kept: DataFrame, keys: Sequence[str],
                  seg_keys: Sequence[str]) -> DataFrame:
    """Per-age rows of the kept segments summed per view key and age."""
    kept = segments_kept.select(*seg_keys).distinct()
    return (
        per_age_rows.join(kept, list(seg_keys), "left_semi")
        .groupBy(*keys, "age_at_inspection")
        .agg(
            F.sum("vehicle_count").alias("vehicle_count"),
            F.sum("total_inspections").alias("total_inspections"),
            F.sum("total_defects").alias("total_defects"),
        )
    )


def age_window(per_age_merged: DataFrame, keys: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Sums over ages lo..hi; keys without inspections there are absent.

    ``vehicle_count`` counts a vehicle once per age it was seen at (D12)."""
    w = per_age_merged.where(F.col("age_at_inspection").between(lo, hi))
    agg = w.groupBy(*keys).agg(
        F.sum("vehicle_count").alias("vehicle_count"),
        F.sum("total_inspections").alias("total_inspections"),
        F.sum("total_defects").alias("total_defects"),
        F.sum(F.col("age_at_inspection") * F.col("vehicle_count")).alias("_age_w"),
    ).where(F.col("total_inspections") > 0)
    return agg.select(
        *keys, "vehicle_count", "total_inspections", "total_defects",
        rnd(F.col("total_defects") / F.col("total_inspections"), 4).alias("avg_defects_per_inspection"),
        F.when(F.col("vehicle_count") > 0,
               F.floor(F.col("_age_w") / F.col("vehicle_count") * 10 + 0.5) / 10).otherwise(F.lit(0.0))
        .alias("avg_age_years"),
    )


# -- the statistics view (A33, A34, J9, T7) -----------------------------------

def explore_segments(segments: DataFrame, f: ViewFilter, per_age_rows: DataFrame | None = None,
                     ratios: DataFrame | None = None) -> DataFrame:
    """Filtered, merged and re-rated segments of one view.

    ``segments`` are brand segments for ``view="brands"``, model segments for
    ``"models"``; ``per_age_rows`` the matching per-age long rows (needed when
    ``age_range`` is set); ``ratios`` the per-key counts of A32 (missing key or
    no defects -> all included, no table -> mode ``all``).
    """
    keys = f.keys
    seg_keys = list(P.BRAND_KEYS) if f.view == "brands" else list(P.MODEL_KEYS)
    kept = row_filter(segments, f)
    merged = pooled_std(merge_segments(kept, keys))
    merged = merged.withColumn("_exact_age", rnd(F.col("_age_sum") / F.col("total_inspections"), 2))
    if ratios is not None:
        merged = merged.join(ratios.select(*keys, "included_count", "total_count"), keys, "left")
    active = f.age_range is not None
    if active:
        if per_age_rows is None:
            raise ValueError("age_range needs per_age_rows")
        win = age_window(merge_per_age(per_age_rows, kept, keys, seg_keys), keys, *f.age_range)
        win = win.select(*keys, *[F.col(c).alias("w_" + c) for c in
                                   ("vehicle_count", "total_inspections", "total_defects", "avg_age_years")])
        merged = merged.join(win, keys, "left")
        final_defects = F.coalesce(F.col("w_total_defects"), F.lit(0.0))
        final_insp = F.coalesce(F.col("w_total_inspections"), F.lit(0).cast("bigint"))
        denominator = final_insp.cast("double")
        vehicles = F.coalesce(F.col("w_vehicle_count"), F.lit(0).cast("bigint"))
        age = F.col("w_avg_age_years")
    else:
        final_defects = F.col("total_defects")
        final_insp = F.col("total_inspections")
        denominator = F.col("total_vehicle_years")
        vehicles = F.col("vehicle_count")
        age = F.col("_exact_age")
    filtered = final_defects
    if ratios is not None:  # multiply first, divide once
        some = F.col("total_count") > 0
        filtered = F.when(some, final_defects * F.col("included_count") / F.col("total_count")).otherwise(final_defects)
    rate = F.when(denominator > 0, filtered / denominator)
    out = merged.select(
        *keys,
        vehicles.alias("vehicle_count"),
        final_insp.alias("total_inspections"),
        F.col("total_defects"),
        rnd(F.col("total_vehicle_years"), 4).alias("total_vehicle_years"),
        rnd(F.coalesce(F.try_divide(F.col("total_defects"), F.col("total_inspections")), F.lit(0.0)), 6)
        .alias("avg_defects_per_inspection"),
        rnd(F.coalesce(F.try_divide(F.col("total_defects"), F.col("total_vehicle_years")), F.lit(0.0)), 6)
        .alias("defects_per_vehicle_year"),
        "std_defects_per_vehicle_year",
        "std_defects_per_inspection",
        "avg_catalog_price",
        F.floor(filtered + 0.5).cast("bigint").alias("filtered_defects"),
        rnd(rate, 6).alias("filtered_defects_per_vehicle_year"),
        age.alias("avg_age_years"),
        F.lit("inspection" if active else "vehicle_year").alias("rate_basis"),
    )
    having = (
        (F.col("vehicle_count") >= f.min_fleet)
        & (F.col("vehicle_count") <= F.lit(f.max_fleet))
        & open_range(F.col("total_inspections"), f.min_inspections, f.max_inspections, f.max_inspections_available)
        & F.col("filtered_defects_per_vehicle_year").isNotNull()
        & search_predicate(f.search, f.view)
    )
    return out.where(having)


def sort_by_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ascending filtered rate, null as 0, key as tie-break."""
    return df.orderBy(F.coalesce(F.col("filtered_defects_per_vehicle_year"), F.lit(0.0)), *keys)


# -- table helpers (P40, P41, T5, T6, T10) ------------------------------------

def view_columns(view: str, show_std: bool = False, show_price: bool = False) -> list[str]:
    """Columns of the statistics table per view."""
    cols = [P.MERK] + ([P.HANDELSBENAMING] if view == "models" else [])
    cols += ["vehicle_count", "total_inspections", "avg_defects_per_inspection", "filtered_defects_per_vehicle_year",
             "avg_age_years"]
    if show_std:
        cols += ["std_defects_per_inspection", "std_defects_per_vehicle_year"]
    if show_price and view == "models":
        cols += ["avg_catalog_price"]
    return cols


def default_age_window(bounds: DataFrame) -> DataFrame:
    """Default age window 4..30 clamped to the available range."""
    lo, hi = P.DEFAULT_AGE_WINDOW
    return bounds.select(
        F.greatest(F.lit(lo), F.col("min_age")).alias("age_from"),
        F.least(F.lit(hi), F.col("max_age")).alias("age_to"),
    )


def table_sort(df: DataFrame, column: str, ascending: bool, tiebreak: Sequence[str]) -> DataFrame:
    """T5: nulls last when ascending, first when descending; unique tie-break."""
    o = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_first()
    return df.orderBy(o, *[F.col(c).asc_nulls_first() for c in tiebreak])


def page(df: DataFrame, column: str, ascending: bool, tiebreak: Sequence[str], page_no: int = 1,
         page_size: int = P.PAGE_SIZE) -> DataFrame:
    """One page of a sorted table (1-based page number)."""
    return table_sort(df, column, ascending, tiebreak).offset((page_no - 1) * page_size).limit(page_size)


def total_pages(df: DataFrame, page_size: int = P.PAGE_SIZE) -> DataFrame:
    """Number of pages (at least 1)."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / page_size)).cast("bigint").alias("total_pages"))


# -- brand list (A20, P30) ----------------------------------------------------

def brand_popularity(brand_segments: DataFrame) -> DataFrame:
    """Vehicles per brand over its segments, most first."""
    by = brand_segments.groupBy(P.MERK).agg(F.sum("vehicle_count").alias("vehicle_count"))
    return by.orderBy(F.col("vehicle_count").desc(), P.MERK)


def brand_search(popularity: DataFrame, q: str) -> DataFrame:
    """Brands whose name contains the query (case-insensitive)."""
    return popularity.where(F.lower(F.col(P.MERK)).contains(q.lower())) if q else popularity


# -- dashboard (A36-A42) ------------------------------------------------------

def totals(brand_segments: DataFrame) -> DataFrame:
    """Vehicles, inspections, defects and vehicle-years over all segments."""
    return brand_segments.agg(
        F.sum("vehicle_count").alias("vehicles"),
        F.sum("total_inspections").alias("inspections"),
        F.sum("total_defects").alias("defects"),
        rnd(F.sum("total_vehicle_years"), 4).alias("vehicle_years"),
    )


def fuel_shares(brand_segments: DataFrame) -> DataFrame:
    """Vehicles per primary fuel and share of all vehicles, most first.

    One row per fuel class (at most six), so the global window is tiny."""
    by = brand_segments.groupBy("primary_fuel").agg(F.sum("vehicle_count").alias("count"))
    tot = F.sum("count").over(Window.partitionBy())
    out = by.withColumn("share", F.when(tot > 0, rnd(F.col("count") / tot, 6)).otherwise(F.lit(0.0)))
    return out.withColumnRenamed("primary_fuel", "fuel").orderBy(F.col("count").desc(), "fuel")


def top_brands(brand_segments: DataFrame, k: int = P.TOP_BRANDS_CHART) -> DataFrame:
    """The k brands with most vehicles (and at least one inspection)."""
    b = brand_segments.groupBy(P.MERK).agg(
        F.sum("vehicle_count").alias("vehicle_count"),
        F.sum("total_inspections").alias("total_inspections"),
        F.sum("total_defects").alias("total_defects"),
        F.sum(F.coalesce(F.col("inspections_with_defects"), F.lit(0))).alias("inspections_with_defects"),
    ).where(F.col("total_inspections") > 0)
    return b.orderBy(F.col("vehicle_count").desc(), F.col(P.MERK).asc()).limit(k)


def top_brand_averages(brand_segments: DataFrame, k: int = P.TOP_BRANDS_CHART) -> DataFrame:
    """Defects per inspection of the k biggest brands, highest first."""
    return top_brands(brand_segments, k).select(
        P.MERK, rnd(F.col("total_defects") / F.col("total_inspections"), 6).alias("value"), "vehicle_count"
    ).orderBy(F.col("value").desc(), P.MERK)


def defect_found_rate(brand_segments: DataFrame, k: int = P.TOP_BRANDS_CHART) -> DataFrame:
    """Share of inspections with at least one defect, same brands, highest first."""
    return top_brands(brand_segments, k).select(
        P.MERK, rnd(F.col("inspections_with_defects") / F.col("total_inspections"), 6).alias("value"),
        "vehicle_count",
    ).orderBy(F.col("value").desc(), P.MERK)


def trend_delta(yearly: DataFrame) -> DataFrame:
    """Percent change of the average from the first to the last year
    (null when fewer than two years or the first is 0)."""
    first = F.min_by("avg_defects_per_inspection", "insp_year")
    last = F.max_by("avg_defects_per_inspection", "insp_year")
    return yearly.agg(
        F.when((F.count(F.lit(1)) >= 2) & (first != 0), rnd((last - first) / first * 100, 6)).alias("delta_pct"),
        F.count(F.lit(1)).alias("years"),
    )


def age_peak(fleet_age: DataFrame, lo: int = 2, hi: int = 25) -> DataFrame:
    """Ages lo..hi with a flag on the age(s) with the highest average.

    At most one row per age (<= 101 rows), so the global window is tiny."""
    v = fleet_age.where(F.col("age_at_inspection").between(lo, hi))
    peak = F.max("avg_defects_per_inspection").over(Window.partitionBy())
    return v.select("age_at_inspection", "avg_defects_per_inspection",
                    (F.col("avg_defects_per_inspection") == peak).alias("is_peak"))


# -- fuel view (A35, T8) ------------------------------------------------------

def fuel_view(segments_with_fuel: DataFrame, f: ViewFilter) -> DataFrame:
    """Vehicles and fuel counts per key with petrol / diesel / electric shares.

    Segment rows carry their whole brand's (or model's) fuel columns; the view
    takes one copy per key instead of adding the copies up (D7)."""
    keys = f.keys
    rows = brand_selection(segments_with_fuel.where(
        usage_predicate(f)
        & membership(F.col("primary_fuel"), f.fuels)
        & price_predicate(f)
        & open_range(F.col("total_inspections"), f.min_inspections, f.max_inspections, f.max_inspections_available)
        & search_predicate(f.search, f.view)
    ), f.brands)
    g = rows.groupBy(*keys).agg(
        F.sum("vehicle_count").alias("vehicle_count"), *[F.max(b).alias(b) for b in FU.BUCKETS]
    )
    total = sum((F.col(b) for b in FU.BUCKETS[1:]), F.col(FU.BUCKETS[0]))
    out = g.select(
        *keys, "vehicle_count", *FU.BUCKETS,
        FU.pct(F.col(P.FUEL_PETROL), total).alias("petrol_pct"),
        FU.pct(F.col(P.FUEL_DIESEL), total).alias("diesel_pct"),
        FU.pct(F.col(P.FUEL_ELECTRIC), total).alias("electric_pct"),
    )
    return out.where((F.col("vehicle_count") >= f.min_fleet) & (F.col("vehicle_count") <= F.lit(f.max_fleet)))


def fuel_view_sort(df: DataFrame, sort_key: str = "vehicle_count", ascending: bool = False, locale: str | None = None) -> DataFrame:
    """Sort the fuel view by name (in the order of ``locale``, a collation, if given), vehicles or a percent column."""
    c = F.collate(F.col(sort_key), locale) if locale and sort_key in (P.MERK, P.HANDELSBENAMING) else F.col(sort_key)
    o = c.asc() if ascending else c.desc()
    return df.orderBy(o, F.col(P.MERK).asc())
