"""Registered queries: the exploration tier."""

from __future__ import annotations

from roadworthy import params as P
from roadworthy.operators import defects as D
from roadworthy.operators import explore as X
from roadworthy.operators import profile, rankings, segments
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, fact_of, positions, register, sources
from roadworthy.plans.q_defects import INDEX_CTE, JOINED_CTE, OFF, TOGGLED, excluded_sql
from roadworthy.plans.q_segments import ranking_sql

# View states exercised by the registered queries.
V_BRANDS = X.ViewFilter(view="brands", fuels=("Benzine", "Diesel", "Other"), min_fleet=3)
V_MODELS = X.ViewFilter(view="models", show_commercial=False, min_inspections=5)
V_PRICE = X.ViewFilter(view="brands", min_price=940.0, max_price=960.0, max_price_available=1000.0)
V_SEARCH = X.ViewFilter(view="models", search="red")
V_AGE = X.ViewFilter(view="brands", age_range=(4, 12))
V_AGE_MODELS = X.ViewFilter(view="models", age_range=(5, 15), show_consumer=True, show_commercial=False)
V_HAVING = X.ViewFilter(view="brands", min_fleet=40, max_fleet=60, min_inspections=600, max_inspections=800,
                        max_inspections_available=10_000)
V_BRAND_PICK = X.ViewFilter(view="models", brands=("BRAND#1", "BRAND#12", "BRAND#23"), fuels=("Diesel", "Hybrid"))
MULTI_TERM = "brand#1 red"


def _lit(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def row_where_sql(f: X.ViewFilter) -> str:
    parts = [
        f"(({str(f.show_consumer).lower()} AND vehicle_type_group = 'consumer') OR "
        f"({str(f.show_commercial).lower()} AND vehicle_type_group = 'commercial'))"
    ]
    if f.fuels:
        parts.append(f"primary_fuel IN ({', '.join(_lit(x) for x in f.fuels)})")
    price = "coalesce(sum_catalog_price / nullif(CAST(count_with_price AS DOUBLE), 0), 0.0)"
    parts.append(f"{price} >= {f.min_price}")
    if f.max_price < f.max_price_available:
        parts.append(f"{price} <= {f.max_price}")
    if f.brands:
        parts.append(f"merk IN ({', '.join(_lit(x) for x in f.brands)})")
    return " AND ".join(parts)


def search_sql(f: X.ViewFilter) -> str:
    if not f.search:
        return "true"
    q = f.search.lower().replace("'", "''")
    s = f"contains(lower(merk), '{q}')"
    if f.view == "models":
        s = f"({s} OR coalesce(contains(lower(handelsbenaming), '{q}'), false))"
    return s


def explore_sql(f: X.ViewFilter, seg: str, per_age: str | None = None, ratios: str | None = None) -> str:
    """The statistics view in SQL: extra CTEs (leading comma) + final SELECT."""
    keys = ", ".join(f.keys)
    on = " AND ".join(f"a.{k} = b.{k}" for k in f.keys)
    seg_keys = "merk, vehicle_type_group, primary_fuel" if f.view == "brands" else \
        "merk, handelsbenaming, vehicle_type_group, primary_fuel"
    ctes = f"""
, kept AS (SELECT * FROM {seg} WHERE {row_where_sql(f)}),
merged AS (
  SELECT {keys}, {O.SUMI('vehicle_count')} AS vc, {O.SUMI('total_inspections')} AS ti, sum(total_defects) AS td,
         sum(total_vehicle_years) AS tvy, sum(sum_defects_per_vehicle_year_rates) AS sx,
         sum(sum_sq_defects_per_vehicle_year_rates) AS sx2, sum(sum_sq_defect_counts) AS d2,
         sum(sum_catalog_price) AS sp, {O.SUMI('count_with_price')} AS cwp
  FROM kept GROUP BY {keys})"""
    active = f.age_range is not None
    if active:
        lo, hi = f.age_range
        semi = " AND ".join(f"k.{c} = p.{c}" for c in seg_keys.split(", "))
        ctes += f"""
, pam AS (
  SELECT {keys}, age_at_inspection, {O.SUMI('vehicle_count')} AS vc, {O.SUMI('total_inspections')} AS ti,
         sum(total_defects) AS td
  FROM {per_age} p WHERE EXISTS (SELECT 1 FROM kept k WHERE {semi})
  GROUP BY {keys}, age_at_inspection),
win AS (
  SELECT {keys}, {O.SUMI('vc')} AS w_vc, {O.SUMI('ti')} AS w_ti, sum(td) AS w_td, sum(age_at_inspection * vc) AS aw
  FROM pam WHERE age_at_inspection BETWEEN {lo} AND {hi} GROUP BY {keys} HAVING sum(ti) > 0)"""
        src = f"merged a LEFT JOIN win b ON {on}"
        fd, fi = "coalesce(b.w_td, 0.0)", "coalesce(b.w_ti, CAST(0 AS BIGINT))"
        den, veh = f"CAST({fi} AS DOUBLE)", "coalesce(b.w_vc, CAST(0 AS BIGINT))"
        age = "CASE WHEN b.w_vc IS NULL THEN NULL WHEN b.w_vc > 0 THEN floor(b.aw / b.w_vc * 10 + 0.5) / 10 ELSE 0.0 END"
    else:
        src = "merged a"
        fd, fi, den, veh = "a.td", "a.ti", "a.tvy", "a.vc"
        age = O.R("a.tvy / a.ti", 2)
    if ratios:
        on_r = " AND ".join(f"a.{k} = r.{k}" for k in f.keys)
        src += f" LEFT JOIN {ratios} r ON {on_r}"
    filt = (f"(CASE WHEN r.total_count > 0 THEN ({fd}) * r.included_count / r.total_count ELSE ({fd}) END)"
            if ratios else f"({fd})")
    key_sel = ", ".join(f"a.{k}" for k in f.keys)
    maxf = "" if f.max_fleet == X.INF else f" AND vehicle_count <= {f.max_fleet}"
    maxi = (f" AND total_inspections <= {f.max_inspections}"
            if f.max_inspections < f.max_inspections_available else "")
    body = f"""
SELECT * FROM (
  SELECT {key_sel}, {veh} AS vehicle_count, {fi} AS total_inspections, a.td AS total_defects,
         {O.R('a.tvy', 4)} AS total_vehicle_years,
         {O.R('coalesce(a.td / nullif(CAST(a.ti AS DOUBLE), 0), 0.0)', 6)} AS avg_defects_per_inspection,
         {O.R('coalesce(a.td / nullif(a.tvy, 0), 0.0)', 6)} AS defects_per_vehicle_year,
         CASE WHEN a.ti > 1 AND a.sx IS NOT NULL AND a.sx2 IS NOT NULL
              THEN {O.R('sqrt(greatest(0.0, a.sx2 / a.ti - (a.sx / a.ti) * (a.sx / a.ti)))', 6)} END
           AS std_defects_per_vehicle_year,
         CASE WHEN a.ti > 1 AND a.d2 IS NOT NULL
              THEN {O.R('sqrt(greatest(0.0, (a.d2 - a.td * a.td / a.ti) / (a.ti - 1)))', 6)} END
           AS std_defects_per_inspection,
         CASE WHEN a.cwp > 0 THEN {O.R('a.sp / a.cwp', 6)} END AS avg_catalog_price,
         CAST(floor({filt} + 0.5) AS BIGINT) AS filtered_defects,
         CASE WHEN {den} > 0 THEN {O.R(f'{filt} / {den}', 6)} END AS filtered_defects_per_vehicle_year,
         {age} AS avg_age_years,
         '{'inspection' if active else 'vehicle_year'}' AS rate_basis
  FROM {src})
WHERE vehicle_count >= {f.min_fleet}{maxf} AND total_inspections >= {f.min_inspections}{maxi}
  AND filtered_defects_per_vehicle_year IS NOT NULL AND {search_sql(f)}"""
    return ctes + body


def _split(sql: str) -> tuple[str, str]:
    i = sql.rindex("\nSELECT * FROM (")
    return sql[:i], sql[i:]


def Q(f: X.ViewFilter, seg: str, per_age: str | None = None, ratios: str | None = None, pre: str = "",
      off: int = 0, wrap: str = "{}") -> str:
    ctes, body = _split(explore_sql(f, seg, per_age, ratios))
    return O.q(wrap.format(body), T, pre + ctes, off)


PER_AGE_CTES = f"""
, bpa AS (
  SELECT merk, vehicle_type_group, primary_fuel, age_at_inspection, count(DISTINCT kenteken) AS vehicle_count,
         count(*) AS total_inspections, CAST(sum(defect_count) AS DOUBLE) AS total_defects
  FROM fact GROUP BY ALL HAVING count(DISTINCT kenteken) >= {T.age_bracket}),
mpa AS (
  SELECT merk, handelsbenaming, vehicle_type_group, primary_fuel, age_at_inspection,
         count(DISTINCT kenteken) AS vehicle_count, count(*) AS total_inspections,
         CAST(sum(defect_count) AS DOUBLE) AS total_defects
  FROM fact GROUP BY ALL HAVING count(DISTINCT kenteken) >= {T.age_bracket})"""

RATIO_CTES = JOINED_CTE + INDEX_CTE + excluded_sql() + f"""
, ratios_b AS (
  SELECT merk, CAST(sum("count") AS DOUBLE) AS total_count,
         CAST(sum(CASE WHEN e.defect_code IS NULL THEN "count" ELSE 0 END) AS DOUBLE) AS included_count
  FROM bbd b LEFT JOIN excl e ON b.defect_code = e.defect_code GROUP BY merk),
ratios_m AS (
  SELECT merk, handelsbenaming,
         CAST(sum("count") AS DOUBLE) AS total_count,
         CAST(sum(CASE WHEN e.defect_code IS NULL THEN "count" ELSE 0 END) AS DOUBLE) AS included_count
  FROM mbd b LEFT JOIN excl e ON b.defect_code = e.defect_code GROUP BY merk, handelsbenaming)"""


def _fact_segs(spark, sf_dir, off: int = 0):
    src = sources(spark, sf_dir, off)
    fact = fact_of(src)
    return src, fact, segments.brand_segments(fact, T.brand), segments.model_segments(fact, T.model)


def _view(spark, sf_dir, f: X.ViewFilter, with_ratios: bool = False):
    src, fact, b, m = _fact_segs(spark, sf_dir, OFF if with_ratios else 0)
    seg = b if f.view == "brands" else m
    keys = list(P.BRAND_KEYS) if f.view == "brands" else list(P.MODEL_KEYS)
    pa = segments.per_age(fact, keys, T.age_bracket) if f.age_range else None
    ratios = None
    if with_ratios:
        bd = D.breakdown(D.defects_with_vehicle(src.defects, fact), f.keys)
        ex = D.excluded_codes(D.code_index(src.codes), "reliability", toggled=TOGGLED)
        ratios = D.filtered_ratio(bd, f.keys, ex, "reliability")
    return X.explore_segments(seg, f, pa, ratios)


@register("a27_view_brands", lambda: Q(V_BRANDS, "bseg"))
def a27_view_brands(spark, sf_dir):
    return _view(spark, sf_dir, V_BRANDS)


@register("a27_view_models", lambda: Q(V_MODELS, "mseg"))
def a27_view_models(spark, sf_dir):
    return _view(spark, sf_dir, V_MODELS)


@register("p24_price_filter", lambda: Q(V_PRICE, "bseg"))
def p24_price_filter(spark, sf_dir):
    return _view(spark, sf_dir, V_PRICE)


@register("p23_brand_selection", lambda: Q(V_BRAND_PICK, "mseg"))
def p23_brand_selection(spark, sf_dir):
    """Fuel and brand selections (empty selection = everything)."""
    return _view(spark, sf_dir, V_BRAND_PICK)


@register("p26_search", lambda: Q(V_SEARCH, "mseg"))
def p26_search(spark, sf_dir):
    return _view(spark, sf_dir, V_SEARCH)


@register("a34_view_ranges", lambda: Q(V_HAVING, "bseg"))
def a34_view_ranges(spark, sf_dir):
    return _view(spark, sf_dir, V_HAVING)


@register("a29_age_window", lambda: Q(V_AGE, "bseg", "bpa", pre=PER_AGE_CTES))
def a29_age_window(spark, sf_dir):
    return _view(spark, sf_dir, V_AGE)


@register("a33_filtered_rate", lambda: Q(V_AGE_MODELS, "mseg", "mpa", "ratios_m", pre=PER_AGE_CTES + RATIO_CTES,
                                         off=OFF))
def a33_filtered_rate(spark, sf_dir):
    return _view(spark, sf_dir, V_AGE_MODELS, with_ratios=True)


@register("j9_segments_with_ratio", lambda: Q(V_BRANDS, "bseg", None, "ratios_b", pre=RATIO_CTES, off=OFF))
def j9_segments_with_ratio(spark, sf_dir):
    return _view(spark, sf_dir, V_BRANDS, with_ratios=True)


@register("a28_per_age_merge", lambda: O.q("""
SELECT merk, age_at_inspection, CAST(sum(vehicle_count) AS BIGINT) AS vehicle_count,
       CAST(sum(total_inspections) AS BIGINT) AS total_inspections, sum(total_defects) AS total_defects
FROM bpa p WHERE EXISTS (SELECT 1 FROM bseg k WHERE k.merk = p.merk AND k.vehicle_type_group = p.vehicle_type_group
                         AND k.primary_fuel = p.primary_fuel AND k.vehicle_type_group = 'consumer')
GROUP BY merk, age_at_inspection""", T, PER_AGE_CTES))
def a28_per_age_merge(spark, sf_dir):
    _, fact, b, _m = _fact_segs(spark, sf_dir)
    kept = X.row_filter(b, X.ViewFilter(show_commercial=False))
    return X.merge_per_age(segments.per_age(fact, P.BRAND_KEYS, T.age_bracket), kept, [P.MERK], P.BRAND_KEYS)


@register("a30_pooled_std", lambda: Q(V_MODELS, "mseg", wrap=(
    "SELECT merk, handelsbenaming, total_inspections, std_defects_per_vehicle_year, std_defects_per_inspection "
    "FROM ({})")))
def a30_pooled_std(spark, sf_dir):
    return _view(spark, sf_dir, V_MODELS).select(
        P.MERK, P.HANDELSBENAMING, "total_inspections", "std_defects_per_vehicle_year", "std_defects_per_inspection"
    )


@register("p40_view_columns", lambda: Q(V_MODELS, "mseg", wrap=(
    "SELECT " + ", ".join(X.view_columns("models", True, True)) + " FROM ({})")))
def p40_view_columns(spark, sf_dir):
    return _view(spark, sf_dir, V_MODELS).select(*X.view_columns("models", True, True))


@register("p28_multi_term_search", lambda: Q(V_MODELS, "mseg", wrap=(
    "SELECT * FROM ({}) WHERE " + " AND ".join(
        f"(coalesce(contains(lower(merk), '{t}'), false) OR coalesce(contains(lower(handelsbenaming), '{t}'), false))"
        for t in MULTI_TERM.split()))))
def p28_multi_term_search(spark, sf_dir):
    v = _view(spark, sf_dir, V_MODELS)
    return v.where(X.multi_term_search([P.MERK, P.HANDELSBENAMING], MULTI_TERM))


@register("t6_page", lambda: Q(V_MODELS, "mseg", wrap=(
    "SELECT * FROM ({}) ORDER BY vehicle_count DESC NULLS FIRST, merk ASC NULLS FIRST, "
    "handelsbenaming ASC NULLS FIRST LIMIT 50 OFFSET 50")))
def t6_page(spark, sf_dir):
    return X.page(_view(spark, sf_dir, V_MODELS), "vehicle_count", False, [P.MERK, P.HANDELSBENAMING], 2)


@register("t6_total_pages", lambda: Q(V_MODELS, "mseg", wrap=(
    "SELECT CAST(greatest(1, ceil(count(*) / 50)) AS BIGINT) AS total_pages FROM ({})")))
def t6_total_pages(spark, sf_dir):
    return X.total_pages(_view(spark, sf_dir, V_MODELS))


@register("t5_table_sort", lambda: Q(V_BRANDS, "bseg", wrap=(
    "SELECT *, CAST(row_number() OVER (ORDER BY std_defects_per_inspection ASC NULLS LAST, merk ASC NULLS FIRST) AS INTEGER) "
    "AS position FROM ({})")))
def t5_table_sort(spark, sf_dir):
    """T5: the whole view sorted by a column (nulls last ascending)."""
    return positions(X.table_sort(_view(spark, sf_dir, V_BRANDS), "std_defects_per_inspection", True, [P.MERK]))


@register("t5_table_sort_descending", lambda: Q(V_MODELS, "mseg", wrap=(
    "SELECT merk, handelsbenaming, std_defects_per_inspection, CAST(row_number() OVER (ORDER BY std_defects_per_inspection DESC NULLS FIRST, "
    "merk ASC NULLS FIRST, handelsbenaming ASC NULLS FIRST) AS INTEGER) AS position FROM ({})")))
def t5_table_sort_descending(spark, sf_dir):
    """T5: nulls first when descending."""
    v = X.table_sort(_view(spark, sf_dir, V_MODELS), "std_defects_per_inspection", False, [P.MERK, P.HANDELSBENAMING])
    return positions(v.select(P.MERK, P.HANDELSBENAMING, "std_defects_per_inspection"))


@register("t10_display_cut", lambda: Q(V_MODELS, "mseg", wrap=(
    "SELECT * FROM ({}) ORDER BY coalesce(filtered_defects_per_vehicle_year, 0.0), merk, handelsbenaming LIMIT 10")))
def t10_display_cut(spark, sf_dir):
    """T7 + T10: the view sorted by rate, first 10 rows shown."""
    return X.sort_by_rate(_view(spark, sf_dir, V_MODELS), [P.MERK, P.HANDELSBENAMING]).limit(10)


@register("p41_default_age_window", lambda: O.q("""
SELECT greatest(4, coalesce(min(age_at_inspection), 0)) AS age_from,
       least(30, coalesce(max(age_at_inspection), 0)) AS age_to FROM fact""", T))
def p41_default_age_window(spark, sf_dir):
    return X.default_age_window(segments.age_bounds(fact_of(sources(spark, sf_dir))))


@register("a20_brand_popularity", lambda: O.q(
    f"SELECT *, CAST(row_number() OVER (ORDER BY vehicle_count DESC, merk) AS INTEGER) AS position FROM ("
    f"SELECT merk, {O.SUMI('vehicle_count')} AS vehicle_count FROM bseg GROUP BY merk)", T))
def a20_brand_popularity(spark, sf_dir):
    return positions(X.brand_popularity(_fact_segs(spark, sf_dir)[2]))


@register("p30_brand_search", lambda: O.q(
    f"SELECT merk, {O.SUMI('vehicle_count')} AS vehicle_count FROM bseg WHERE contains(lower(merk), '#1') "
    "GROUP BY merk", T))
def p30_brand_search(spark, sf_dir):
    return X.brand_search(X.brand_popularity(_fact_segs(spark, sf_dir)[2]), "#1")


@register("a36_totals", lambda: O.q(f"""
SELECT {O.SUMI('vehicle_count')} AS vehicles, {O.SUMI('total_inspections')} AS inspections,
       sum(total_defects) AS defects, {O.R('sum(total_vehicle_years)', 4)} AS vehicle_years FROM bseg""", T))
def a36_totals(spark, sf_dir):
    return X.totals(_fact_segs(spark, sf_dir)[2])


@register("a37_fuel_shares", lambda: O.q(f"""
SELECT *, CAST(row_number() OVER (ORDER BY "count" DESC, fuel) AS INTEGER) AS position FROM (
SELECT primary_fuel AS fuel, {O.SUMI('vehicle_count')} AS "count",
       CASE WHEN sum(sum(vehicle_count)) OVER () > 0
            THEN {O.R('sum(vehicle_count) / sum(sum(vehicle_count)) OVER ()', 6)} ELSE 0.0 END AS share
FROM bseg GROUP BY primary_fuel)""", T))
def a37_fuel_shares(spark, sf_dir):
    return positions(X.fuel_shares(_fact_segs(spark, sf_dir)[2]))


TOP_BRANDS_CTE = f"""
, tb AS (
  SELECT merk, {O.SUMI('vehicle_count')} AS vehicle_count, {O.SUMI('total_inspections')} AS total_inspections,
         sum(total_defects) AS total_defects, {O.SUMI('coalesce(inspections_with_defects, 0)')} AS iwd
  FROM bseg GROUP BY merk HAVING sum(total_inspections) > 0
  ORDER BY vehicle_count DESC, merk ASC LIMIT {P.TOP_BRANDS_CHART})"""


@register("a38_top_brand_average", lambda: O.q(
    f"SELECT *, CAST(row_number() OVER (ORDER BY value DESC, merk) AS INTEGER) AS position FROM ("
    f"SELECT merk, {O.R('total_defects / total_inspections', 6)} AS value, vehicle_count FROM tb)", T, TOP_BRANDS_CTE))
def a38_top_brand_average(spark, sf_dir):
    return positions(X.top_brand_averages(_fact_segs(spark, sf_dir)[2]))


@register("a39_defect_found_rate", lambda: O.q(
    f"SELECT *, CAST(row_number() OVER (ORDER BY value DESC, merk) AS INTEGER) AS position FROM ("
    f"SELECT merk, {O.R('iwd / total_inspections', 6)} AS value, vehicle_count FROM tb)", T, TOP_BRANDS_CTE))
def a39_defect_found_rate(spark, sf_dir):
    return positions(X.defect_found_rate(_fact_segs(spark, sf_dir)[2]))


@register("a40_spread", lambda: O.q(f"""
SELECT CASE WHEN b > 0 AND w > 0 THEN {O.R('w / b', 6)} END AS reliability_ratio
FROM (SELECT max(CASE WHEN ranking LIKE 'most%' THEN defects_per_vehicle_year END) AS b,
             max(CASE WHEN ranking LIKE 'least%' THEN defects_per_vehicle_year END) AS w
      FROM ranked WHERE rank = 1)""", T, ranking_sql("bseg", "merk", T.brand_ranking)))
def a40_spread(spark, sf_dir):
    b = _fact_segs(spark, sf_dir)[2]
    return rankings.best_worst_spread(rankings.brand_ranking(b, T.brand_ranking, T.ranking_size))


YEARLY_CTE = f"""
, yt AS (
  SELECT insp_year, count(*) AS inspections, {O.R('sum(defect_count) / count(*)', 4)} AS avg_defects_per_inspection
  FROM fact GROUP BY insp_year HAVING count(*) >= {T.yearly_trend})"""


@register("a41_trend_delta", lambda: O.q(f"""
SELECT CASE WHEN count(*) >= 2 AND min_by(avg_defects_per_inspection, insp_year) <> 0
            THEN {O.R('(max_by(avg_defects_per_inspection, insp_year) - min_by(avg_defects_per_inspection, insp_year)) / min_by(avg_defects_per_inspection, insp_year) * 100', 6)}
       END AS delta_pct, count(*) AS years
FROM yt""", T, YEARLY_CTE))
def a41_trend_delta(spark, sf_dir):
    return X.trend_delta(profile.yearly_trend(fact_of(sources(spark, sf_dir)), T.yearly_trend))


FLEET_AGE_ALL = """
, fa AS (
  SELECT age_at_inspection, CAST(round(CAST(sum(defect_count) / count(*) AS DECIMAL(28,10)), 4) AS DOUBLE)
           AS avg_defects_per_inspection
  FROM fact WHERE age_at_inspection BETWEEN 1 AND 30 GROUP BY age_at_inspection HAVING count(DISTINCT kenteken) >= 1)"""


@register("a42_age_peak", lambda: O.q("""
SELECT age_at_inspection, avg_defects_per_inspection,
       avg_defects_per_inspection = max(avg_defects_per_inspection) OVER () AS is_peak
FROM fa WHERE age_at_inspection BETWEEN 2 AND 25""", T, FLEET_AGE_ALL))
def a42_age_peak(spark, sf_dir):
    fa = profile.fleet_age(segments.per_age_base(fact_of(sources(spark, sf_dir))), 1, 1, 30)
    return X.age_peak(fa)

