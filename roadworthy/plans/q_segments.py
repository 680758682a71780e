"""Registered queries: segments, per-age rows, rankings."""

from __future__ import annotations

from roadworthy import params as P
from roadworthy.operators import facts, rankings, segments
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, fact_of, positions, register, six_digits, sources


def _per_age_sql(keys: str) -> str:
    return f"""
SELECT {keys}, age_at_inspection, count(DISTINCT kenteken) AS vehicle_count, count(*) AS total_inspections,
       CAST(sum(defect_count) AS DOUBLE) AS total_defects,
       {O.R('sum(defect_count) / count(*)', 4)} AS avg_defects_per_inspection
FROM fact GROUP BY {keys}, age_at_inspection
HAVING count(DISTINCT kenteken) >= {T.age_bracket}"""


@register("a6_brand_segments", lambda: O.q(O.six("bseg"), T))
def a6_brand_segments(spark, sf_dir):
    return six_digits(segments.brand_segments(fact_of(sources(spark, sf_dir)), T.brand))


@register("a7_model_segments", lambda: O.q(O.six("mseg"), T))
def a7_model_segments(spark, sf_dir):
    return six_digits(segments.model_segments(fact_of(sources(spark, sf_dir)), T.model))


@register("t1_segment_order", lambda: O.q("""
SELECT merk, handelsbenaming, vehicle_type_group, primary_fuel, CAST(row_number() OVER (ORDER BY defects_per_vehicle_year NULLS FIRST,
  merk NULLS FIRST, handelsbenaming NULLS FIRST, vehicle_type_group, primary_fuel) AS INTEGER) AS position FROM mseg""", T))
def t1_segment_order(spark, sf_dir):
    """Model segments in publishing order."""
    seg = segments.model_segments(fact_of(sources(spark, sf_dir)), T.model)
    return positions(segments.by_rate(seg, P.MODEL_KEYS).select(*P.MODEL_KEYS))


@register("t2_per_age_order", lambda: O.q("SELECT merk, vehicle_type_group, primary_fuel, age_at_inspection, "
          "CAST(row_number() OVER (ORDER BY merk, vehicle_type_group, primary_fuel, age_at_inspection) AS INTEGER) AS position FROM ("
          + _per_age_sql("merk, vehicle_type_group, primary_fuel") + ")", T))
def t2_per_age_order(spark, sf_dir):
    """Per-age rows in publishing order."""
    rows = segments.per_age(fact_of(sources(spark, sf_dir)), P.BRAND_KEYS, T.age_bracket)
    return positions(segments.by_age(rows, P.BRAND_KEYS).select(*P.BRAND_KEYS, "age_at_inspection"))


@register("w1_model_totals", lambda: O.q("""
SELECT *, CAST(sum(vehicle_count) OVER (PARTITION BY merk, handelsbenaming) AS BIGINT) AS total_model_count
FROM (SELECT merk, handelsbenaming, vehicle_type_group, primary_fuel, count(DISTINCT kenteken) AS vehicle_count
      FROM fact GROUP BY ALL)""", T))
def w1_model_totals(spark, sf_dir):
    return segments.model_totals(fact_of(sources(spark, sf_dir)))


@register("a8_brand_per_age", lambda: O.q(_per_age_sql("merk, vehicle_type_group, primary_fuel"), T))
def a8_brand_per_age(spark, sf_dir):
    return segments.per_age(fact_of(sources(spark, sf_dir)), P.BRAND_KEYS, T.age_bracket)


@register("a8_model_per_age",
          lambda: O.q(_per_age_sql("merk, handelsbenaming, vehicle_type_group, primary_fuel"), T))
def a8_model_per_age(spark, sf_dir):
    return segments.per_age(fact_of(sources(spark, sf_dir)), P.MODEL_KEYS, T.age_bracket)


AGE_MOMENTS_SQL = """
, per_vehicle AS (
  SELECT merk, handelsbenaming, vehicle_type_group, primary_fuel, age_at_inspection, count(*) AS n, sum(defect_count) AS d,
         count_if(defect_count > 0) AS f, sum(defect_count * defect_count) AS d2,
         min(age_at_inspection) = min(min(age_at_inspection)) OVER (
           PARTITION BY merk, handelsbenaming, vehicle_type_group, primary_fuel, kenteken) AS first
  FROM fact GROUP BY merk, handelsbenaming, vehicle_type_group, primary_fuel, kenteken, age_at_inspection),
ages AS (
  SELECT merk, handelsbenaming, vehicle_type_group, primary_fuel, age_at_inspection, count(*) AS vehicle_count,
         CAST(count_if(first) AS BIGINT) AS first_vehicles, CAST(sum(n) AS BIGINT) AS total_inspections,
         CAST(sum(d) AS BIGINT) AS total_defects, CAST(sum(f) AS BIGINT) AS inspections_with_defects,
         CAST(sum(d2) AS BIGINT) AS sum_sq_defect_counts
  FROM per_vehicle GROUP BY ALL)"""


@register("a30_age_moments", lambda: O.q("SELECT * FROM ages", T, AGE_MOMENTS_SQL))
def a30_age_moments(spark, sf_dir):
    """The whole-number sums per model segment and age that every segment follows from."""
    ages = segments.age_moments(fact_of(sources(spark, sf_dir)))
    return ages.drop("sum_catalog_price", "count_with_price", "max_catalog_price")


@register("a30_exact_rate_sums", lambda: O.q("""
SELECT merk, vehicle_type_group, primary_fuel, CAST(sum(v) AS BIGINT) AS vehicle_count,
       list_reduce(list(CAST(d AS DOUBLE) / greatest(age_at_inspection, 1) ORDER BY age_at_inspection), lambda a, b: a + b)
         AS sum_defects_per_vehicle_year_rates,
       list_reduce(list(CAST(d2 AS DOUBLE) / (greatest(age_at_inspection, 1) * greatest(age_at_inspection, 1)) ORDER BY age_at_inspection),
                   lambda a, b: a + b) AS sum_sq_defects_per_vehicle_year_rates
FROM (SELECT merk, vehicle_type_group, primary_fuel, age_at_inspection, sum(first_vehicles) AS v, sum(total_defects) AS d,
             sum(sum_sq_defect_counts) AS d2 FROM ages GROUP BY ALL)
GROUP BY ALL""", T, AGE_MOMENTS_SQL))
def a30_exact_rate_sums(spark, sf_dir):
    """Vehicles and both sums of rates of each brand segment, equal to the last bit."""
    moments = segments.moments_of(segments.age_moments(fact_of(sources(spark, sf_dir))), P.BRAND_KEYS)
    return moments.select(*P.BRAND_KEYS, "vehicle_count", "sum_defects_per_vehicle_year_rates", "sum_sq_defects_per_vehicle_year_rates")


@register("a9_age_bounds", lambda: O.q("""
SELECT coalesce(min(age_at_inspection), 0) AS min_age, coalesce(max(age_at_inspection), 0) AS max_age
FROM fact""", T))
def a9_age_bounds(spark, sf_dir):
    return segments.age_bounds(segments.per_age_base(fact_of(sources(spark, sf_dir))))


def ranking_sql(src: str, keys: str, threshold: int, k: int = 10) -> str:
    """Both ranking lists of one level (A26 + W2 + T4) as CTEs ending in ``ranked``."""
    level = "brands" if keys == "merk" else "models"
    order_keys = ", ".join(f"{c} ASC NULLS FIRST" for c in keys.split(", "))
    return f"""
, rolled AS (
  SELECT {keys}, CAST(sum(vehicle_count) AS BIGINT) AS vehicle_count,
         CAST(sum(total_inspections) AS BIGINT) AS total_inspections,
         sum(total_defects) AS total_defects, sum(total_vehicle_years) AS tvy
  FROM {src} WHERE vehicle_type_group = 'consumer' GROUP BY {keys}),
rated AS (
  SELECT *, CASE WHEN tvy > 0 THEN total_defects / tvy ELSE 0.0 END AS rate
  FROM rolled WHERE vehicle_count >= {threshold}),
lists AS (
  SELECT 'most_reliable_{level}' AS ranking,
         CAST(row_number() OVER (ORDER BY rate ASC, vehicle_count DESC, {order_keys}) AS INTEGER) AS rank, *
  FROM rated
  UNION ALL
  SELECT 'least_reliable_{level}' AS ranking,
         CAST(row_number() OVER (ORDER BY rate DESC, vehicle_count DESC, {order_keys}) AS INTEGER) AS rank, *
  FROM rated),
ranked AS (
  SELECT ranking, rank, {keys}, {O.R('rate', 6)} AS defects_per_vehicle_year, total_inspections, vehicle_count
  FROM lists WHERE rank <= {k})"""


@register("t4_brand_ranking", lambda: O.q("SELECT * FROM ranked", T, ranking_sql("bseg", "merk", T.brand_ranking)))
def t4_brand_ranking(spark, sf_dir):
    seg = segments.brand_segments(fact_of(sources(spark, sf_dir)), T.brand)
    return rankings.brand_ranking(seg, T.brand_ranking, T.ranking_size)


@register("t4_zero_rate_unknown", lambda: O.q("""
SELECT ranking, CAST(rank AS INTEGER) AS rank, merk, handelsbenaming FROM (
  SELECT 'most_reliable_models' AS ranking, row_number() OVER (ORDER BY CASE WHEN rate = 0 THEN 'infinity'::DOUBLE ELSE rate END ASC,
           vehicle_count DESC, merk ASC NULLS FIRST, handelsbenaming ASC NULLS FIRST) AS rank, merk, handelsbenaming FROM rated
  UNION ALL
  SELECT 'least_reliable_models', row_number() OVER (ORDER BY CASE WHEN rate = 0 THEN 'infinity'::DOUBLE ELSE rate END DESC,
           vehicle_count DESC, merk ASC NULLS FIRST, handelsbenaming ASC NULLS FIRST), merk, handelsbenaming FROM rated)
WHERE rank <= 10""", T, ranking_sql("mseg", "merk, handelsbenaming", 1)))
def t4_zero_rate_unknown(spark, sf_dir):
    """T4 with a zero rate taken as unknown (D2): such models end the one list and head the other."""
    seg = segments.model_segments(fact_of(sources(spark, sf_dir)), T.model)
    return rankings.model_ranking(seg, 1, T.ranking_size, zero_rate_as_unknown=True).select(
        "ranking", "rank", P.MERK, P.HANDELSBENAMING)


@register("t4_model_ranking",
          lambda: O.q("SELECT * FROM ranked", T, ranking_sql("mseg", "merk, handelsbenaming", T.model_ranking)))
def t4_model_ranking(spark, sf_dir):
    seg = segments.model_segments(fact_of(sources(spark, sf_dir)), T.model)
    return rankings.model_ranking(seg, T.model_ranking, T.ranking_size)


@register("d1_coverage_exposure", lambda: O.q(O.six("bseg_cov"), T, O.coverage_ctes(T)))
def d1_coverage_exposure(spark, sf_dir):
    """Brand segments with vehicle-years from the documented coverage years."""
    src = sources(spark, sf_dir)
    fact = facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel, with_coverage=True)
    return six_digits(segments.brand_segments(fact, T.brand, exposure="coverage"))
