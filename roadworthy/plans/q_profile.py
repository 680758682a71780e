"""Registered queries: dataset profile and metadata."""

from __future__ import annotations

from roadworthy.operators import profile, segments
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, fact_of, register, sources

SUMMARY_CTE = f"""
, summary AS (
  SELECT count(*) AS total_inspections, {O.SUMI('defect_count')} AS total_defects,
         count(DISTINCT kenteken) AS total_vehicles,
         coalesce(CAST(trunc(max(catalogusprijs)) AS BIGINT), CAST(0 AS BIGINT)) AS max_price,
         {O.CI('defect_count = 0')} AS zero_defect_inspections,
         count(DISTINCT CASE WHEN vehicle_type_group = 'consumer' THEN kenteken END) AS consumer_vehicles,
         count(DISTINCT CASE WHEN vehicle_type_group = 'commercial' THEN kenteken END) AS commercial_vehicles,
         CASE WHEN count(*) > 0 THEN {O.R('count_if(defect_count = 0) / count(*)', 4)} ELSE 0.0 END
           AS zero_defect_rate
  FROM fact)"""

RANGES_CTE = SUMMARY_CTE + """
, seg_ranges AS (
  SELECT coalesce(max(vehicle_count), 0) AS fleet_max, coalesce(min(total_inspections), 0) AS inspections_min,
         coalesce(max(total_inspections), 0) AS inspections_max
  FROM (SELECT vehicle_count, total_inspections FROM bseg
        UNION ALL SELECT vehicle_count, total_inspections FROM mseg)),
ranges AS (
  SELECT s.*, m.max_price AS price_max, coalesce(a.mn, 0) AS age_min, coalesce(a.mx, 0) AS age_max
  FROM seg_ranges s, summary m,
       (SELECT min(age_at_inspection) AS mn, max(age_at_inspection) AS mx FROM fact) a)"""


@register("a11_dataset_summary", lambda: O.q("SELECT * FROM summary", T, SUMMARY_CTE))
def a11_dataset_summary(spark, sf_dir):
    return profile.dataset_summary(segments.model_moments(fact_of(sources(spark, sf_dir))))


@register("a12_fuel_domain", lambda: O.q("SELECT DISTINCT primary_fuel FROM fact", T))
def a12_fuel_domain(spark, sf_dir):
    return profile.fuel_domain(segments.model_moments(fact_of(sources(spark, sf_dir))))


@register("a13_yearly_trend", lambda: O.q(f"""
SELECT insp_year, count(*) AS inspections, {O.SUMI('defect_count')} AS total_defects,
       {O.R('sum(defect_count) / count(*)', 4)} AS avg_defects_per_inspection
FROM fact GROUP BY insp_year HAVING count(*) >= {T.yearly_trend}""", T))
def a13_yearly_trend(spark, sf_dir):
    return profile.yearly_trend(fact_of(sources(spark, sf_dir)), T.yearly_trend)


@register("a14_fleet_age", lambda: O.q(f"""
SELECT age_at_inspection, count(*) AS total_inspections, {O.SUMI('defect_count')} AS total_defects,
       count(DISTINCT kenteken) AS vehicle_count,
       {O.R('sum(defect_count) / count(*)', 4)} AS avg_defects_per_inspection
FROM fact WHERE age_at_inspection BETWEEN {T.fleet_age_min} AND {T.fleet_age_max}
GROUP BY age_at_inspection HAVING count(DISTINCT kenteken) >= {T.fleet_age_vehicles}""", T))
def a14_fleet_age(spark, sf_dir):
    return profile.fleet_age(segments.per_age_base(fact_of(sources(spark, sf_dir))), T.fleet_age_vehicles, T.fleet_age_min,
                             T.fleet_age_max)


@register("a15_zero_defect_rate", lambda: O.q(f"""
SELECT coalesce({O.R('avg(CASE WHEN defect_count = 0 THEN 1.0 ELSE 0.0 END)', 4)}, 0.0) AS zero_defect_rate
FROM fact""", T))
def a15_zero_defect_rate(spark, sf_dir):
    return profile.zero_defect_rate(segments.model_moments(fact_of(sources(spark, sf_dir))))


def _segs(spark, sf_dir):
    """Brand and model segments, dataset summary and age bounds from the two model-level tables."""
    fact = fact_of(sources(spark, sf_dir))
    ages = segments.age_moments(fact)
    return (segments.brand_segments_of(ages, T.brand), segments.model_segments_of(ages, T.model),
            profile.dataset_summary(segments.moments_of(ages)), segments.age_bounds(ages))


@register("a24_filter_ranges", lambda: O.q("SELECT * FROM ranges", T, RANGES_CTE))
def a24_filter_ranges(spark, sf_dir):
    return profile.filter_ranges(*_segs(spark, sf_dir))


@register("a25_metadata_flat", lambda: O.q(f"""
SELECT {T.brand} AS threshold_brand, {T.model} AS threshold_model, {T.age_bracket} AS threshold_age_bracket,
       r.*, (SELECT count(*) FROM bseg) AS brands, (SELECT count(*) FROM mseg) AS models,
       s.total_vehicles AS vehicles_processed, s.total_inspections, s.total_defects,
       s.consumer_vehicles, s.commercial_vehicles, s.zero_defect_rate
FROM ranges r, summary s""", T, RANGES_CTE))
def a25_metadata_flat(spark, sf_dir):
    return profile.metadata_flat(*_segs(spark, sf_dir), T)
