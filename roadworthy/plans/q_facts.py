"""Registered queries: fact build steps."""

from __future__ import annotations

from roadworthy.operators import facts
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, fact_of, register, sources


@register("a1_primary_inspections", lambda: O.q("SELECT * FROM prim", T))
def a1_primary_inspections(spark, sf_dir):
    return facts.primary_inspections(sources(spark, sf_dir).inspections)


@register("a2_defects_per_report", lambda: O.q("SELECT * FROM dc", T))
def a2_defects_per_report(spark, sf_dir):
    return facts.defect_counts(sources(spark, sf_dir).defects)


@register("a3_fuel_indicators", lambda: O.q("""
SELECT kenteken,
       coalesce(bool_or(brandstof_omschrijving = 'Elektriciteit'), false) AS has_electric,
       coalesce(bool_or(brandstof_omschrijving = 'Benzine'), false) AS has_benzine,
       coalesce(bool_or(brandstof_omschrijving = 'Diesel'), false) AS has_diesel,
       coalesce(bool_or(brandstof_omschrijving = 'LPG'), false) AS has_lpg
FROM fuel GROUP BY kenteken""", T))
def a3_fuel_indicators(spark, sf_dir):
    return facts.fuel_indicators(sources(spark, sf_dir).fuel)


@register("a4_primary_fuel", lambda: O.q("SELECT * FROM pf", T))
def a4_primary_fuel(spark, sf_dir):
    return facts.primary_fuel(sources(spark, sf_dir).fuel)


@register("a5_vehicle_attributes", lambda: O.q("SELECT * FROM va", T))
def a5_vehicle_attributes(spark, sf_dir):
    return facts.vehicle_attributes(sources(spark, sf_dir).vehicles)


@register("j3_inspection_stats", lambda: O.q("SELECT * FROM fact", T))
def j3_inspection_stats(spark, sf_dir):
    return fact_of(sources(spark, sf_dir))
