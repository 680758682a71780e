"""Registered queries: batch plate lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions import formatting as FM
from roadworthy.operators import defects as D
from roadworthy.operators import lookup as L
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, register, sources
from roadworthy.plans.q_defects import top_cte

AS_OF = "2024-01-01"


def typed_plates(src):
    """Every vehicle's plate as a user would type it ('12-34...')."""
    k = F.col(P.KENTEKEN)
    return src.vehicles.select(F.concat_ws("-", F.substring(k, 1, 2), F.substring(k, 3, 10)).alias("typed_plate"))


TYPED_CTE = f"""
, typed AS (SELECT substr(kenteken, 1, 2) || '-' || substr(kenteken, 3, 10) AS typed_plate FROM vehicles),
np AS (
  SELECT typed_plate, substr(upper(regexp_replace(coalesce(typed_plate, ''), '[^a-zA-Z0-9]', '', 'g')), 1, 10)
           AS kenteken FROM typed),
np2 AS (SELECT typed_plate, kenteken, length(kenteken) >= 4 AS valid FROM np),
vk AS (SELECT DISTINCT kenteken FROM np2 WHERE valid),
ra AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY kenteken ORDER BY meld_datum_door_keuringsinstantie DESC,
                  meld_tijd_door_keuringsinstantie DESC, soort_melding_ki_omschrijving ASC) AS INTEGER) AS report_rank
    FROM inspections WHERE kenteken IN (SELECT kenteken FROM vk)),
rr AS (SELECT * FROM ra WHERE report_rank <= {P.LOOKUP_MAX_REPORTS}),
rd AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY kenteken ORDER BY meld_datum_door_keuringsinstantie DESC,
                  meld_tijd_door_keuringsinstantie DESC, gebrek_identificatie ASC,
                  aantal_gebreken_geconstateerd ASC NULLS FIRST) AS INTEGER) AS defect_rank
    FROM defects WHERE kenteken IN (SELECT kenteken FROM vk))"""


def _date_disp(c: str) -> str:
    return f"CASE WHEN length({c}) = 8 THEN substr({c}, 7, 2) || '-' || substr({c}, 5, 2) || '-' || substr({c}, 1, 4) ELSE {c} END"


@register("p35_plate_normalise", lambda: O.q("SELECT * FROM np2", T, TYPED_CTE))
def p35_plate_normalise(spark, sf_dir):
    return L.normalized_plates(typed_plates(sources(spark, sf_dir)))


@register("w5_recent_reports", lambda: O.q("SELECT * FROM rr", T, TYPED_CTE))
def w5_recent_reports(spark, sf_dir):
    src = sources(spark, sf_dir)
    return L.recent_reports(typed_plates(src), src.inspections)


@register("j10_vehicle_history", lambda: O.q(f"""
SELECT r.kenteken, r.report_rank, {_date_disp('r.meld_datum_door_keuringsinstantie')} AS report_date,
       r.meld_tijd_door_keuringsinstantie,
       coalesce(contains(r.soort_melding_ki_omschrijving, 'Goedgekeurd'), false) AS passed,
       d.defect_rank, d.gebrek_identificatie AS defect_code, d.description, d.aantal_gebreken_geconstateerd AS defect_count
FROM ra r LEFT JOIN (
  SELECT x.*, CASE WHEN c.d <> '' THEN c.d END AS description
  FROM rd x LEFT JOIN (SELECT gebrek_identificatie, coalesce(max(gebrek_omschrijving), '') AS d FROM codes
                       WHERE gebrek_identificatie IS NOT NULL AND gebrek_identificatie <> '' GROUP BY 1) c
    ON x.gebrek_identificatie = c.gebrek_identificatie) d
  ON r.kenteken = d.kenteken AND r.meld_datum_door_keuringsinstantie = d.meld_datum_door_keuringsinstantie""",
                                               T, TYPED_CTE))
def j10_vehicle_history(spark, sf_dir):
    src = sources(spark, sf_dir)
    return L.vehicle_history(typed_plates(src), src.inspections, src.defects, src.codes)


@register("p36_certificate_validity", lambda: O.q(f"""
SELECT n.typed_plate, n.kenteken,
       CASE WHEN NOT n.valid THEN 'invalid' WHEN v.kenteken IS NULL THEN 'not_found' ELSE 'found' END AS status,
       v.merk, v.handelsbenaming, {_date_disp('v.datum_eerste_toelating')} AS first_admission,
       CASE WHEN n.valid AND v.kenteken IS NOT NULL THEN
         CASE WHEN v.vervaldatum_apk IS NULL OR v.vervaldatum_apk = '' THEN 'unknown'
              WHEN try_strptime(v.vervaldatum_apk, '%Y%m%d') > DATE '{AS_OF}' THEN 'valid' ELSE 'expired' END
       END AS certificate,
       CASE WHEN n.valid AND v.kenteken IS NOT NULL THEN coalesce(c.n, 0) END
         AS reports
FROM np2 n
LEFT JOIN (SELECT kenteken, merk, handelsbenaming, datum_eerste_toelating, voertuigsoort, vervaldatum_apk FROM (
             SELECT *, row_number() OVER (PARTITION BY kenteken ORDER BY merk NULLS FIRST,
               handelsbenaming NULLS FIRST, datum_eerste_toelating NULLS FIRST, voertuigsoort NULLS FIRST,
               vervaldatum_apk NULLS FIRST) AS rn
             FROM vehicles WHERE kenteken IN (SELECT kenteken FROM vk)) WHERE rn = 1) v ON n.kenteken = v.kenteken
LEFT JOIN (SELECT kenteken, count(*) AS n FROM inspections GROUP BY kenteken) c ON n.kenteken = c.kenteken""",
                                                    T, TYPED_CTE))
def p36_certificate_validity(spark, sf_dir):
    src = sources(spark, sf_dir)
    return L.lookup_vehicles(typed_plates(src), src.vehicles, src.inspections, AS_OF)


@register("p37_pass_flag", lambda: O.q("""
SELECT kenteken, meld_datum_door_keuringsinstantie,
       coalesce(contains(soort_melding_ki_omschrijving, 'Goedgekeurd'), false) AS passed FROM inspections""", T))
def p37_pass_flag(spark, sf_dir):
    src = sources(spark, sf_dir)
    return src.inspections.select(P.KENTEKEN, P.MELD_DATUM, FM.passed(F.col(P.SOORT_MELDING)).alias("passed"))


@register("p34_date_format", lambda: O.q(f"""
SELECT kenteken, {_date_disp('datum_eerste_toelating')} AS first_admission,
       {_date_disp('vervaldatum_apk')} AS certificate_expiry FROM vehicles""", T))
def p34_date_format(spark, sf_dir):
    v = sources(spark, sf_dir).vehicles
    return v.select(P.KENTEKEN, FM.compact_date_display(F.col(P.DATUM_EERSTE_TOELATING)).alias("first_admission"),
                    FM.compact_date_display(F.col(P.VERVALDATUM_APK)).alias("certificate_expiry"))


@register("j10_uncached_codes", lambda: O.q(f"""
SELECT DISTINCT gebrek_identificatie AS defect_code FROM defects WHERE kenteken IN (SELECT kenteken FROM vk)
AND gebrek_identificatie NOT IN (SELECT defect_code FROM top)""",
                                              T, TYPED_CTE + top_cte()))
def j10_uncached_codes(spark, sf_dir):
    """Codes of the looked-up histories not covered by the published top-code list."""
    src = sources(spark, sf_dir)
    cached = D.top_defects(src.defects, src.codes, T.top_codes)
    return L.uncached_codes(typed_plates(src), src.defects, cached)
