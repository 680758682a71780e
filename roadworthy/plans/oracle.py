"""Independent DuckDB SQL for the registered queries.

The driver runs each string against the test tables (pre-registered views)
and compares row count, schema and an order-insensitive value hash with the
Spark result.  Every statement starts with the same CTE prefix: the fixture
binding (FIXTURES.md part B) and the fact build, written directly in SQL.
DuckDB does not evaluate CTEs a statement does not use.
"""

from __future__ import annotations

from roadworthy.params import Thresholds


def R(expr: str, n: int) -> str:
    """Decimal rounding, identical to ``normalize.rnd``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28,10)), {n}) AS DOUBLE)"


def STRIP(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def NTIME(expr: str) -> str:
    t = STRIP(f"coalesce({expr}, '')")
    return f"(CASE WHEN length({t}) < 4 THEN lpad({t}, 4, '0') ELSE {t} END)"


def CI(pred: str) -> str:
    """count_if as BIGINT (DuckDB returns HUGEINT, Spark bigint)."""
    return f"CAST(count_if({pred}) AS BIGINT)"


def SUMI(expr: str) -> str:
    """Integer sum as BIGINT (DuckDB returns HUGEINT, Spark bigint)."""
    return f"CAST(sum({expr}) AS BIGINT)"


def ratio0(num: str, den: str, n: int = 6) -> str:
    return R(f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 0.0)", n)


def CODE(n: str) -> str:
    """Code text of a number (the binding's families of codes)."""
    return (f"(CASE ({n}) % 25 WHEN 0 THEN 'AP' || ({n}) WHEN 1 THEN ' op' || ({n}) WHEN 2 THEN 'AC' || (({n}) // 25 % 5 + 1) "
            f"WHEN 3 THEN 'RA4' WHEN 4 THEN CAST(({n}) // 25 % 3 + 115 AS VARCHAR) WHEN 5 THEN CAST(({n}) // 25 % 6 + 388 AS VARCHAR) "
            f"WHEN 6 THEN CAST(({n}) // 25 * 12 + 475 AS VARCHAR) ELSE CAST(({n}) AS VARCHAR) END)")


def binding(code_offset: int = 0) -> str:
    return f"""
vehicles AS (
  SELECT CAST(p_partkey AS VARCHAR) AS kenteken,
         CASE WHEN split_part(p_type, ' ', 1) IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'Personenauto'
              WHEN split_part(p_type, ' ', 1) = 'SMALL' THEN 'Bedrijfsauto'
              ELSE 'Motorfiets' END AS voertuigsoort,
         CASE WHEN c = 2 THEN chr(9) || lower(p_brand) || ' ' ELSE p_brand END AS merk,
         CASE WHEN p_partkey % 17 <> 0 THEN p_name END AS handelsbenaming,
         CAST(1985 + p_size % 15 AS VARCHAR) || '0101' AS datum_eerste_toelating,
         CASE WHEN c = 2 OR p_size % 7 = 0 THEN NULL ELSE CAST(p_retailprice AS VARCHAR) END AS catalogusprijs,
         CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '2030'
              ELSE CAST(2018 + p_size % 10 AS VARCHAR) || lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0') || '15'
         END AS vervaldatum_apk
  FROM (SELECT *, unnest(CASE WHEN p_partkey % 13 = 0 THEN [1, 2] ELSE [1] END) AS c FROM part)),
inspections AS (
  SELECT CAST(l_partkey AS VARCHAR) AS kenteken,
         strftime(l_shipdate, '%Y%m%d') AS meld_datum_door_keuringsinstantie,
         CAST(l_linenumber * 170 + 30 AS VARCHAR) AS meld_tijd_door_keuringsinstantie,
         CASE WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN chr(9) || 'PERIODIEKE controle'
              WHEN l_linestatus = 'F' THEN 'Periodieke Controle '
              WHEN l_linenumber % 2 = 0 THEN 'tachograaf Goedgekeurd' ELSE 'tachograaf' END AS soort_melding_ki_omschrijving,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'onbekend'
              ELSE strftime(CAST(l_shipdate AS DATE) + CAST(l_linenumber * 61 AS INTEGER), '%Y%m%d')
         END AS vervaldatum_keuring
  FROM lineitem),
defects AS (
  SELECT CAST(l_partkey AS VARCHAR) AS kenteken,
         strftime(l_shipdate, '%Y%m%d') AS meld_datum_door_keuringsinstantie,
         CAST(l_linenumber * 170 + 30 AS VARCHAR) AS meld_tijd_door_keuringsinstantie,
         {CODE(f'l_suppkey + {code_offset}')} AS gebrek_identificatie,
         CASE WHEN l_tax = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) % 4 + 1 AS VARCHAR) END
           AS aantal_gebreken_geconstateerd
  FROM lineitem WHERE l_returnflag IN ('R', 'A')),
codes AS (
  SELECT {CODE(f's_suppkey + {code_offset}')} AS gebrek_identificatie, s_name AS gebrek_omschrijving
  FROM supplier),
fuel AS (
  SELECT CAST(l_partkey AS VARCHAR) AS kenteken,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'LPG' WHEN '2-HIGH' THEN 'Elektriciteit'
              WHEN '3-MEDIUM' THEN 'Diesel' WHEN '5-LOW' THEN 'Benzine' ELSE 'Waterstof' END
           AS brandstof_omschrijving
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount = 0.1)"""


FACT = f"""
prim AS (
  SELECT kenteken, meld_datum_door_keuringsinstantie, min(t) AS meld_tijd_door_keuringsinstantie,
         CAST(substr(meld_datum_door_keuringsinstantie, 1, 4) AS INTEGER) AS insp_year
  FROM (SELECT kenteken, meld_datum_door_keuringsinstantie, {NTIME('meld_tijd_door_keuringsinstantie')} AS t
        FROM inspections
        WHERE lower({STRIP('soort_melding_ki_omschrijving')}) = 'periodieke controle')
  GROUP BY kenteken, meld_datum_door_keuringsinstantie),
dc AS (
  SELECT kenteken, meld_datum_door_keuringsinstantie, t AS meld_tijd_door_keuringsinstantie,
         CAST(sum(q) AS BIGINT) AS defect_count
  FROM (SELECT kenteken, meld_datum_door_keuringsinstantie, {NTIME('meld_tijd_door_keuringsinstantie')} AS t,
               CAST(coalesce(aantal_gebreken_geconstateerd, '1') AS BIGINT) AS q FROM defects)
  GROUP BY 1, 2, 3),
pf AS (
  SELECT kenteken,
         CASE WHEN l THEN 'LPG' WHEN e AND (b OR d) THEN 'Hybrid' WHEN e THEN 'Elektriciteit'
              WHEN d THEN 'Diesel' WHEN b THEN 'Benzine' ELSE 'Other' END AS primary_fuel
  FROM (SELECT kenteken,
               coalesce(bool_or(brandstof_omschrijving = 'Elektriciteit'), false) AS e,
               coalesce(bool_or(brandstof_omschrijving = 'Benzine'), false) AS b,
               coalesce(bool_or(brandstof_omschrijving = 'Diesel'), false) AS d,
               coalesce(bool_or(brandstof_omschrijving = 'LPG'), false) AS l
        FROM fuel GROUP BY kenteken)),
va AS (
  SELECT kenteken, merk, handelsbenaming, datum_eerste_toelating, catalogusprijs, vehicle_type_group
  FROM (SELECT *, row_number() OVER (PARTITION BY kenteken ORDER BY merk NULLS FIRST, handelsbenaming NULLS FIRST,
                     datum_eerste_toelating NULLS FIRST, catalogusprijs NULLS FIRST, vehicle_type_group NULLS FIRST) AS rn
        FROM (SELECT kenteken, {STRIP('upper(merk)')} AS merk, {STRIP('upper(handelsbenaming)')} AS handelsbenaming,
                     datum_eerste_toelating, coalesce(CAST(catalogusprijs AS DOUBLE), 0.0) AS catalogusprijs,
                     CASE WHEN voertuigsoort = 'Personenauto' THEN 'consumer'
                          WHEN voertuigsoort = 'Bedrijfsauto' THEN 'commercial' ELSE 'other' END AS vehicle_type_group
              FROM vehicles)
        WHERE vehicle_type_group IN ('consumer', 'commercial'))
  WHERE rn = 1),
fact AS (
  SELECT p.kenteken, p.meld_datum_door_keuringsinstantie, p.meld_tijd_door_keuringsinstantie,
         v.merk, v.handelsbenaming, v.catalogusprijs, v.vehicle_type_group,
         coalesce(f.primary_fuel, 'Other') AS primary_fuel, p.insp_year,
         p.insp_year - CAST(substr(v.datum_eerste_toelating, 1, 4) AS INTEGER) AS age_at_inspection,
         coalesce(d.defect_count, CAST(0 AS BIGINT)) AS defect_count
  FROM prim p
  JOIN va v ON p.kenteken = v.kenteken
  LEFT JOIN pf f ON p.kenteken = f.kenteken
  LEFT JOIN dc d ON p.kenteken = d.kenteken
       AND p.meld_datum_door_keuringsinstantie = d.meld_datum_door_keuringsinstantie
       AND p.meld_tijd_door_keuringsinstantie = d.meld_tijd_door_keuringsinstantie
  WHERE p.insp_year - CAST(substr(v.datum_eerste_toelating, 1, 4) AS INTEGER) BETWEEN 0 AND 100)"""


def _measures(with_found: bool, exposure: str = "age") -> str:
    rate = "defect_count / greatest(age_at_inspection, 1)"
    found = f"{CI('defect_count > 0')} AS inspections_with_defects," if with_found else ""
    return f"""count(DISTINCT kenteken) AS vehicle_count, count(*) AS total_inspections,
         CAST(sum(defect_count) AS DOUBLE) AS total_defects, {found}
         {R('stddev_samp(defect_count)', 4)} AS std_defects_per_inspection,
         {R('avg(age_at_inspection)', 2)} AS avg_age_years,
         {'CAST(sum(age_at_inspection) AS DOUBLE)' if exposure == 'age' else 'sum(coverage_years)'} AS tvy,
         {R(f'stddev_samp({rate})', 4)} AS std_defects_per_vehicle_year,
         sum({rate}) AS sum_defects_per_vehicle_year_rates,
         sum(({rate}) * ({rate})) AS sum_sq_defects_per_vehicle_year_rates,
         CAST(sum(defect_count * defect_count) AS DOUBLE) AS sum_sq_defect_counts,
         sum(catalogusprijs) AS sum_catalog_price,
         {CI('catalogusprijs > 0')} AS count_with_price
         {', CAST(sum(age_at_inspection) AS DOUBLE) AS sum_age_years' if exposure != 'age' else ''}"""


def _derived(src: str) -> str:
    return f"""SELECT * EXCLUDE (tvy), {R('total_defects / total_inspections', 4)} AS avg_defects_per_inspection,
         {ratio0('total_defects', 'tvy')} AS defects_per_vehicle_year, {R('tvy', 4)} AS total_vehicle_years
  FROM {src}"""


def segments(t: Thresholds) -> str:
    return f"""
bseg_raw AS (
  SELECT merk, vehicle_type_group, primary_fuel, {_measures(True)}
  FROM fact GROUP BY merk, vehicle_type_group, primary_fuel
  HAVING count(DISTINCT kenteken) >= {t.brand}),
bseg AS ({_derived('bseg_raw')}),
mseg_raw AS (
  SELECT * FROM (
    SELECT *, CAST(sum(vehicle_count) OVER (PARTITION BY merk, handelsbenaming) AS BIGINT) AS total_model_count FROM (
      SELECT merk, handelsbenaming, vehicle_type_group, primary_fuel, {_measures(False)}
      FROM fact GROUP BY merk, handelsbenaming, vehicle_type_group, primary_fuel))
  WHERE total_model_count >= {t.model}),
mseg AS ({_derived('mseg_raw')})"""


def prefix(t: Thresholds, code_offset: int = 0) -> str:
    return "WITH " + binding(code_offset) + "," + FACT + "," + segments(t)


def q(body: str, t: Thresholds, extra: str = "", code_offset: int = 0) -> str:
    """Full statement: shared prefix, optional extra CTEs (leading comma), body."""
    return prefix(t, code_offset) + extra + "\n" + body


def six(src: str) -> str:
    """A segment table with its sums of fractions rounded for display."""
    cols = ("sum_defects_per_vehicle_year_rates", "sum_sq_defects_per_vehicle_year_rates", "sum_catalog_price")
    return f"SELECT * REPLACE ({', '.join(f'{R(c, 6)} AS {c}' for c in cols)}) FROM {src}"


def coverage_ctes(t: Thresholds) -> str:
    """Fact with the documented coverage years (D1) and brand segments on it."""
    d0 = "try_strptime(meld_datum_door_keuringsinstantie, '%Y%m%d')"
    d1 = "try_strptime(exp, '%Y%m%d')"
    cov = (f"CASE WHEN {d0} IS NULL OR {d1} IS NULL THEN 1.0 "
           f"ELSE greatest(date_diff('day', CAST({d0} AS DATE), CAST({d1} AS DATE)) / 365.25, 0.25) END")
    return f"""
, prim_exp AS (
  SELECT kenteken, meld_datum_door_keuringsinstantie, arg_min(vervaldatum_keuring, t || coalesce(vervaldatum_keuring, '~')) AS exp
  FROM (SELECT kenteken, meld_datum_door_keuringsinstantie, vervaldatum_keuring,
               {NTIME('meld_tijd_door_keuringsinstantie')} AS t
        FROM inspections WHERE lower({STRIP('soort_melding_ki_omschrijving')}) = 'periodieke controle')
  GROUP BY kenteken, meld_datum_door_keuringsinstantie),
fact_cov AS (
  SELECT f.*, {cov} AS coverage_years
  FROM fact f JOIN prim_exp p USING (kenteken, meld_datum_door_keuringsinstantie)),
bseg_cov_raw AS (
  SELECT merk, vehicle_type_group, primary_fuel, {_measures(True, 'coverage')}
  FROM fact_cov GROUP BY merk, vehicle_type_group, primary_fuel
  HAVING count(DISTINCT kenteken) >= {t.brand}),
bseg_cov AS ({_derived('bseg_cov_raw')})"""
