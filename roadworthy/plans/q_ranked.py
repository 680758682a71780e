"""Registered queries: places in large views, distinct vehicles that merge, indexed search and lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.operators import distinct, rank_index, search_index, segments
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, fact_of, register, sources
from roadworthy.session import shared_dir
from roadworthy.sources import publish
from roadworthy.sources.plate_store import PlateStore

DEEP_PAGE, PAGE = 100, 50
WINDOW = (3, 9)
_KEYS = ", ".join(P.MODEL_KEYS)
_PER_AGE = f"""
, pa AS (
  SELECT {_KEYS}, age_at_inspection, count(DISTINCT kenteken) AS vehicle_count, count(*) AS total_inspections,
         CAST(sum(defect_count) AS DOUBLE) AS total_defects
  FROM fact GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (ORDER BY total_defects DESC NULLS FIRST, {", ".join(f"{c} ASC NULLS FIRST" for c in P.MODEL_KEYS)},
                               age_at_inspection) AS position FROM pa)"""


def _view_index(spark, sf_dir, rows):
    """The largest view, per model segment and age, by defects; small ranges, so that pages cross them here too."""
    base = segments.per_age_base(fact_of(sources(spark, sf_dir)))
    order = rank_index.view_order("total_defects", False, [*P.MODEL_KEYS, "age_at_inspection"])
    return rank_index.build(base, order, shared_dir(spark, "rank-index"), rows)


@register("t6_deep_page", lambda: O.q(
    f"SELECT * FROM placed WHERE position BETWEEN {(DEEP_PAGE - 1) * PAGE + 1} AND {DEEP_PAGE * PAGE}", T, _PER_AGE))
def t6_deep_page(spark, sf_dir):
    """A page far into a large view; only the ranges that hold it are read."""
    return _view_index(spark, sf_dir, 500).slice((DEEP_PAGE - 1) * PAGE + 1, DEEP_PAGE * PAGE)


@register("t10_numbered_view", lambda: O.q(
    f"SELECT *, CAST((position - 1) // {PAGE} + 1 AS BIGINT) AS page FROM placed", T, _PER_AGE))
def t10_numbered_view(spark, sf_dir):
    """Every row of a large view with its place and page."""
    numbered = _view_index(spark, sf_dir, 500).numbered()
    return numbered.withColumn("page", F.floor((F.col("position") - 1) / PAGE) + 1)


def _bitmaps(spark, sf_dir):
    base = shared_dir(spark, "distinct")
    fact = publish.persist_table(fact_of(sources(spark, sf_dir)), f"{base}/fact")
    numbers = distinct.vehicle_numbers(fact, f"{base}/numbers", rows=2000)
    return fact, publish.persist_table(distinct.age_bitmaps(fact, numbers), f"{base}/bitmaps")


@register("a29_distinct_vehicles", lambda: O.q(f"""
SELECT merk, count(DISTINCT kenteken) AS vehicle_count, count(*) AS total_inspections, CAST(sum(defect_count) AS DOUBLE) AS total_defects,
       {O.R('sum(defect_count) / count(*)', 4)} AS avg_defects_per_inspection
FROM fact WHERE vehicle_type_group = 'consumer' AND primary_fuel <> 'Diesel' AND age_at_inspection BETWEEN {WINDOW[0]} AND {WINDOW[1]}
GROUP BY merk""", T))
def a29_distinct_vehicles(spark, sf_dir):
    """An age window of filtered segments that counts every vehicle once."""
    fact, bitmaps = _bitmaps(spark, sf_dir)
    kept = (F.col("vehicle_type_group") == P.GROUP_CONSUMER) & (F.col("primary_fuel") != P.FUEL_DIESEL)
    return distinct.age_window(segments.per_age_base(fact), bitmaps, kept, [P.MERK], *WINDOW)


@register("a29_distinct_models", lambda: O.q(f"""
SELECT merk, handelsbenaming, count(DISTINCT kenteken) AS vehicle_count, count(*) AS total_inspections,
       CAST(sum(defect_count) AS DOUBLE) AS total_defects, {O.R('sum(defect_count) / count(*)', 4)} AS avg_defects_per_inspection
FROM fact WHERE age_at_inspection BETWEEN {WINDOW[0]} AND {WINDOW[1]} GROUP BY merk, handelsbenaming""", T))
def a29_distinct_models(spark, sf_dir):
    """A29/D12 per model, models without a name included."""
    fact, bitmaps = _bitmaps(spark, sf_dir)
    return distinct.age_window(segments.per_age_base(fact), bitmaps, F.lit(True), [P.MERK, P.HANDELSBENAMING], *WINDOW)


@register("p39_band_vehicles", lambda: O.q(f"""
SELECT b.band AS age_band, count(DISTINCT kenteken) AS vehicle_count
FROM fact f JOIN (VALUES {', '.join(f"('{n}', {lo}, {hi})" for n, lo, hi in P.AGE_BANDS)}) b(band, lo, hi)
  ON f.age_at_inspection BETWEEN b.lo AND b.hi GROUP BY b.band""", T))
def p39_band_vehicles(spark, sf_dir):
    """Distinct vehicles of the overlapping age bands, from the same bitmaps."""
    return distinct.band_vehicles(_bitmaps(spark, sf_dir)[1])


@register("a11_distinct_by_fuel", lambda: O.q("SELECT primary_fuel, count(DISTINCT kenteken) AS vehicle_count FROM fact GROUP BY ALL", T))
def a11_distinct_by_fuel(spark, sf_dir):
    """Distinct vehicles of any coarser group, here the fuels over all ages."""
    return distinct.distinct_vehicles(_bitmaps(spark, sf_dir)[1], ["primary_fuel"])


SEARCHES = {"p28_indexed_search": "brand#1 red", "p28_indexed_short": "#2 e"}


def _search_sql(text):
    def of(t):
        return f"(coalesce(contains(lower(merk), '{t}'), false) OR coalesce(contains(lower(handelsbenaming), '{t}'), false))"
    return "SELECT merk, handelsbenaming, vehicle_type_group, primary_fuel, vehicle_count FROM mseg WHERE " + " AND ".join(map(of, text.split()))


def _indexed(spark, sf_dir, text):
    base = shared_dir(spark, "search")
    columns = [P.MERK, P.HANDELSBENAMING]
    seg = segments.model_segments(fact_of(sources(spark, sf_dir)), T.model).select(*P.MODEL_KEYS, "vehicle_count")
    view = publish.persist_table(seg, f"{base}/view")
    return search_index.search(search_index.build(view, P.MODEL_KEYS, columns, f"{base}/index"), view, columns, text)


@register("p28_indexed_search", lambda: O.q(_search_sql(SEARCHES["p28_indexed_search"]), T))
def p28_indexed_search(spark, sf_dir):
    """Several terms, by the index of three-character pieces."""
    return _indexed(spark, sf_dir, SEARCHES["p28_indexed_search"])


@register("p28_indexed_short", lambda: O.q(_search_sql(SEARCHES["p28_indexed_short"]), T))
def p28_indexed_short(spark, sf_dir):
    """Terms shorter than a piece."""
    return _indexed(spark, sf_dir, SEARCHES["p28_indexed_short"])


# Plates as typed: two of them twice, one too short, one unknown, one empty.
TYPED = ["10-01", "1 234", "15.99", "2000", "999", "77-77", None, "1001", "1 11 1"]


@register("j10_stored_history", lambda: O.q("""
SELECT r.kenteken, r.report_rank,
       substr(r.meld_datum_door_keuringsinstantie, 7, 2) || '-' || substr(r.meld_datum_door_keuringsinstantie, 5, 2) || '-'
         || substr(r.meld_datum_door_keuringsinstantie, 1, 4) AS report_date,
       r.meld_tijd_door_keuringsinstantie, coalesce(contains(r.soort_melding_ki_omschrijving, 'Goedgekeurd'), false) AS passed,
       d.defect_rank, d.gebrek_identificatie AS defect_code, CASE WHEN c.d <> '' THEN c.d END AS description,
       d.aantal_gebreken_geconstateerd AS defect_count
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kenteken ORDER BY meld_datum_door_keuringsinstantie DESC,
        meld_tijd_door_keuringsinstantie DESC, soort_melding_ki_omschrijving) AS INTEGER) AS report_rank FROM inspections) r
LEFT JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY kenteken ORDER BY meld_datum_door_keuringsinstantie DESC,
        meld_tijd_door_keuringsinstantie DESC, gebrek_identificatie, aantal_gebreken_geconstateerd NULLS FIRST) AS INTEGER) AS defect_rank
      FROM defects) d
  ON r.kenteken = d.kenteken AND r.meld_datum_door_keuringsinstantie = d.meld_datum_door_keuringsinstantie
LEFT JOIN (SELECT gebrek_identificatie AS g, coalesce(max(gebrek_omschrijving), '') AS d FROM codes GROUP BY 1) c
  ON d.gebrek_identificatie = c.g
WHERE r.kenteken IN ('1001', '1234', '1599', '2000', '7777', '1111')""", T))
def j10_stored_history(spark, sf_dir):
    """The history of a few typed plates from tables stored for that."""
    src = sources(spark, sf_dir)
    store = PlateStore(spark, shared_dir(spark, "plates"))
    store.write(src)
    return store.history(TYPED, src.codes)
