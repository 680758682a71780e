"""Registered queries: defect statistics, breakdowns, classifier, filter modes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.operators import defects as D
from roadworthy.operators.profile import combine_rows
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, fact_of, positions, register, sources

# Codes are shifted by 200 for the classifier queries so the small code range
# of the test tables overlaps the wear-and-tear list (FIXTURES.md part B).
OFF = 200
OVERRIDES = {"215": True, "241": True, "262": False}
TOGGLED = ("207", "262", "AC1")
# Fixed values, written here a second time so that the check does not rest on the classifier's own list.
CHECK_CODES = {
    "tires": "203 204 205 206 207 208 209 210 211 212 213 214 215 216 217 218 701 874 875 876 877 992 AC1 RA4",
    "lighting": "475 487 497 507 532 556 571 572 573 584 589 601 516 517 518 519 520 521 522 524 598 542 576 710",
    "wipers": "388 389 391 392 393",
    "brake_wear": "289 290 311 312 313 AC5 705",
    "shock_absorbers": "241 AC2 702",
    "exhaust_wear": "115 116 117",
    "administrative": "AC4 704",
}
SEARCH = "21"


def _sql_clean(c: str) -> str:
    return f"upper({O.STRIP(c)})"


def sql_is_wear(c: str) -> str:
    cc = _sql_clean(c)
    codes = ", ".join(f"'{x}'" for line in CHECK_CODES.values() for x in line.split())
    return f"coalesce(({cc} IN ({codes}) OR starts_with({cc}, 'AP') OR starts_with({cc}, 'OP')), false)"


def sql_category(c: str) -> str:
    cc = _sql_clean(c)
    whens = " ".join(
        f"WHEN {cc} IN ({', '.join(repr(x) for x in codes.split())}) THEN '{cat}'" for cat, codes in CHECK_CODES.items()
    )
    return f"CASE {whens} WHEN starts_with({cc}, 'AP') OR starts_with({cc}, 'OP') THEN 'administrative' END"


def sql_reliability(c: str, overrides: dict | None = None) -> str:
    base = f"NOT {sql_is_wear(c)}"
    if not overrides:
        return f"({base})"
    whens = " ".join(f"WHEN {c} = '{k}' THEN {str(v).lower()}" for k, v in overrides.items())
    return f"(CASE {whens} ELSE {base} END)"


TOP_CTE = f"""
, cc AS (
  SELECT gebrek_identificatie, {O.SUMI("CAST(coalesce(aantal_gebreken_geconstateerd, '1') AS BIGINT)")} AS "count"
  FROM defects GROUP BY gebrek_identificatie),
top0 AS (SELECT * FROM cc ORDER BY "count" DESC, gebrek_identificatie ASC LIMIT {{k}}),
top1 AS (SELECT *, {O.R('"count" / sum("count") OVER () * 100', 2)} AS percentage FROM top0),
top AS (
  SELECT t.gebrek_identificatie AS defect_code,
         coalesce(c.gebrek_omschrijving, 'Onbekend gebrek') AS defect_description, t."count", t.percentage
  FROM top1 t LEFT JOIN (SELECT gebrek_identificatie, max(gebrek_omschrijving) AS gebrek_omschrijving FROM codes GROUP BY 1) c
    ON t.gebrek_identificatie = c.gebrek_identificatie)"""


def top_cte(k: int = T.top_codes) -> str:
    return TOP_CTE.replace("{k}", str(k))


JOINED_CTE = f"""
, dj AS (
  SELECT d.kenteken, d.gebrek_identificatie, CAST(coalesce(d.aantal_gebreken_geconstateerd, '1') AS BIGINT) AS q,
         f.merk, f.handelsbenaming
  FROM defects d JOIN fact f ON d.kenteken = f.kenteken
   AND d.meld_datum_door_keuringsinstantie = f.meld_datum_door_keuringsinstantie
   AND {O.NTIME('d.meld_tijd_door_keuringsinstantie')} = f.meld_tijd_door_keuringsinstantie),
bbd AS (SELECT merk, gebrek_identificatie AS defect_code, {O.SUMI('q')} AS "count" FROM dj GROUP BY 1, 2),
mbd AS (SELECT merk, handelsbenaming, gebrek_identificatie AS defect_code, {O.SUMI('q')} AS "count"
        FROM dj GROUP BY 1, 2, 3)"""

INDEX_CTE = """
, idx AS (
  SELECT gebrek_identificatie AS defect_code, coalesce(max(gebrek_omschrijving), '') AS description
  FROM codes WHERE gebrek_identificatie IS NOT NULL AND gebrek_identificatie <> '' GROUP BY 1)"""


def excluded_sql(toggled=TOGGLED) -> str:
    base = sql_is_wear("defect_code")
    tog = ", ".join(f"'{x}'" for x in toggled)
    return f"""
, excl AS (
  SELECT defect_code FROM idx
  WHERE CASE WHEN defect_code IN ({tog}) THEN NOT {base} ELSE {base} END)"""


@register("a16_top_defects", lambda: O.q("SELECT * FROM top", T, top_cte()))
def a16_top_defects(spark, sf_dir):
    src = sources(spark, sf_dir)
    return D.top_defects(src.defects, src.codes, T.top_codes)


@register("a17_defect_headline", lambda: O.q(f"""
SELECT {O.SUMI('"count"')} AS total_defects, (SELECT CAST(sum("count") AS BIGINT) FROM cc) AS all_defects, (SELECT count(*) FROM fact) AS total_inspections,
       CASE WHEN (SELECT count(*) FROM fact) > 0
            THEN {O.R('sum("count") / (SELECT count(*) FROM fact)', 2)} ELSE 0.0 END AS avg_defects_per_inspection
FROM top""", T, top_cte()))
def a17_defect_headline(spark, sf_dir):
    src = sources(spark, sf_dir)
    top = D.top_defects(src.defects, src.codes, T.top_codes)
    insp = fact_of(src).agg(F.count(F.lit(1)).alias("total_inspections"))
    every = D.code_counts(src.defects).agg(F.sum("count").alias("all_defects"))
    return combine_rows(D.defect_headline(top, insp), every)


@register("a18_brand_breakdown", lambda: O.q("SELECT * FROM bbd", T, JOINED_CTE))
def a18_brand_breakdown(spark, sf_dir):
    src = sources(spark, sf_dir)
    return D.brand_breakdown(src.defects, fact_of(src))


@register("a18_model_breakdown", lambda: O.q("SELECT * FROM mbd", T, JOINED_CTE))
def a18_model_breakdown(spark, sf_dir):
    src = sources(spark, sf_dir)
    return D.model_breakdown(src.defects, fact_of(src))


@register("j4_raw_time_breakdown", lambda: O.q("""
SELECT f.merk, d.gebrek_identificatie AS defect_code,
       CAST(sum(CAST(coalesce(d.aantal_gebreken_geconstateerd, '1') AS BIGINT)) AS BIGINT) AS "count"
FROM defects d JOIN fact f ON d.kenteken = f.kenteken
 AND d.meld_datum_door_keuringsinstantie = f.meld_datum_door_keuringsinstantie
 AND d.meld_tijd_door_keuringsinstantie = f.meld_tijd_door_keuringsinstantie
GROUP BY 1, 2""", T))
def j4_raw_time_breakdown(spark, sf_dir):
    """Parity mode of J4 (D3): raw time against normalised time."""
    src = sources(spark, sf_dir)
    return D.brand_breakdown(src.defects, fact_of(src), raw_time=True)


@register("a19_code_index", lambda: O.q("SELECT * FROM idx", T, INDEX_CTE))
def a19_code_index(spark, sf_dir):
    return D.code_index(sources(spark, sf_dir).codes)


@register("p19_wear_classifier", lambda: O.q(f"""
SELECT defect_code, {sql_category('defect_code')} AS category, {sql_reliability('defect_code')} AS is_reliability
FROM idx""", T, INDEX_CTE, OFF))
def p19_wear_classifier(spark, sf_dir):
    return D.classify_codes(D.code_index(sources(spark, sf_dir, OFF).codes))


@register("p20_overrides", lambda: O.q(f"""
SELECT *, {sql_reliability('defect_code', OVERRIDES)} AS computed_is_reliability FROM top""", T, top_cte(), OFF))
def p20_overrides(spark, sf_dir):
    src = sources(spark, sf_dir, OFF)
    return D.with_reliability(D.top_defects(src.defects, src.codes, T.top_codes), OVERRIDES)


@register("p21_inclusion_set", lambda: O.q("SELECT * FROM excl", T, INDEX_CTE + excluded_sql(), OFF))
def p21_inclusion_set(spark, sf_dir):
    idx = D.code_index(sources(spark, sf_dir, OFF).codes)
    return D.excluded_codes(idx, "reliability", toggled=TOGGLED)


@register("a32_filtered_ratio", lambda: O.q(f"""
SELECT merk, {O.SUMI('"count"')} AS total_count,
       {O.SUMI('CASE WHEN e.defect_code IS NULL THEN "count" ELSE 0 END')} AS included_count,
       {O.R('CASE WHEN sum("count") <= 0 THEN 1.0 ELSE sum(CASE WHEN e.defect_code IS NULL THEN "count" ELSE 0 END) / sum("count") END', 6)}
         AS defect_ratio
FROM bbd b LEFT JOIN excl e ON b.defect_code = e.defect_code GROUP BY merk""",
                                              T, JOINED_CTE + INDEX_CTE + excluded_sql(), OFF))
def a32_filtered_ratio(spark, sf_dir):
    src = sources(spark, sf_dir, OFF)
    bd = D.brand_breakdown(src.defects, fact_of(src))
    ex = D.excluded_codes(D.code_index(src.codes), "reliability", toggled=TOGGLED)
    return D.filtered_ratio(bd, [P.MERK], ex, "reliability")


@register("a43_reliability_summary", lambda: O.q(f"""
SELECT {O.SUMI(f'CASE WHEN {sql_reliability("defect_code")} THEN "count" ELSE 0 END')} AS reliability_count,
       {O.SUMI(f'CASE WHEN {sql_reliability("defect_code")} THEN 0 ELSE "count" END')} AS wear_count,
       {O.SUMI('"count"')} AS total_count,
       CASE WHEN sum("count") > 0
            THEN {O.R(f'sum(CASE WHEN {sql_reliability("defect_code")} THEN "count" ELSE 0 END) / sum("count") * 100', 1)}
            ELSE 0.0 END AS reliability_percentage
FROM top""", T, top_cte(), OFF))
def a43_reliability_summary(spark, sf_dir):
    src = sources(spark, sf_dir, OFF)
    return D.reliability_summary(D.top_defects(src.defects, src.codes, T.top_codes))


@register("a44_reliability_chart", lambda: O.q(f"""
SELECT defect_code AS name, defect_description AS description, "count", percentage FROM top
WHERE {sql_reliability('defect_code')} ORDER BY "count" DESC, defect_code ASC LIMIT {P.RELIABILITY_CHART_ITEMS}""",
                                                 T, top_cte(), OFF))
def a44_reliability_chart(spark, sf_dir):
    src = sources(spark, sf_dir, OFF)
    return D.reliability_chart(D.top_defects(src.defects, src.codes, T.top_codes))


@register("a45_code_counts", lambda: O.q("""
SELECT (SELECT count(*) FROM idx) - (SELECT count(*) FROM excl) AS active_defect_count,
       (SELECT count(*) FROM idx) AS total_defect_count""", T, INDEX_CTE + excluded_sql(), OFF))
def a45_code_counts(spark, sf_dir):
    idx = D.code_index(sources(spark, sf_dir, OFF).codes)
    return D.code_counts_summary(idx, D.excluded_codes(idx, "reliability", toggled=TOGGLED))


@register("p27_defect_search", lambda: O.q(f"""
SELECT *, {sql_reliability('defect_code')} AS computed_is_reliability FROM top
WHERE {sql_reliability('defect_code')}
  AND (lower(defect_code) LIKE '%{SEARCH}%' OR lower(defect_description) LIKE '%{SEARCH}%')""",
                                             T, top_cte(), OFF))
def p27_defect_search(spark, sf_dir):
    src = sources(spark, sf_dir, OFF)
    return D.defect_search(D.top_defects(src.defects, src.codes, T.top_codes), SEARCH, "reliability")


@register("p29_code_search", lambda: O.q(f"""
SELECT *, CAST(row_number() OVER (ORDER BY defect_code) AS INTEGER) AS position
FROM idx WHERE lower(defect_code) LIKE '%{SEARCH}%' OR lower(description) LIKE '%{SEARCH}%'""",
                                           T, INDEX_CTE, OFF))
def p29_code_search(spark, sf_dir):
    return positions(D.code_search(D.code_index(sources(spark, sf_dir, OFF).codes), SEARCH))


@register("p21_modes", lambda: O.q(f"""
SELECT 'custom' AS mode, defect_code FROM idx WHERE defect_code IN ('207', 'RA4') AND defect_code <> 'RA4' OR defect_code = '262'
UNION ALL
SELECT 'bulk', defect_code FROM idx WHERE lower(defect_code) LIKE '%{SEARCH}%' OR lower(description) LIKE '%{SEARCH}%'
UNION ALL
SELECT 'reliability', defect_code FROM idx WHERE {sql_is_wear('defect_code')}""", T, INDEX_CTE, OFF))
def p21_modes(spark, sf_dir):
    """Excluded codes of the modes (``all`` leaves none out) and the codes of a bulk action."""
    idx = D.code_index(sources(spark, sf_dir, OFF).codes)
    parts = {"all": D.excluded_codes(idx, "all"), "custom": D.excluded_codes(idx, "custom", ("207", "RA4"), ("RA4", "262")),
             "bulk": D.bulk_toggle_codes(idx, SEARCH), "reliability": D.excluded_codes(idx, "reliability")}
    return reduce(DataFrame.unionByName, [df.select(F.lit(mode).alias("mode"), "defect_code") for mode, df in parts.items()])


@register("a16_top_defects_of_all", lambda: O.q(f"""
SELECT * REPLACE ({O.R('"count" / (SELECT sum("count") FROM cc) * 100', 2)} AS percentage) FROM top""", T, top_cte(7)))
def a16_top_defects_of_all(spark, sf_dir):
    """Shares of all defects, not of the listed ones."""
    src = sources(spark, sf_dir)
    return D.top_defects(src.defects, src.codes, 7, denominator="all")


@register("p20_stored_flag", lambda: O.q(f"""
SELECT defect_code, defect_description, "count", percentage, stored,
       CASE WHEN defect_code = '215' THEN true ELSE coalesce(stored, {sql_reliability('defect_code')}) END AS computed_is_reliability
FROM (SELECT *, CASE "count" % 3 WHEN 0 THEN true WHEN 1 THEN false END AS stored FROM top)""", T, top_cte(), OFF))
def p20_stored_flag(spark, sf_dir):
    """P20: override before stored flag before classifier."""
    src = sources(spark, sf_dir, OFF)
    third = F.col("count") % 3
    top = D.top_defects(src.defects, src.codes, T.top_codes).withColumn(
        "stored", F.when(third == 0, True).when(third == 1, False))
    return D.with_reliability(top, {"215": True}, stored="stored")


@register("a46_top_defects_per_brand", lambda: O.q(f"""
SELECT * FROM (
  SELECT *, CAST(sum("count") OVER (PARTITION BY merk) AS BIGINT) AS group_total,
         CAST(row_number() OVER (PARTITION BY merk ORDER BY "count" DESC, defect_code ASC) AS INTEGER) AS rank
  FROM bbd) WHERE rank <= 5""".replace("SELECT * FROM (", "SELECT *, " + O.R('"count" / group_total * 100', 2)
                                        + " AS share FROM ("), T, JOINED_CTE))
def a46_top_defects_per_brand(spark, sf_dir):
    src = sources(spark, sf_dir)
    return D.top_defects_per_group(D.brand_breakdown(src.defects, fact_of(src)), [P.MERK], 5)


# Code list with letters, accents and both cases, made of the codes' digits.
_LETTERS = ("0123456789", "aÁbÉcëdöZé")
_NAMED_IDX = INDEX_CTE + f"""
, named AS (SELECT translate(defect_code, '{_LETTERS[0]}', '{_LETTERS[1]}') AS defect_code, description FROM idx)"""


@register("p29_locale_order", lambda: O.q("""
SELECT *, CAST(row_number() OVER (ORDER BY defect_code COLLATE nl, defect_code) AS INTEGER) AS position FROM named""", T, _NAMED_IDX, OFF))
def p29_locale_order(spark, sf_dir):
    """The whole code list in the order of a locale, accents beside their letters."""
    idx = D.code_index(sources(spark, sf_dir, OFF).codes).withColumn("defect_code", F.translate("defect_code", *_LETTERS))
    return positions(D.code_search(idx, "", "nl"))


@register("p29_locale_search", lambda: O.q("""
SELECT *, CAST(row_number() OVER (ORDER BY defect_code COLLATE nl, defect_code) AS INTEGER) AS position
FROM named WHERE contains(lower(defect_code), 'éa') OR contains(lower(description), 'éa')""", T, _NAMED_IDX, OFF))
def p29_locale_search(spark, sf_dir):
    """Search by collation; the case of accented letters does not matter."""
    idx = D.code_index(sources(spark, sf_dir, OFF).codes).withColumn("defect_code", F.translate("defect_code", *_LETTERS))
    return positions(D.code_search(idx, "ÉA", "UNICODE"))


@register("t9_percentage_order", lambda: O.q(f"""
SELECT *, {sql_reliability('defect_code')} AS computed_is_reliability,
       CAST(row_number() OVER (ORDER BY percentage, defect_code) AS INTEGER) AS position FROM top""", T, top_cte(), OFF))
def t9_percentage_order(spark, sf_dir):
    """The defect list by percentage, least first."""
    src = sources(spark, sf_dir, OFF)
    top = D.top_defects(src.defects, src.codes, T.top_codes)
    return positions(D.defect_search(top, "", sort_key="percentage", ascending=True))
