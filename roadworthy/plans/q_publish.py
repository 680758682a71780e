"""Registered queries: publishing shapes and display formatting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions import formatting as FM
from roadworthy.operators import defects as D
from roadworthy.operators import segments
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, fact_of, register, sources
from roadworthy.plans.pipeline import publish_all, run_statistics
from roadworthy.plans.q_defects import INDEX_CTE, JOINED_CTE
from roadworthy.session import shared_dir, temporary_dir
from roadworthy.sources import publish


def _per_age_sql(seg: str, keys: str) -> str:
    """Segments of one level with their per-age rows beside them (null where a segment has none)."""
    on = " AND ".join(f"s.{k} = a.{k}" for k in keys.split(", "))
    cols = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""
SELECT {cols}, s.vehicle_count AS segment_vehicles, s.defects_per_vehicle_year, CAST(a.age_at_inspection AS VARCHAR) AS age,
       a.vehicle_count, a.total_inspections, a.total_defects, a.avg_defects_per_inspection
FROM {seg} s LEFT JOIN (
  SELECT {keys}, age_at_inspection, count(DISTINCT kenteken) AS vehicle_count, count(*) AS total_inspections,
         CAST(sum(defect_count) AS DOUBLE) AS total_defects, {O.R('sum(defect_count) / count(*)', 4)} AS avg_defects_per_inspection
  FROM fact GROUP BY {keys}, age_at_inspection HAVING count(DISTINCT kenteken) >= {T.age_bracket}) a ON {on}"""


def _unnested(document, keys):
    """A segment document's per-age map as rows again."""
    rows = document.select(*keys, F.col("vehicle_count").alias("segment_vehicles"), "defects_per_vehicle_year",
                           F.explode_outer("per_year_stats").alias("age", "s"))
    return rows.select(*keys, "segment_vehicles", "defects_per_vehicle_year", "age", "s.vehicle_count",
                       "s.total_inspections", "s.total_defects", "s.avg_defects_per_inspection")


@register("a10_nested_per_age", lambda: O.q(_per_age_sql("bseg", "merk, vehicle_type_group, primary_fuel"), T))
def a10_nested_per_age(spark, sf_dir):
    """A10 + J7: brand segments with their per-age map, unnested to compare it."""
    fact = fact_of(sources(spark, sf_dir))
    seg = segments.brand_segments(fact, T.brand)
    nested = segments.nest_per_age(seg, segments.per_age(fact, P.BRAND_KEYS, T.age_bracket), P.BRAND_KEYS)
    return _unnested(nested, P.BRAND_KEYS)


@register("s14_document_content", lambda: O.q(
    _per_age_sql("mseg", "merk, handelsbenaming, vehicle_type_group, primary_fuel"), T))
def s14_document_content(spark, sf_dir):
    """S13 + S14: the model document written as JSON and read back with its schema, unnested."""
    from pyspark.sql import types as ST

    fact = fact_of(sources(spark, sf_dir))
    seg = segments.model_segments(fact, T.model)
    nested = segments.nest_per_age(seg, segments.per_age(fact, P.MODEL_KEYS, T.age_bracket), P.MODEL_KEYS)
    path = publish.write_json(nested, shared_dir(spark, "model-document"))
    schema = ST.StructType([*[f for f in seg.schema], ST.StructField("per_year_stats", publish.PER_YEAR)])
    return _unnested(publish.read_document(spark, path, schema), P.MODEL_KEYS)


@register("s13_json_documents", lambda: O.q("""
SELECT 'brand_stats' AS document, count(*) AS lines, CAST(sum(total_inspections) AS BIGINT) AS content FROM bseg
UNION ALL SELECT 'model_stats', count(*), CAST(sum(total_inspections) AS BIGINT) FROM mseg
UNION ALL SELECT 'rankings', 1, NULL UNION ALL SELECT 'metadata', 1, NULL UNION ALL SELECT 'defect_stats', 1, NULL
UNION ALL SELECT 'brand_defect_breakdown', count(DISTINCT merk), CAST(sum("count") AS BIGINT) FROM bbd
UNION ALL SELECT 'model_defect_breakdown', count(DISTINCT coalesce(merk || '|' || handelsbenaming, '~')), CAST(sum("count") AS BIGINT) FROM mbd
UNION ALL SELECT 'defect_codes', count(*), CAST(sum(length(description)) AS BIGINT) FROM idx""", T, JOINED_CTE + INDEX_CTE))
def s13_json_documents(spark, sf_dir):
    """S13 + S14: write all eight documents, read each back with its schema and
    report its lines and a total of what they hold."""
    with temporary_dir(spark, "run") as work:
        out = run_statistics(spark, sources(spark, sf_dir), T, base_dir=work)
        paths = publish_all(spark, out, shared_dir(spark, "documents"))
    defects = F.aggregate(F.map_values("defects"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    content = {
        "brand_stats": ("total_inspections bigint", F.col("total_inspections")),
        "model_stats": ("total_inspections bigint", F.col("total_inspections")),
        "brand_defect_breakdown": ("defects map<string,bigint>", defects),
        "model_defect_breakdown": ("defects map<string,bigint>", defects),
        "defect_codes": ("description string", F.length("description").cast("bigint")),
    }
    parts = []
    for name, path in paths.items():
        schema, total = content.get(name, ("none string", F.lit(None).cast("bigint")))
        lines = spark.read.schema(schema).json(path)
        parts.append(lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(total).alias("content")).select(
            F.lit(name).alias("document"), "lines", "content"))
    return reduce(DataFrame.unionByName, parts)


@register("p13_model_key", lambda: O.q(
    "SELECT merk || '|' || handelsbenaming AS key, defect_code, CAST(sum(\"count\") AS BIGINT) AS \"count\" FROM mbd GROUP BY ALL",
    T, JOINED_CTE))
def p13_model_key(spark, sf_dir):
    """The breakdown document's keys; models without a name share the null key."""
    src = sources(spark, sf_dir)
    doc = publish.breakdown_document(D.model_breakdown(src.defects, fact_of(src)), [P.MERK, P.HANDELSBENAMING])
    return doc.select("key", F.explode("defects").alias("defect_code", "count"))


def _initcap_sql(c: str) -> str:
    # words are split on single spaces only, as the display helper does
    return (f"array_to_string(list_transform(string_split(lower({c}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


@register("p32_name_casing", lambda: O.q(f"""
SELECT kenteken, {_initcap_sql('merk')} AS brand_display, {_initcap_sql('handelsbenaming')} AS model_display
FROM vehicles""", T))
def p32_name_casing(spark, sf_dir):
    """P32: 'GOLF VARIANT' -> 'Golf Variant'."""
    v = sources(spark, sf_dir).vehicles
    return v.select(P.KENTEKEN, FM.name_casing(F.col(P.MERK)).alias("brand_display"),
                    FM.name_casing(F.col(P.HANDELSBENAMING)).alias("model_display"))


@register("p33_formatting", lambda: O.q(f"""
SELECT merk, vehicle_type_group, primary_fuel,
       replace(format('{{:,}}', vehicle_count), ',', ' ') AS vehicles_display,
       translate(format('{{:,.2f}}', {O.R('avg_defects_per_inspection', 2)}), ',.', '.,') AS average_display,
       printf('%.1f', {O.R('inspections_with_defects / total_inspections * 100', 1)}) || '%' AS found_rate_display
FROM bseg""", T))
def p33_formatting(spark, sf_dir):
    seg = segments.brand_segments(fact_of(sources(spark, sf_dir)), T.brand)
    return seg.select(
        *P.BRAND_KEYS,
        FM.number_format(F.col("vehicle_count")).alias("vehicles_display"),
        FM.decimal_format(F.col("avg_defects_per_inspection"), 2).alias("average_display"),
        FM.percentage_format(F.col("inspections_with_defects") / F.col("total_inspections")).alias("found_rate_display"),
    )


@register("s15_republished_segments", lambda: O.q(
    "SELECT merk, vehicle_type_group, primary_fuel, vehicle_count, total_inspections, defects_per_vehicle_year FROM bseg", T))
def s15_republished_segments(spark, sf_dir):
    """S13 + S15: a document published from an earlier state of the inputs, brought up to the present one
    (only its changed prefixes are rewritten), and read back."""
    from dataclasses import replace

    src = sources(spark, sf_dir)
    base, work = shared_dir(spark, "published"), shared_dir(spark, "staged")
    before = replace(src, defects=src.defects.where(F.substring(P.KENTEKEN, 1, 1) != "1"))
    for i, state in enumerate((before, src)):
        seg = segments.brand_segments(fact_of(state), T.brand).select(
            *P.BRAND_KEYS, "vehicle_count", "total_inspections", "defects_per_vehicle_year")
        publish.publish_changed(seg, "brand_stats", base, f"{work}/{i}", P.MERK)
    return publish.read_published(spark, f"{base}/brand_stats", seg.schema)
