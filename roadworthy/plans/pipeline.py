"""Whole-pipeline composition (E1: batch statistics).

``run_statistics`` builds the fact table once, writes it to the shared
checkpoint folder (cuts lineage and survives executor loss: a lost partition
is re-read from the written table, not recomputed from the raw inputs) and
derives every published output from that one table.  The outputs are lazy
DataFrames; ``publish`` writes them as JSON-lines documents.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from roadworthy import params as P
from roadworthy.operators import defects as D
from roadworthy.operators import facts, profile, rankings, segments
from roadworthy.operators import fuel as FU
from roadworthy.session import configure, shared_dir
from roadworthy.sources import publish
from roadworthy.sources.bindings import Sources, bind
from roadworthy.sources.fact_store import FactStore


def build_fact(src: Sources, on_bad: str = "raise", with_coverage: bool = False) -> DataFrame:
    return facts.inspection_stats(src.inspections, src.vehicles, src.defects, src.fuel, on_bad, with_coverage)


def flagship(spark: SparkSession, sf_dir: str, t: P.Thresholds = P.DEFAULT) -> DataFrame:
    """Brands ranked by defects per vehicle-year (both lists)."""
    configure(spark)
    fact = build_fact(bind(spark, sf_dir))
    seg = segments.brand_segments(fact, t.brand)
    return rankings.brand_ranking(seg, t.brand_ranking, t.ranking_size)


@dataclass
class Outputs:
    fact: DataFrame
    brand_segments: DataFrame
    model_segments: DataFrame
    brand_per_age: DataFrame
    model_per_age: DataFrame
    brand_ranking: DataFrame
    model_ranking: DataFrame
    summary: DataFrame
    metadata: DataFrame
    yearly_trend: DataFrame
    fleet_age: DataFrame
    fuel_domain: DataFrame
    top_defects: DataFrame
    defect_headline: DataFrame
    brand_breakdown: DataFrame
    model_breakdown: DataFrame
    code_index: DataFrame
    brand_fuel: DataFrame
    model_fuel: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self.__dict__.items() if k != "fact"}


def run_statistics(spark: SparkSession, src: Sources, t: P.Thresholds = P.DEFAULT,
                   checkpoint: bool = True, exposure: str = "age", on_bad: str = "raise",
                   base_dir: str | None = None, store: FactStore | None = None) -> Outputs:
    """All outputs of one batch run.

    ``on_bad="one"`` replaces junk quantities, prices and dates instead of
    ending the run (``facts.rejected_values`` lists them).  Intermediates go
    below ``base_dir``; who gives it removes it when the outputs are written
    (``session.temporary_dir``), else they stay in a fresh shared folder.

    With ``checkpoint`` the fact is written once (S11/S12: zstd Parquet, rows
    sorted by year within each task, which gives each file tight year ranges
    without the small files of ``partitionBy``), and so are the few tables
    every later output reads (model-level moments by age,
    unfiltered, model-level defect breakdown, top codes, yearly trend, model-level fuel counts).  Segments of either
    level, per-age rows, defect and fuel breakdowns are exact roll-ups of these, so the fact is scanned once per grouping level instead of once per
    output.  Without ``checkpoint`` everything stays one lazy plan.
    ``exposure="coverage"`` counts vehicle-years as documented coverage years (D1).

    With a ``store`` (S12) the fact is not built: the store is brought up to the
    inputs, prefix by prefix where they changed, and its fact is read; as that lies in
    buckets by plate, the moments need no shuffle of it.
    """
    configure(spark)
    base_dir = (base_dir or shared_dir(spark, "run")) if checkpoint else None

    def keep(df: DataFrame, name: str, sort_within=()) -> DataFrame:
        return publish.persist_table(df, f"{base_dir}/{name}", sort_within=sort_within) if checkpoint else df

    def keep_all(plans: dict[str, DataFrame], sort_within: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
        # Independent jobs are submitted together (one driver thread each) so
        # the scheduler fills idle executors with tasks of the other jobs.
        if not checkpoint:
            return plans
        sorts = sort_within or {}
        with ThreadPoolExecutor(max_workers=len(plans)) as pool:
            futs = {k: pool.submit(keep, v, k, sorts.get(k, ())) for k, v in plans.items()}
            return {k: f.result() for k, f in futs.items()}

    if store is not None and exposure != "age":
        raise ValueError("the stored fact has no coverage years")
    plans = {"model_fuel": FU.fuel_by_model(src.fuel, src.vehicles)}
    if store is None:
        plans["inspection_stats"] = build_fact(src, on_bad, with_coverage=exposure == "coverage")
    else:
        store.refresh(src, on_bad)
    # The fuel counts do not depend on the fact: both are built at once.
    done = keep_all(plans, {"inspection_stats": ["insp_year"]})
    fact, model_fuel_long = store.fact() if store else done["inspection_stats"], done["model_fuel"]
    # The only readers of the fact: moments by age, the defects' join and the yearly trend.
    with ThreadPoolExecutor(max_workers=1) as pool:
        others = pool.submit(keep_all, {
            "yearly_trend": profile.yearly_trend(fact, t.yearly_trend),
            "model_breakdown": D.model_breakdown(src.defects, fact, on_bad=on_bad),
            "top_defects": D.top_defects(src.defects, src.codes, t.top_codes, on_bad=on_bad),
        })
        # The moments of both levels follow from the moments by age, while the other jobs run.
        ages = keep(segments.age_moments(fact, exposure, clustered=store is not None), "age_moments")
        both = keep_all({"brand_moments": segments.moments_of(ages, P.BRAND_KEYS), "model_moments": segments.moments_of(ages)})
        level = others.result()
    model_bd, age_base, moments = level["model_breakdown"], segments.per_age_of(ages), both["model_moments"]
    bseg = segments.brand_segments_of(both["brand_moments"], t.brand, exposure)
    mseg = segments.model_segments_of(moments, t.model, exposure)
    top = level["top_defects"]
    summary = profile.dataset_summary(moments)
    return Outputs(
        fact=fact,
        brand_segments=bseg,
        model_segments=mseg,
        brand_per_age=segments.per_age_rollup(age_base, P.BRAND_KEYS, t.age_bracket),
        model_per_age=segments.per_age_rollup(age_base, P.MODEL_KEYS, t.age_bracket),
        brand_ranking=rankings.brand_ranking(bseg, t.brand_ranking, t.ranking_size),
        model_ranking=rankings.model_ranking(mseg, t.model_ranking, t.ranking_size),
        summary=summary,
        metadata=profile.metadata_flat(bseg, mseg, summary, segments.age_bounds(age_base), t),
        yearly_trend=level["yearly_trend"],
        fleet_age=profile.fleet_age(age_base, t.fleet_age_vehicles, t.fleet_age_min, t.fleet_age_max),
        fuel_domain=profile.fuel_domain(moments),
        top_defects=top,
        defect_headline=D.defect_headline(top, summary.select("total_inspections")),
        brand_breakdown=D.breakdown_rollup(model_bd),
        model_breakdown=model_bd,
        code_index=D.code_index(src.codes),
        brand_fuel=FU.pivot_breakdown(FU.fuel_by_brand(model_fuel_long), [P.MERK]),
        model_fuel=FU.pivot_breakdown(model_fuel_long, [P.MERK, P.HANDELSBENAMING]),
    )


def documents(out: Outputs) -> dict[str, DataFrame]:
    """The eight published documents in their publishing shapes."""
    brand_docs = segments.nest_per_age(
        FU.attach_breakdown(out.brand_segments, out.brand_fuel, [P.MERK]), out.brand_per_age, P.BRAND_KEYS)
    model_docs = segments.nest_per_age(
        FU.attach_breakdown(out.model_segments, out.model_fuel, [P.MERK, P.HANDELSBENAMING]),
        out.model_per_age, P.MODEL_KEYS)
    return {
        # Segments ordered by defects per vehicle-year (range-partitioned sort)
        "brand_stats": segments.by_rate(publish.with_fuel_struct(brand_docs), P.BRAND_KEYS),
        "model_stats": segments.by_rate(publish.with_fuel_struct(model_docs), P.MODEL_KEYS),
        "rankings": publish.rankings_document(out.brand_ranking, out.model_ranking),
        "metadata": publish.metadata_document(out.metadata, out.yearly_trend, out.fleet_age, out.fuel_domain),
        "defect_stats": publish.defect_stats_document(out.top_defects, out.defect_headline),
        "brand_defect_breakdown": publish.breakdown_document(out.brand_breakdown, [P.MERK]),
        "model_defect_breakdown": publish.breakdown_document(out.model_breakdown, [P.MERK, P.HANDELSBENAMING]),
        "defect_codes": out.code_index,
    }


def publish_all(spark: SparkSession, out: Outputs, base: str | None = None) -> dict[str, str]:
    """Write all documents (independent jobs, submitted together);
    returns name -> path."""
    base = base or shared_dir(spark, "documents")
    docs = documents(out)
    with ThreadPoolExecutor(max_workers=len(docs)) as pool:
        futs = {k: pool.submit(publish.write_json, df, f"{base}/{k}") for k, df in docs.items()}
        return {k: f.result() for k, f in futs.items()}


#: The column whose first character is a document's prefix; documents of one row have none.
DOCUMENT_KEYS = {
    "brand_stats": P.MERK, "model_stats": P.MERK, "brand_defect_breakdown": "key", "model_defect_breakdown": "key",
    "defect_codes": "defect_code",
}


def publish_changed_all(spark: SparkSession, out: Outputs, base: str, work: str | None = None) -> dict[str, list[str]]:
    """S13 + S15: rewrite only the documents' prefixes whose content changed;
    returns the rewritten prefixes of every document (none: not touched)."""
    work = work or shared_dir(spark, "staged")
    docs = documents(out)
    with ThreadPoolExecutor(max_workers=len(docs)) as pool:
        futs = {k: pool.submit(publish.publish_changed, df, k, base, f"{work}/staged", DOCUMENT_KEYS.get(k)) for k, df in docs.items()}
        return {k: f.result() for k, f in futs.items()}
