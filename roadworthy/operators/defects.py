"""Defect statistics, breakdowns and the reliability filter (A16-A19, A32,
A43-A46, J4, J6, P18-P21, P27, P29, T3).

Breakdowns stay in long form ``(key..., defect_code, count)``; maps are only
built when publishing.  The exclusion set of the reliability filter is a
DataFrame of codes, joined (not collected), so it can be as large as the code
catalogue without touching the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions import classify as C
from roadworthy.functions import normalize as N


def code_counts(defects: DataFrame, on_bad: str = "raise") -> DataFrame:
    """Quantity per defect code over every defect row."""
    quantity = N.defect_quantity(F.col(P.AANTAL_GEBREKEN), on_bad)
    return defects.groupBy(P.GEBREK_ID).agg(F.sum(quantity).alias("count"))


def top_defects(defects: DataFrame, codes: DataFrame, k: int = P.DEFAULT.top_codes,
                denominator: str = "top", on_bad: str = "raise") -> DataFrame:
    """A16 + J6 + P18 + T3: the k most frequent codes with description and share.

    ``denominator="top"`` divides by the total of the k codes (the original
    behaviour, D4); ``"all"`` divides by every defect.
    """
    counts = code_counts(defects, on_bad)
    top = counts.orderBy(F.col("count").desc(), F.col(P.GEBREK_ID).asc()).limit(k)
    # The total of all codes is a scalar: raw codes, however many, are added up map-side, not in one task's window.
    den = counts.agg(F.sum("count")).scalar() if denominator == "all" else F.sum("count").over(Window.partitionBy())
    # One description a code (the rule of A19), so a repeated code cannot repeat a result row.
    desc = codes.groupBy(P.GEBREK_ID).agg(F.max(P.GEBREK_OMSCHRIJVING).alias(P.GEBREK_OMSCHRIJVING))
    return top.withColumn("_den", den).join(desc, P.GEBREK_ID, "left").select(
        F.col(P.GEBREK_ID).alias("defect_code"),
        F.coalesce(F.col(P.GEBREK_OMSCHRIJVING), F.lit(P.UNKNOWN_DEFECT_DESCRIPTION)).alias("defect_description"),
        F.col("count"),
        N.rnd(F.col("count") / F.col("_den") * 100, 2).alias("percentage"),
    )


def defect_headline(top: DataFrame, total_inspections: DataFrame) -> DataFrame:
    """Total of the top codes, inspections, average (2 dp, 0 if none)."""
    from roadworthy.operators.profile import combine_rows

    both = combine_rows(
        top.agg(F.coalesce(F.sum("count"), F.lit(0).cast("bigint")).alias("total_defects")),
        total_inspections.select(F.col("total_inspections")),
    )
    return both.withColumn(
        "avg_defects_per_inspection",
        F.when(F.col("total_inspections") > 0,
               N.rnd(F.col("total_defects") / F.col("total_inspections"), 2)).otherwise(F.lit(0.0)),
    )


def defects_with_vehicle(defects: DataFrame, fact: DataFrame, raw_time: bool = False, on_bad: str = "raise") -> DataFrame:
    """Defect quantities joined to the primary inspections of the fact.

    Defect rows are first summed per (report, code) - combined map-side, so
    a report listed a huge number of times shrinks to one row per code and
    task before any shuffle - and only then joined on (plate, day, time).
    Both sides use the normalised report time; ``raw_time=True`` reproduces
    the original comparison of the raw time with the normalised one (D3).
    """
    t = F.col(P.MELD_TIJD) if raw_time else N.normalized_time(F.col(P.MELD_TIJD))
    d = defects.select(
        P.KENTEKEN, P.MELD_DATUM, t.alias(P.MELD_TIJD), P.GEBREK_ID,
        N.defect_quantity(F.col(P.AANTAL_GEBREKEN), on_bad).alias("count"),
    ).groupBy(P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.GEBREK_ID).agg(F.sum("count").alias("count"))
    keys = fact.select(P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.MERK, P.HANDELSBENAMING)
    return d.join(keys, [P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD], "inner")


def breakdown(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Defect quantity per (key..., code), long form."""
    return joined.groupBy(*keys, P.GEBREK_ID).agg(F.sum("count").alias("count")).withColumnRenamed(
        P.GEBREK_ID, "defect_code"
    )


def breakdown_rollup(model_level: DataFrame) -> DataFrame:
    """A18 brand level from the model level (exact: sums of sums)."""
    return model_level.groupBy(P.MERK, "defect_code").agg(F.sum("count").alias("count"))


def brand_breakdown(defects: DataFrame, fact: DataFrame, raw_time: bool = False) -> DataFrame:
    return breakdown(defects_with_vehicle(defects, fact, raw_time), [P.MERK])


def model_breakdown(defects: DataFrame, fact: DataFrame, raw_time: bool = False, on_bad: str = "raise") -> DataFrame:
    return breakdown(defects_with_vehicle(defects, fact, raw_time, on_bad), [P.MERK, P.HANDELSBENAMING])


def code_index(codes: DataFrame) -> DataFrame:
    """A19 + P14: code -> description ('' if null); of the descriptions of a
    repeated code the greatest wins, wherever its row lies (D21)."""
    return (
        codes.where(N.non_empty(F.col(P.GEBREK_ID)))
        .groupBy(P.GEBREK_ID)
        .agg(F.coalesce(F.max(P.GEBREK_OMSCHRIJVING), F.lit("")).alias("description"))
        .withColumnRenamed(P.GEBREK_ID, "defect_code")
    )


def classify_codes(index: DataFrame, overrides: Mapping[str, bool] | None = None) -> DataFrame:
    """P19/P20 over the code index: category and reliability flag per code."""
    code = F.col("defect_code")
    return index.select(
        "defect_code",
        C.wear_category(code).alias("category"),
        C.computed_is_reliability(code, None, overrides).alias("is_reliability"),
    )


def excluded_codes(index: DataFrame, mode: str = "reliability", custom: Iterable[str] = (),
                   toggled: Iterable[str] = ()) -> DataFrame:
    """The codes left out of the defect count.

    ``all`` -> none; ``reliability`` -> the wear-and-tear codes of the index;
    ``custom`` -> the given codes.  ``toggled`` flips membership of codes
    (a user clicking them), which also switches the mode to custom.
    """
    code = F.col("defect_code")
    if mode == "all":
        base = F.lit(False)
    elif mode == "reliability":
        base = C.is_wear_and_tear(code)
    elif mode == "custom":
        base = code.isin(*list(custom)) if list(custom) else F.lit(False)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    tog = list(toggled)
    member = base if not tog else F.when(code.isin(*tog), ~base).otherwise(base)
    return index.where(member).select("defect_code")


def bulk_toggle_codes(index: DataFrame, term: str) -> DataFrame:
    """P21 bulk action: the codes a select-all / deselect-all over a search applies to."""
    return code_search(index, term).select("defect_code")


def filtered_ratio(breakdown_df: DataFrame, keys: Sequence[str], excluded: DataFrame, mode: str) -> DataFrame:
    """Included and total defects per key, and their share for display
    (1.0 in mode ``all`` or if the key has no defects).  Rates are computed
    from the two counts, never from the rounded share."""
    # The exclusion set holds each code once (it is cut from the code index).
    ex = excluded.select("defect_code").withColumn("_ex", F.lit(True))
    j = breakdown_df.join(ex, "defect_code", "left")
    agg = j.groupBy(*keys).agg(
        F.sum("count").alias("total_count"),
        F.sum(F.when(F.col("_ex").isNull(), F.col("count")).otherwise(F.lit(0))).alias("included_count"),
    )
    ratio = F.when(F.lit(mode == "all") | (F.col("total_count") <= 0), F.lit(1.0)).otherwise(
        F.col("included_count") / F.col("total_count")
    )
    return agg.withColumn("defect_ratio", N.rnd(ratio, 6))


def with_reliability(top: DataFrame, overrides: Mapping[str, bool] | None = None, stored: str | None = None) -> DataFrame:
    """P20: the flag per code: user override, else the column ``stored`` where it is set, else the classifier."""
    flag = C.computed_is_reliability(F.col("defect_code"), F.col(stored) if stored else None, overrides)
    return top.withColumn("computed_is_reliability", flag)


def reliability_summary(top: DataFrame, overrides: Mapping[str, bool] | None = None) -> DataFrame:
    """Reliability / wear / total counts over the top codes, percent 1 dp."""
    t = with_reliability(top, overrides)
    rel = F.coalesce(F.sum(F.when(F.col("computed_is_reliability"), F.col("count"))), F.lit(0).cast("bigint"))
    tot = F.coalesce(F.sum("count"), F.lit(0).cast("bigint"))
    return t.agg(rel.alias("reliability_count"), tot.alias("total_count")).select(
        "reliability_count",
        (F.col("total_count") - F.col("reliability_count")).alias("wear_count"),
        "total_count",
        F.when(F.col("total_count") > 0, N.rnd(F.col("reliability_count") / F.col("total_count") * 100, 1))
        .otherwise(F.lit(0.0)).alias("reliability_percentage"),
    )


def reliability_chart(top: DataFrame, k: int = P.RELIABILITY_CHART_ITEMS,
                      overrides: Mapping[str, bool] | None = None) -> DataFrame:
    """The k reliability codes with the highest counts."""
    t = with_reliability(top, overrides).where(F.col("computed_is_reliability"))
    return t.orderBy(F.col("count").desc(), F.col("defect_code").asc()).limit(k).select(
        F.col("defect_code").alias("name"), F.col("defect_description").alias("description"), "count", "percentage"
    )


def code_counts_summary(index: DataFrame, excluded: DataFrame) -> DataFrame:
    """Active and total number of codes."""
    from roadworthy.operators.profile import combine_rows

    tot = index.agg(F.count(F.lit(1)).alias("total_defect_count"))
    exc = excluded.join(index.select("defect_code"), "defect_code", "left_semi").agg(
        F.count(F.lit(1)).alias("excluded_count")
    )
    return combine_rows(tot, exc).select(
        (F.col("total_defect_count") - F.col("excluded_count")).alias("active_defect_count"), "total_defect_count"
    )


def defect_search(top: DataFrame, term: str, category: str = "all",
                  sort_key: str = "count", ascending: bool = False) -> DataFrame:
    """P27 + T9: filter the top codes by code/description and optionally to
    reliability codes; order by count or percentage."""
    t = with_reliability(top)
    if category == "reliability":
        t = t.where(F.col("computed_is_reliability"))
    if term:
        q = term.lower()
        t = t.where(F.lower(F.col("defect_code")).contains(q) | F.lower(F.col("defect_description")).contains(q))
    o = F.col(sort_key).asc() if ascending else F.col(sort_key).desc()
    return t.orderBy(o, F.col("defect_code").asc())


def code_search(index: DataFrame, term: str, locale: str | None = None) -> DataFrame:
    """Code list filtered by code or description, ordered by code.

    With a ``locale`` (a collation such as ``UNICODE`` or ``nl``) codes sort as a
    reader of it expects and the search ignores case in any script; without, bytes decide."""
    from roadworthy.operators.search_index import contains_ignoring_case, locale_order

    code, description = F.col("defect_code"), F.col("description")
    out = index
    if term:
        q = term.lower()
        hit = (lambda c: contains_ignoring_case(c, term)) if locale else (lambda c: F.lower(c).contains(q))
        out = index.where(hit(code) | hit(description))
    return out.orderBy(locale_order(code, locale), code) if locale else out.orderBy("defect_code")


def top_defects_per_group(breakdown_df: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """The k largest codes per group with their share of the group.

    Groups are bounded by the number of codes, so the window per group is
    small regardless of data volume.
    """
    w = Window.partitionBy(*keys)
    wr = Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col("defect_code").asc())
    return (
        breakdown_df.withColumn("group_total", F.sum("count").over(w))
        .withColumn("rank", F.row_number().over(wr))
        .where(F.col("rank") <= k)
        .withColumn("share", N.rnd(F.col("count") / F.col("group_total") * 100, 2))
    )
