"""Registered queries: the stored fact and its refresh."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.plans import oracle as O
from roadworthy.plans.catalog import T, register, sources
from roadworthy.session import shared_dir
from roadworthy.sources.fact_store import READS, SHARD, FactStore


def _earlier(src):
    """The inputs at an earlier state: reports of prefix 1 from 1995 on and defects of prefix 2 are not in yet,
    brands of prefix 3 are spelled otherwise, prefix 4 has other fuels, and vehicles of a prefix Q are still listed."""
    first, year = F.substring(P.KENTEKEN, 1, 1), F.substring(P.MELD_DATUM, 1, 4)
    gone = src.vehicles.where(first == "5").withColumn(P.KENTEKEN, F.concat(F.lit("Q"), P.KENTEKEN))
    seen = src.inspections.where(first == "5").withColumn(P.KENTEKEN, F.concat(F.lit("Q"), P.KENTEKEN))
    return replace(
        src,
        inspections=src.inspections.where((first != "1") | (year < "1995")).unionByName(seen),
        defects=src.defects.where(first != "2"),
        vehicles=src.vehicles.withColumn(P.MERK, F.when(first == "3", F.concat(F.lit("old "), P.MERK)).otherwise(F.col(P.MERK))).unionByName(gone),
        fuel=src.fuel.withColumn(P.BRANDSTOF, F.when(first == "4", F.lit(P.FUEL_LPG)).otherwise(F.col(P.BRANDSTOF))),
    )


def _refreshed(spark, sf_dir):
    src = sources(spark, sf_dir)
    store = FactStore(spark, shared_dir(spark, "fact-store"))
    store.refresh(_earlier(src))
    return store, store.refresh(src)


@register("s12_refreshed_fact", lambda: O.q("SELECT * FROM fact", T))
def s12_refreshed_fact(spark, sf_dir):
    """The stored fact after a refresh of the prefixes whose inputs changed."""
    return _refreshed(spark, sf_dir)[0].fact()


@register("s12_refresh_report", lambda: O.q("""
SELECT p AS shard, p = '1' AND n1 > 0 OR p = '2' AND n2 > 0 AS reports, p = '3' AND n3 > 0 AS vehicles, p = '4' AND n4 > 0 AS fuel,
       p IN ('1', '2', '3', '4') AND fact_rows > 0 AS fact, fact_rows
FROM (SELECT substr(kenteken, 1, 1) AS p, count(*) AS fact_rows FROM fact GROUP BY ALL),
     (SELECT count(*) FILTER (starts_with(kenteken, '1') AND meld_datum_door_keuringsinstantie >= '1995') AS n1 FROM inspections),
     (SELECT count(*) FILTER (starts_with(kenteken, '2')) AS n2 FROM defects),
     (SELECT count(*) FILTER (starts_with(kenteken, '3')) AS n3 FROM vehicles),
     (SELECT count(*) FILTER (starts_with(kenteken, '4') AND brandstof_omschrijving <> 'LPG') AS n4 FROM fuel)""", T))
def s12_refresh_report(spark, sf_dir):
    """Which tables a refresh rewrote for each prefix of the fact."""
    store, done = _refreshed(spark, sf_dir)
    kept = store.table("fact").groupBy(SHARD).agg(F.count(F.lit(1)).alias("fact_rows"))
    return kept.select(SHARD, *[F.col(SHARD).isin(*done.rewritten.get(t, [])).alias(t) for t in [*READS, "fact"]], "fact_rows")
