"""Bind the generated test tables to the five logical inspection tables.

The test data is a TPC-H-like star schema; FIXTURES.md (part B) fixes how its
columns stand in for vehicles, inspection reports, defects, defect codes and
fuel entries.  Every logical column is a string, as in the raw source.  The
binding is a plain projection of the given tables, so Catalyst prunes columns
and pushes filters into the Parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.sources.tables import read_table


@dataclass(frozen=True)
class Sources:
    vehicles: DataFrame
    inspections: DataFrame
    defects: DataFrame
    codes: DataFrame
    fuel: DataFrame


def _s(c: Column) -> Column:
    return c.cast("string")


def _compact_date(ts: Column) -> Column:
    """YYYYMMDD text of a timestamp (integer arithmetic: cheaper per row than a
    date formatter, identical for four-digit years)."""
    d = ts.cast("date")
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("string")


def _report_time() -> Column:
    """200, 370, ... 1220: times of three and of four digits."""
    return _s(F.col("l_linenumber") * 170 + 30)


def _code(n: Column) -> Column:
    """Code text of a number: mostly the number itself, in some residues a code
    of another family (several numbers then share a code, so codes repeat)."""
    r, q = n % 25, F.floor(n / 25)
    return (
        F.when(r == 0, F.concat(F.lit("AP"), _s(n)))
        .when(r == 1, F.concat(F.lit(" op"), _s(n)))
        .when(r == 2, F.concat(F.lit("AC"), _s(q % 5 + 1)))
        .when(r == 3, F.lit("RA4"))
        .when(r == 4, _s(q % 3 + 115))
        .when(r == 5, _s(q % 6 + 388))
        .when(r == 6, _s(q * 12 + 475))
        .otherwise(_s(n))
    )


def bind_vehicles(part: DataFrame) -> DataFrame:
    kind = F.split(F.col("p_type"), " ").getItem(0)
    # Some plates are listed twice, the second time with other spelling and no price.
    part = part.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("p_partkey") % 13 == 0, 2).otherwise(1))))
    again = F.col("copy") == 2
    return part.select(
        _s(F.col("p_partkey")).alias(P.KENTEKEN),
        F.when(kind.isin("ECONOMY", "STANDARD", "PROMO"), F.lit(P.KIND_PASSENGER))
        .when(kind == "SMALL", F.lit(P.KIND_COMMERCIAL))
        .otherwise(F.lit("Motorfiets"))
        .alias(P.VOERTUIGSOORT),
        F.when(again, F.concat(F.lit("\t"), F.lower("p_brand"), F.lit(" "))).otherwise(F.col("p_brand")).alias(P.MERK),
        F.when(F.col("p_partkey") % 17 != 0, F.col("p_name")).alias(P.HANDELSBENAMING),
        F.concat(_s(F.lit(1985) + F.col("p_size") % 15), F.lit("0101")).alias(P.DATUM_EERSTE_TOELATING),
        F.when(again | (F.col("p_size") % 7 == 0), F.lit(None).cast("string"))
        .otherwise(_s(F.col("p_retailprice")))
        .alias(P.CATALOGUSPRIJS),
        # Not in FIXTURES part B; added for the certificate check of the lookup.
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("p_partkey") % 19 == 0, F.lit("2030"))
        .otherwise(F.concat(_s(F.lit(2018) + F.col("p_size") % 10),
                            F.lpad(_s(F.lit(1) + F.col("p_partkey") % 12), 2, "0"), F.lit("15")))
        .alias(P.VERVALDATUM_APK),
    )


def bind_inspections(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        _s(F.col("l_partkey")).alias(P.KENTEKEN),
        _compact_date(F.col("l_shipdate")).alias(P.MELD_DATUM),
        _report_time().alias(P.MELD_TIJD),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 3), F.lit("\tPERIODIEKE controle"))
        .when(F.col("l_linestatus") == "F", F.lit("Periodieke Controle "))
        .when(F.col("l_linenumber") % 2 == 0, F.lit("tachograaf Goedgekeurd"))
        .otherwise(F.lit("tachograaf"))
        .alias(P.SOORT_MELDING),
        # Not in FIXTURES part B; added for the documented coverage-years metric.
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
        .when(F.col("l_linenumber") == 6, F.lit("onbekend"))
        .otherwise(F.date_format(F.date_add(F.col("l_shipdate"), F.col("l_linenumber") * 61), "yyyyMMdd"))
        .alias(P.VERVALDATUM_KEURING),
    )


def bind_defects(lineitem: DataFrame, code_offset: int = 0) -> DataFrame:
    return lineitem.where(F.col("l_returnflag").isin("R", "A")).select(
        _s(F.col("l_partkey")).alias(P.KENTEKEN),
        _compact_date(F.col("l_shipdate")).alias(P.MELD_DATUM),
        _report_time().alias(P.MELD_TIJD),
        _code(F.col("l_suppkey") + code_offset).alias(P.GEBREK_ID),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("string"))
        .otherwise(_s(F.col("l_quantity").cast("int") % 4 + 1))
        .alias(P.AANTAL_GEBREKEN),
    )


def bind_codes(supplier: DataFrame, code_offset: int = 0) -> DataFrame:
    return supplier.select(
        _code(F.col("s_suppkey") + code_offset).alias(P.GEBREK_ID),
        F.col("s_name").alias(P.GEBREK_OMSCHRIJVING),
    )


def bind_fuel(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li = lineitem.where(F.col("l_discount") == 0.1).select("l_orderkey", "l_partkey")
    pr = F.col("o_orderpriority")
    return li.join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        _s(F.col("l_partkey")).alias(P.KENTEKEN),
        F.when(pr == "1-URGENT", F.lit(P.FUEL_LPG))
        .when(pr == "2-HIGH", F.lit(P.FUEL_ELECTRIC))
        .when(pr == "3-MEDIUM", F.lit(P.FUEL_DIESEL))
        .when(pr == "5-LOW", F.lit(P.FUEL_PETROL))
        .otherwise(F.lit("Waterstof"))
        .alias(P.BRANDSTOF),
    )


def bind(spark: SparkSession, sf_dir: str, code_offset: int = 0) -> Sources:
    """All five logical tables over ``sf_dir``.

    ``code_offset`` shifts defect codes (FIXTURES.md: +200 puts the small
    code range onto codes the wear-and-tear classifier knows).
    """
    part = read_table(spark, sf_dir, "part")
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    supplier = read_table(spark, sf_dir, "supplier")
    return Sources(
        vehicles=bind_vehicles(part),
        inspections=bind_inspections(lineitem),
        defects=bind_defects(lineitem, code_offset),
        codes=bind_codes(supplier, code_offset),
        fuel=bind_fuel(lineitem, orders),
    )
