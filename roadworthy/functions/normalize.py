"""Column expressions for cleaning the raw all-string tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadworthy import params as P

# Whitespace characters removed by ``strip`` (the ASCII set of Java's ``\s``).
_WS = " \t\n\r\f\u000b"


def strip(c: Column) -> Column:
    """Remove leading/trailing whitespace of any kind.

    Plain ``trim`` only drops spaces; trimming an explicit character set is a
    byte scan, much cheaper per row than a regular expression."""
    return F.trim(c, F.lit(_WS))


def normalized_time(c: Column) -> Column:
    """Null -> '', strip, left zero-fill to four characters; longer kept."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) < 4, F.lpad(t, 4, "0")).otherwise(t)


def plate_prefix(c: Column) -> Column:
    """First character upper-cased, null -> ''."""
    return F.coalesce(F.upper(F.substring(c, 1, 1)), F.lit(""))


def is_periodic_report(c: Column) -> Column:
    """The report kind marks a periodic inspection."""
    return F.lower(strip(c)) == F.lit(P.PERIODIC_REPORT_KIND)


def year_of(c: Column, strict: bool = True) -> Column:
    """First four characters as int (strict cast raises on junk under ANSI)."""
    s = F.substring(c, 1, 4)
    return s.cast("int") if strict else s.try_cast("int")


def upper_strip(c: Column) -> Column:
    """P5: brand / model normalisation."""
    return strip(F.upper(c))


def price(c: Column, strict: bool = True) -> Column:
    """Catalogue price as double, null -> 0 (so is junk if not strict)."""
    return F.coalesce(c.cast("double") if strict else c.try_cast("double"), F.lit(0.0))


def vehicle_type_group(c: Column) -> Column:
    """Vehicle kind -> usage group."""
    return (
        F.when(c == P.KIND_PASSENGER, F.lit(P.GROUP_CONSUMER))
        .when(c == P.KIND_COMMERCIAL, F.lit(P.GROUP_COMMERCIAL))
        .otherwise(F.lit(P.GROUP_OTHER))
    )


def defect_quantity(c: Column, on_bad: str = "raise") -> Column:
    """Reported quantity, null -> 1, as bigint.

    ``on_bad="raise"`` keeps the strict cast (ANSI raises on non-numeric
    text, as the original does); ``on_bad="one"`` maps junk to 1 as the
    documentation describes (D20).
    """
    filled = F.coalesce(c, F.lit("1"))
    if on_bad == "one":
        return F.coalesce(filled.try_cast("bigint"), F.lit(1).cast("bigint"))
    return filled.cast("bigint")


def fuel_bucket(c: Column) -> Column:
    """Known fuel description or 'other' (null -> other)."""
    return F.when(c.isin(*P.KNOWN_FUEL_TYPES), c).otherwise(F.lit(P.FUEL_OTHER_BUCKET))


def model_key(brand: Column, model: Column) -> Column:
    """P13: 'brand|model', null when either part is null (publishing only)."""
    return F.concat(brand, F.lit("|"), model)


def non_empty(c: Column) -> Column:
    """Not null and not ''."""
    return c.isNotNull() & (c != F.lit(""))


def clip_age(c: Column) -> Column:
    """Age with lower bound 1 (denominator of the per-vehicle-year rate)."""
    return F.greatest(c, F.lit(1))


def guarded_ratio(num: Column, den: Column, digits: int = 6) -> Column:
    """num/den with NaN/null/inf -> 0.0, rounded."""
    return rnd(F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0)), digits)


def rnd(c: Column, digits: int) -> Column:
    """Round through decimal so ties round identically on every engine."""
    return F.round(c.cast("decimal(28,10)"), digits).cast("double")


def coverage_years(report_date: Column, expiry: Column) -> Column:
    """P38 (documented exposure): years a report covers until its expiry,
    at least 0.25; 1.0 when the expiry is missing or unparsable."""
    d0 = F.try_to_date(report_date, "yyyyMMdd")
    d1 = F.try_to_date(expiry, "yyyyMMdd")
    yrs = F.datediff(d1, d0) / 365.25
    return F.when(d0.isNull() | d1.isNull(), F.lit(1.0)).otherwise(F.greatest(yrs, F.lit(0.25)))
