"""Display formatting of report columns.

Formatting happens on small result tables; every helper is a built-in
column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.functions.normalize import rnd


def name_casing(c: Column) -> Column:
    """P32: 'GOLF VARIANT' -> 'Golf Variant' (words start after a space)."""
    return F.initcap(F.lower(c))


def number_format(c: Column) -> Column:
    """Integer with groups of three separated by a space ('1 234 567')."""
    return F.regexp_replace(F.format_number(c.cast("bigint"), 0), ",", " ")


def decimal_format(c: Column, precision: int = 2) -> Column:
    """Dutch decimal notation ('1.234,57'); rounded through decimal first
    so halfway cases do not depend on the formatter."""
    return F.translate(F.format_number(rnd(c, precision), precision), ",.", ".,")


def percentage_format(c: Column) -> Column:
    """Fraction as percent with one decimal ('15.0%')."""
    return F.concat(F.format_string("%.1f", rnd(c * 100, 1)), F.lit("%"))


def compact_date_display(c: Column) -> Column:
    """P34: 'YYYYMMDD' -> 'DD-MM-YYYY'; anything not 8 characters unchanged."""
    return F.when(
        F.length(c) == 8,
        F.concat_ws("-", F.substring(c, 7, 2), F.substring(c, 5, 2), F.substring(c, 1, 4)),
    ).otherwise(c)


def normalize_plate(c: Column) -> Column:
    """Keep letters and digits, upper case, at most 10 characters."""
    return F.substring(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9]", "")), 1, 10)


def plate_is_valid(normalized: Column) -> Column:
    """A normalised plate needs at least four characters."""
    return F.length(normalized) >= 4


def certificate_status(expiry: Column, as_of: str) -> Column:
    """P36: 'unknown' when missing, 'valid' when the expiry date lies after
    ``as_of`` (yyyy-MM-dd), else 'expired' (also for unparsable dates)."""
    d = F.try_to_date(expiry, "yyyyMMdd")
    return (
        F.when(expiry.isNull() | (expiry == ""), F.lit("unknown"))
        .when(d > F.lit(as_of).cast("date"), F.lit("valid"))
        .otherwise(F.lit("expired"))
    )


def passed(result_text: Column) -> Column:
    """The report text contains the pass marker (null -> false)."""
    return F.coalesce(result_text.contains(P.PASS_MARKER), F.lit(False))
