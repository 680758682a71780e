"""Wear-and-tear versus reliability classification of defect codes.

The classifier is a pure column expression: the code is stripped and
upper-cased, looked up in a literal set (Spark plans ``isin`` over literals as
a hash-set ``InSet``) and checked for the administrative prefixes.  No join
and no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadworthy.functions.normalize import strip

# ---------------------------------------------------------------------------
# Wear-and-tear defect codes per category, as published by the
# original classification (order as listed there).  AC3 (rust damage) is a
# reliability defect and is deliberately absent.
# ---------------------------------------------------------------------------
WEAR_CODES: dict[str, tuple[str, ...]] = {
    "tires": (
        "203", "204", "205", "206", "207", "208", "209", "210", "211", "212", "213", "214", "215",
        "216", "217", "218", "701", "874", "875", "876", "877", "992", "AC1", "RA4",
    ),
    "lighting": (
        "475", "487", "497", "507", "532", "556", "571", "572", "573", "584", "589", "601",
        "516", "517", "518", "519", "520", "521", "522", "524", "598",
        "542", "576", "710",
    ),
    "wipers": ("388", "389", "391", "392", "393"),
    "brake_wear": ("289", "290", "311", "312", "313", "AC5", "705"),
    "shock_absorbers": ("241", "AC2", "702"),
    "exhaust_wear": ("115", "116", "117"),
    "administrative": ("AC4", "704"),
}
# Code prefixes that always count as wear-and-tear (administrative / limitation codes).
WEAR_PREFIXES: tuple[str, ...] = ("AP", "OP")

ALL_WEAR_CODES: tuple[str, ...] = tuple(c for codes in WEAR_CODES.values() for c in codes)


def clean_code(code: Column) -> Column:
    return F.upper(strip(code))


def is_wear_and_tear(code: Column) -> Column:
    """True for wear-and-tear codes (null code -> False)."""
    c = clean_code(code)
    hit = c.isin(*ALL_WEAR_CODES)
    for p in WEAR_PREFIXES:
        hit = hit | c.startswith(p)
    return F.coalesce(hit, F.lit(False))


def is_reliability(code: Column) -> Column:
    """A code that indicates a reliability problem."""
    return ~is_wear_and_tear(code)


def wear_category(code: Column) -> Column:
    """Category name of a wear-and-tear code; 'administrative' for the
    prefixes; null for reliability codes."""
    c = clean_code(code)
    expr = None
    for cat, codes in WEAR_CODES.items():
        cond = c.isin(*codes)
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    for p in WEAR_PREFIXES:
        expr = expr.when(c.startswith(p), F.lit("administrative"))
    return expr


def computed_is_reliability(code: Column, stored: Column | None = None,
                            overrides: Mapping[str, bool] | None = None) -> Column:
    """P20: user override, else stored flag, else the classifier."""
    parts = []
    if overrides:
        lit_map = F.create_map(*[x for k, v in overrides.items() for x in (F.lit(k), F.lit(bool(v)))])
        parts.append(F.try_element_at(lit_map, code))
    if stored is not None:
        parts.append(stored)
    parts.append(is_reliability(code))
    return F.coalesce(*parts) if len(parts) > 1 else parts[0]
