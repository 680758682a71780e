"""Property tests: column helpers against plain-Python statements of the rules."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadworthy.functions import classify as C
from roadworthy.functions import formatting as FM
from roadworthy.functions import normalize as N

WS = " \t\n\r\f\x0b"
time_text = st.one_of(st.none(), st.text(alphabet="0123456789 \t", max_size=7))
plate_text = st.one_of(st.none(), st.text(alphabet="ab-CD 12.z9_", max_size=14))
code_text = st.one_of(st.sampled_from(list(C.ALL_WEAR_CODES) + ["AC3", "OP1", "ap9", " 205 ", "999", ""]),
                      st.text(alphabet="ACOP0123456789 ", max_size=5))


def py_time(v):
    s = (v or "").strip(WS)
    return s.rjust(4, "0") if len(s) < 4 else s


def py_plate(v):
    return re.sub(r"[^a-zA-Z0-9]", "", v or "").upper()[:10]


def py_wear(v):
    c = v.strip(WS).upper()
    return c in set(C.ALL_WEAR_CODES) or c.startswith(("AP", "OP"))


@settings(max_examples=30, deadline=None)
@given(st.lists(time_text, min_size=1, max_size=20))
def test_normalized_time_matches_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r[0] for r in df.select(N.normalized_time(F.col("t"))).collect()]
    assert got == [py_time(v) for v in values]


@settings(max_examples=30, deadline=None)
@given(st.lists(plate_text, min_size=1, max_size=20))
def test_plate_normalisation_matches_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "p string")
    n = FM.normalize_plate(F.col("p"))
    got = [(r[0], r[1]) for r in df.select(n, FM.plate_is_valid(n)).collect()]
    assert got == [(py_plate(v), len(py_plate(v)) >= 4) for v in values]


@settings(max_examples=30, deadline=None)
@given(st.lists(code_text, min_size=1, max_size=20))
def test_classifier_matches_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = [r[0] for r in df.select(C.is_wear_and_tear(F.col("c"))).collect()]
    assert got == [py_wear(v) for v in values]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=10))
def test_integer_percent_rounds_half_up(spark, pairs):
    from roadworthy.operators.fuel import pct

    df = spark.createDataFrame(pairs, "c long, t long")
    got = [r[0] for r in df.select(pct(F.col("c"), F.col("t"))).collect()]
    want = [(200 * c + t) // (2 * t) if t > 0 else 0 for c, t in pairs]
    assert got == want
