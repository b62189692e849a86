"""White space, missing values, rounding and predicates."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import text as T

CELLS = [None, "", " ", " x ", "\x1ca\x1fb", "a\n b", "NA", " nan ", "N/A", "None", "No LLM", "　", "a" * 20000]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, c string")


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column.alias("v")).collect()]


def test_strip_and_collapse_are_pythons(cells):
    assert values(cells, T.pystrip(F.col("c"))) == [None if c is None else c.strip() for c in CELLS]
    assert values(cells, T.collapse_ws(F.col("c"))) == [None if c is None else " ".join(c.split()) for c in CELLS]
    assert values(cells, T.clean_text(F.col("c")))[0] == ""


def test_missing_is_never_null(cells):
    assert values(cells, T.is_missing(F.col("c"))) == [c is None or c.strip() in ("", "NA", "N/A", "None", "nan", "null") for c in CELLS]


def test_na_tokens_are_exact(cells):
    got = values(cells, T.na_to_null(F.col("c")))
    assert got[CELLS.index("NA")] is None and got[CELLS.index(" nan ")] == " nan " and got[CELLS.index("No LLM")] == "No LLM"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), min_size=1, max_size=20))
def test_collapse_twice_is_once(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    once = T.collapse_ws(F.col("c"))
    assert df.where(once != T.collapse_ws(once)).count() == 0


def test_rounding_is_half_even_on_the_scaled_value(spark):
    df = spark.createDataFrame([(2.25,), (0.35,), (None,)], "x double")
    assert [r[0] for r in df.select(T.np_round1(F.col("x"))).collect()] == [2.2, 0.4, None]


def test_predicates_keep_nulls_apart(spark):
    df = spark.createDataFrame([("Yes",), ("y",), ("No",), (None,)], "c string")
    assert df.where(T.is_yes(F.col("c"))).count() == 2
    assert df.where(~T.is_yes(F.col("c"))).count() == 2
    assert df.where(T.icontains(F.col("c"), "ES")).count() == 1


def test_tokens_keep_empties(spark):
    df = spark.createDataFrame([("A, B,,A",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(T.tokens(F.col("c"))).collect()] == [["A", "B", "", "A"], [""], None]
