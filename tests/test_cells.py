import json

import pytest
from pyspark.sql import functions as F

from rowlens.functions.cells import column, json_length, number, number_text, percent, round_half, value_text


def listed(df, expression):
    return [r[0] for r in df.select(expression.alias("v")).collect()]


def test_number_text_is_coerced(one_column):
    good = {"12": 12.0, "1e3": 1000.0, " 12 ": 12.0, "+5": 5.0, ".5": 0.5, "5.": 5.0, "-0": 0.0}
    df = one_column(list(good), "string")
    assert listed(df, number(df, "x")) == list(good.values())


def test_text_that_only_looks_like_a_number_is_dropped(one_column):
    df = one_column(["1d", "1f", "inf", "NaN", "1,000", "1L", "0x10", "", None, "  "], "string")
    assert listed(df, number(df, "x")) == [None] * 10


def test_zero_policy_counts_missing_cells_as_zero_but_not_text(one_column):
    df = one_column(["1", "", None, "x"], "string")
    assert listed(df, number(df, "x", "zero")) == [1.0, 0.0, 0.0, None]


def test_non_finite_numbers_are_dropped_under_both_policies(one_column):
    df = one_column([1.0, float("nan"), float("inf"), float("-inf"), None])
    assert listed(df, number(df, "x")) == [1.0, None, None, None, None]
    assert listed(df, number(df, "x", "zero")) == [1.0, None, None, None, 0.0]


def test_null_policy_is_checked(one_column):
    df = one_column([1.0])
    with pytest.raises(ValueError):
        number(df, "x", "drop")


def test_round_half_goes_away_from_zero_and_leaves_large_values(one_column):
    df = one_column([0.125, -0.125, 2.5e17, -0.001, 0.0])
    assert listed(df, round_half(F.col("x"), 2)) == [0.13, -0.13, 2.5e17, 0.0, 0.0]


def test_percent_of_nothing_is_null(spark):
    df = spark.range(1)
    assert listed(df, percent(F.lit(0), F.lit(0))) == [None]


def test_number_text_has_no_trailing_zero_and_no_exponent(one_column):
    df = one_column([1.0, 0.5, 12345678.9, 0.0001234, 1e14, -3.0, 123456789012.25])
    assert listed(df, number_text(F.col("x"))) == [
        "1", "0.5", "12345678.9", "0.0001234", "100000000000000", "-3", "123456789012.25"
    ]


def test_json_length_matches_json(one_column):
    texts = ['a"b', "tab\t", "back\\slash", "\x01\x1f", "Ü", "😀x", "", "line\nfeed", "/"]
    df = one_column(texts, "string")
    expected = [len(json.dumps(t, ensure_ascii=False).encode("utf-16-le")) // 2 for t in texts]
    assert listed(df, json_length(df, "x")) == expected


def test_json_length_of_other_cells(spark):
    df = spark.createDataFrame([(1, 2.0, True, None), (-10, 2.25, False, "x")], "a int, b double, c boolean, d string")
    total = json_length(df, "a") + json_length(df, "b") + json_length(df, "c") + json_length(df, "d")
    assert listed(df, total) == [len("1") + len("2") + len("true") + len("null"), 3 + 4 + 5 + 3]


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([("1",)], ["a.b`c"])
    assert listed(df, number(df, "a.b`c")) == [1.0]
    assert listed(df, value_text(df, "a.b`c")) == ["1"]
    assert listed(df, column("a.b`c")) == ["1"]
