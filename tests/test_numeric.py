import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rowlens.operators import numeric, passes, ranks
from tests.scans import scans


def profile_of(df, **options):
    return {r["column"]: r for r in numeric.numeric_profile(df, **options).collect()}


def expected_quartiles(values):
    values = sorted(values)
    n = len(values)
    return values[math.floor(n * 0.25)], statistics.median(values), values[math.floor(n * 0.75)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 101, 1000])
def test_quartiles_of_small_tables(one_column, n):
    values = [float(v) for v in random.Random(n).choices(range(n), k=n)]
    row = numeric.quartiles(one_column(values)).first()
    assert (row["q25"], row["median"], row["q75"]) == expected_quartiles(values)


SHAPES = {
    "uniform": "double(hash(id))",
    "skewed": "exp(20 * (pmod(hash(id), 100003) / 100003D))",
    "hot": "IF(pmod(hash(id), 3) = 0, 5D, double(pmod(hash(id), 50000)) / 7)",
    "two": "double(pmod(hash(id), 2))",
    "extremes": "element_at(array(-1.7976931348623157E308D, -4.9E-324D, -0.0D, 0.0D, 4.9E-324D, 2.2250738585072014E-308D, 1.7976931348623157E308D), int(pmod(hash(id), 7)) + 1)",
    "neighbours": "1D + pmod(hash(id), 100000) * 2.220446049250313E-16D",
    "octaves": "(1D + pmod(hash(id), 3) * 2.220446049250313E-16D) * pow(2D, pmod(id, 41) - 20) * IF(id % 3 = 0, -1, 1)",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_ranks_of_any_shape_take_four_scans(spark, shape):
    """Hot values, doubles next to each other, the largest and the smallest there are."""
    df = spark.range(60_000).selectExpr(f"{SHAPES[shape]} AS x").repartition(4).cache()
    wanted = [0, 1, 14_999, 15_000, 29_999, 30_000, 45_000, 59_999]
    with scans(spark, 60_000) as counted:
        found = ranks.select_ranks(df, {"x": F.col("x")}, {"x": wanted})
    values = sorted(r["x"] for r in df.collect())
    assert {rank: found["x", rank] for rank in wanted} == {rank: values[rank] for rank in wanted}
    assert 0 < counted() <= 4


def test_columns_with_few_values(spark):
    df = spark.range(30_000).selectExpr(
        "double(pmod(hash(id), 9973)) AS x", "IF(id % 500 = 0, double(id), NULL) AS rare", "IF(id = 7, 1D, NULL) AS one", "double(NULL) AS none"
    )
    found = numeric.locate_quartiles(df, df.columns)
    for c in ("x", "rare", "one"):
        values = [r[c] for r in df.where(f"{c} IS NOT NULL").collect()]
        assert (found[c].q25, found[c].median, found[c].q75) == expected_quartiles(values)
    assert found["none"] == numeric.Quartiles()


def test_buckets_ascend_with_the_numbers(spark):
    values = [0.0, 5e-324, 1e-308, 2.5e-308, 0.99999, 1.0, 1.0001, 1.9, 2.0, 1e300, 1.7976931348623157e308]
    numbers = sorted([-v for v in values] + values)
    rows = spark.createDataFrame([(v,) for v in numbers], "x double").select("x", passes.bucket(F.col("x")).alias("b")).collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows) and all(r["b"] is not None for r in rows)
    assert {r["b"] for r in rows if r["x"] == 0} == {0}


def test_moments_are_those_of_the_population(one_column):
    values = [1.0, 2.0, 2.0, 3.0, 10.0]
    row = profile_of(one_column(values))["x"]
    mean, std = statistics.fmean(values), statistics.pstdev(values)
    assert row["mean"] == pytest.approx(mean)
    assert row["std"] == pytest.approx(std)
    assert row["skewness"] == pytest.approx(sum(((v - mean) / std) ** 3 for v in values) / 5)
    assert row["kurtosis"] == pytest.approx(sum(((v - mean) / std) ** 4 for v in values) / 5 - 3)


def test_a_constant_column_has_no_spread_and_one_bin(one_column):
    df = one_column([0.1] * 7)
    row = profile_of(df)["x"]
    assert (row["std"], row["skewness"], row["kurtosis"]) == (0.0, 0.0, 0.0)
    bins = numeric.histogram(df).collect()
    assert [(b["range_start"], b["range_end"], b["count"], b["label"]) for b in bins] == [(0.1, 0.1, 7, "0.1")]


def test_null_policies(one_column):
    df = one_column([2.0, 4.0, None, float("nan"), float("inf")])
    skip, zero = profile_of(df)["x"], profile_of(df, null_policy="zero")["x"]
    assert (skip["mean"], skip["min"], skip["null_count"]) == (3.0, 2.0, 1)
    assert (zero["mean"], zero["min"], zero["null_count"]) == (2.0, 0.0, 1)


def test_a_column_without_numbers_keeps_its_row(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS a, 1.0D AS b")
    rows = profile_of(df)
    assert rows["a"]["mean"] is None and rows["a"]["q25"] is None and rows["a"]["null_count"] == 1
    assert rows["b"]["median"] == 1.0
    assert {r["column"] for r in numeric.histogram(df).collect()} == {"b"}


def test_a_table_without_rows(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert [r["mean"] for r in numeric.numeric_profile(df).collect()] == [None, None]
    assert numeric.histogram(df).count() == 0


def test_text_numbers_are_profiled(one_column):
    row = profile_of(one_column(["1", "2", "x", "", None] + ["3"] * 10, "string"))["x"]
    assert (row["max"], row["null_count"]) == (3.0, 2)


def test_histogram_keeps_empty_bins_and_every_value(spark):
    df = spark.range(1000).select((F.col("id") % 3 * 10.0).alias("x"))
    bins = numeric.histogram(df).orderBy("bin").collect()
    assert len(bins) == 20 and sum(b["count"] for b in bins) == 1000
    assert [b["count"] for b in bins if b["count"]] == [334, 333, 333]
    assert bins[0]["label"] == "0.00–1.00" and bins[19]["range_end"] == 20.0


def test_histogram_leaves_missing_cells_out(one_column):
    values = [0.0, 10.0, 10.0, None, float("nan")]
    counts = [b["count"] for b in numeric.histogram(one_column(values)).orderBy("bin").collect()]
    assert counts == [1] + [0] * 18 + [2]
    assert [b["count"] for b in numeric.histogram(one_column([3.0, 3.0, None])).collect()] == [2]


def test_many_columns_and_odd_names(spark):
    names = [f"c.{i}" for i in range(70)]
    df = spark.range(9).select(*[(F.col("id") + i).alias(n) for i, n in enumerate(names)])
    rows = profile_of(df)
    assert [rows[n]["median"] for n in names] == [4.0 + i for i in range(len(names))]
