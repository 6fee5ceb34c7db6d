import math

import pytest
from pyspark.sql import functions as F

from rowlens.operators import correlation
from tests.scans import scans


def pearson(pairs):
    n = len(pairs)
    mx, my = sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
    top = sum((x - mx) * (y - my) for x, y in pairs)
    return top / math.sqrt(sum((x - mx) ** 2 for x, _ in pairs) * sum((y - my) ** 2 for _, y in pairs))


def found(df, **options):
    return {(r["col1"], r["col2"]): r for r in correlation.correlation_pairs(df, **options).collect()}


def test_pairs_use_rows_where_both_cells_are_valid(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 7.0), (None, 1.0), (5.0, 9.0), (float("nan"), 4.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert found(df)["a", "b"]["value"] == pytest.approx(pearson([(1, 2), (3, 7), (5, 9)]), abs=1e-4)
    zero = pearson([(1, 2), (2, 0), (3, 7), (0, 1), (5, 9)])
    assert found(df, null_policy="zero")["a", "b"]["value"] == pytest.approx(zero, abs=1e-4)


def test_no_variance_gives_zero_also_within_the_pair(spark):
    rows = [(0.1, 1.0, 1.0), (0.1, 2.0, 1.0), (0.1, None, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    assert {k: r["value"] for k, r in found(df).items()} == {("a", "b"): 0.0, ("a", "c"): 0.0, ("b", "c"): 0.0}
    diagonal = correlation.correlation_matrix(df).where("row_col = col_col").collect()
    assert {r["row_col"]: r["value"] for r in diagonal} == {"a": 0.0, "b": 1.0, "c": 1.0}


def test_fewer_than_two_columns_or_rows(spark):
    assert correlation.correlation_pairs(spark.range(3)).count() == 0
    assert correlation.correlation_matrix(spark.range(3)).count() == 0
    assert found(spark.sql("SELECT 1 AS a, 2 AS b"))["a", "b"]["value"] == 0.0
    assert found(spark.createDataFrame([], "a int, b int"))["a", "b"]["value"] == 0.0


@pytest.mark.parametrize("k", [2, 3, 5, 6])
def test_every_pair_once_and_strongest_first(spark, k):
    names = [f"c{i}" for i in range(k)]
    df = spark.range(200).select(*[F.pow("id", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    rows = correlation.correlation_pairs(df).collect()
    assert len(rows) == k * (k - 1) // 2
    assert all(r["col1"] < r["col2"] and abs(r["value"]) <= 1 for r in rows)
    strengths = [abs(r["value"]) for r in rows]
    assert strengths == sorted(strengths, reverse=True)


def test_two_scans_for_the_columns_of_a_block(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(20_000).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(8)]).write.parquet(path)
    df = spark.read.parquet(path)
    with scans(spark, 20_000) as counted:
        assert correlation.correlation_pairs(df).count() == 28
    assert counted() == 2


def test_many_columns_some_with_gaps(spark):
    """Blocks of columns meet in every combination, with values far from zero."""
    names = [f"c{i}" for i in range(30)]
    cells = [(F.pmod(F.hash("id", F.lit(i % 7)), F.lit(1000)) + 1e9 + i * F.col("id")).cast("double") for i in range(30)]
    cells = [F.when(F.col("id") % (i + 2) != 0, c) if i % 3 == 0 else c for i, c in enumerate(cells)]
    df = spark.range(400).select(*[c.alias(n) for c, n in zip(cells, names)])
    rows = df.collect()
    got = {k: r["value"] for k, r in found(df).items()}
    assert len(got) == 435
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            pairs = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]
            assert got[a, b] == pytest.approx(pearson(pairs), abs=2e-4)


def test_cells_that_are_no_numbers_are_gaps_in_every_column(spark):
    nan = float("nan")
    rows = [(nan, 1.0), (1.0, nan), (2.0, 3.0), (4.0, 5.0), (5.0, 9.0)]
    got = found(spark.createDataFrame(rows, "a double, b double"))["a", "b"]["value"]
    assert got == pytest.approx(pearson([(2, 3), (4, 5), (5, 9)]), abs=1e-4)


def test_labels(spark):
    df = spark.createDataFrame([(0.8,), (-0.6,), (0.4,), (0.2,), (0.1,), (0.7,)], "value double")
    labels = df.select(correlation.strength(F.col("value")), correlation.report_strength(F.col("value"))).collect()
    assert [tuple(r) for r in labels] == [
        ("Very Strong", "Strong"),
        ("Strong", "Moderate"),
        ("Moderate", "Moderate"),
        ("Weak", "Weak"),
        ("Negligible", "Weak"),
        ("Strong", "Strong"),
    ]


def test_report(spark):
    df = spark.range(50).selectExpr("id AS a", "-id AS b", "pmod(hash(id), 7) AS c")
    pairs = correlation.correlation_pairs(df)
    top = correlation.report_table(pairs, 1).collect()
    assert [(r["col1"], r["col2"], r["strength"], r["direction"]) for r in top] == [("a", "b", "Strong", "Negative")]
    assert tuple(correlation.strong_count(pairs).first()) == (3, 1)
