import math
from collections import Counter

import pytest

from rowlens.operators import categorical
from rowlens.operators.passes import HEAD
from tests.scans import scans


def test_profile_counts_blanks_as_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], "x string")
    row = categorical.categorical_profile(df).first()
    p = [2 / 3, 1 / 3]
    assert (row["unique_count"], row["null_count"]) == (2, 2)
    assert row["entropy"] == pytest.approx(-sum(q * math.log2(q) for q in p), abs=1e-4)


def test_all_missing_and_one_value_have_no_entropy(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a")], "x string, y string")
    assert {r["column"]: r["entropy"] for r in categorical.entropy(df).collect()} == {"x": 0.0, "y": 0.0}


def test_top_values_break_ties_by_value_and_divide_by_all_rows(spark):
    values = [f"v{i:02d}" for i in range(25)] + ["v24", None, ""]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    top = categorical.top_values(df, ["x"]).orderBy("rank").collect()
    assert [t["value"] for t in top] == ["v24"] + [f"v{i:02d}" for i in range(19)]
    assert top[0]["pct"] == 7.14 and top[1]["count"] == 1


def test_entropy_is_bounded_by_the_distinct_values(spark):
    df = spark.range(5000).selectExpr("string(pmod(hash(id), 37)) AS x")
    counts = Counter(r["x"] for r in df.collect())
    row = categorical.categorical_profile(df, ["x"]).first()
    assert row["unique_count"] == len(counts)
    assert 0 <= row["entropy"] <= round(math.log2(len(counts)), 4)


def test_distinct_counts_of_all_types(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1.0D, true), (1, 1.5D, false), (2, 1.0D, null) AS t(a, b, c)")
    exact = {r["column"]: r["unique_count"] for r in categorical.unique_count(df).collect()}
    near = {r["column"]: r["unique_count"] for r in categorical.unique_count(df, approximate=True).collect()}
    assert exact == near == {"a": 2, "b": 2, "c": 2}


def test_sample_values_follow_the_stated_order(spark):
    df = spark.createDataFrame([(3, "c"), (1, "b"), (2, "b"), (4, "a"), (0, "")], "id int, x string")
    assert [r["value"] for r in categorical.sample_values(df, "x", ["id"], k=2).collect()] == ["b", "c"]


def test_frequencies_give_both_tables(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "p string, q string")
    profile, top = categorical.frequencies(df, ["p", "q"], 2)
    assert {r["column"]: r["unique_count"] for r in profile.collect()} == {"p": 1, "q": 2}
    assert top.count() == 3


def test_long_texts_are_told_apart_and_ordered_whole(spark):
    """Values that share their first characters, ties among them, and counts that the first characters do not show."""
    head = "x" * HEAD
    values = [head + f"{i:03d}" for i in range(40)] + [head + "007"] * 2 + [head, head[:-1], head[:-1], "y" * 500, ""]
    df = spark.createDataFrame([(v,) for v in values], "t string").repartition(3)
    counts = Counter(v for v in values if v)
    top = [(r["value"], r["count"]) for r in categorical.top_values(df, ["t"]).orderBy("rank").collect()]
    assert top == sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:20]
    assert categorical.unique_count(df, ["t"]).first()["unique_count"] == len(counts)


def test_no_long_text_is_shuffled_to_be_counted(spark):
    """What a grouped scan writes is as small for texts of 10,000 characters as for short ones."""
    df = spark.range(200).selectExpr("repeat(string(id), 5000) AS t", "id % 3 AS n")
    longest = categorical.key_counts(df, ["t", "n"]).selectExpr("max(length(head)) AS m").first()["m"]
    assert longest == HEAD
    assert categorical.top_values(df, ["t"], k=3).count() == 3


def test_profile_of_no_column(spark):
    df = spark.range(3)
    assert categorical.categorical_profile(df, []).count() == 0 and categorical.top_values(df, []).count() == 0
    assert [f.count() for f in categorical.frequencies(df, [], 3)] == [0, 0]


@pytest.mark.parametrize("modulus, k", [(3, 10), (1000, 10), (7, 2), (1, 1)])
def test_sample_values_of_long_runs(spark, modulus, k):
    """The first values fill more rows than a round takes; some are missing."""
    df = spark.range(3000).selectExpr("id", f"IF(id % 10 = 3, NULL, string(id DIV {-(-3000 // modulus)})) AS x").repartition(5)
    seen = dict.fromkeys(r["x"] for r in df.orderBy("id").collect() if r["x"] is not None)
    assert [r["value"] for r in categorical.sample_values(df, "x", ["id"], k).collect()] == list(seen)[:k]


def test_sample_values_of_nothing(spark):
    df = spark.range(3).selectExpr("id", "CAST(NULL AS STRING) AS x")
    assert categorical.sample_values(df, "x", ["id"]).count() == 0
    assert categorical.sample_values(df.where("false"), "x", ["id"]).count() == 0


def test_sample_values_take_one_scan_and_no_shuffle_of_values(spark, tmp_path):
    spark.range(5000).selectExpr("id", "string(id % 50) AS x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    with scans(spark, 5000) as made:
        found = categorical.sample_values(df, "x", ["id"], 10)
    assert [r["value"] for r in found.collect()] == [str(i) for i in range(10)]
    assert made() == 1
