import datetime as dt

import pytest

from rowlens.operators.query import Filter, aggregate, apply_filters, condition, run_query, sort_rows
from tests.scans import scans

SCHEMA = "id int, n double, s string, b boolean, d timestamp_ntz"


@pytest.fixture
def df(spark):
    rows = [
        (1, 5.0, "Apple", True, dt.datetime(2024, 1, 1)),
        (2, 50.0, "banana", False, dt.datetime(2024, 6, 1)),
        (3, None, None, None, None),
        (4, float("nan"), "", True, dt.datetime(2025, 1, 1)),
        (5, -1.0, "12", False, dt.datetime(2024, 1, 1, 12)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df, *filters, **options):
    return sorted(r["id"] for r in apply_filters(df, [Filter(*f) for f in filters], **options).collect())


def test_equality(df):
    assert ids(df, ("s", "eq", "Apple")) == [1]
    assert ids(df, ("n", "eq", "5")) == [1]
    assert ids(df, ("n", "eq", "five")) == []
    assert ids(df, ("b", "eq", "true")) == [1, 4]
    assert ids(df, ("d", "eq", "2024-01-01")) == [1]
    assert ids(df, ("s", "neq", "Apple")) == [2, 3, 4, 5]
    assert ids(df, ("n", "neq", "5")) == [2, 3, 4, 5]


def test_comparisons_never_match_null_nan_or_text(df):
    assert ids(df, ("n", "gt", "-5")) == [1, 2, 5]
    assert ids(df, ("n", "gte", 5)) == [1, 2]
    assert ids(df, ("n", "lt", "5")) == [5]
    assert ids(df, ("n", "lte", "5")) == [1, 5]
    assert ids(df, ("n", "gt", "x")) == []
    assert ids(df, ("s", "gt", "3")) == [5]
    assert ids(df, ("d", "gte", "2024-06-01")) == [2, 4]
    assert ids(df, ("d", "lt", dt.date(2024, 1, 2))) == [1, 5]


def test_zero_policy(df):
    assert ids(df, ("n", "gte", "0"), null_policy="zero") == [1, 2, 3]


def test_contains(df):
    assert ids(df, ("s", "contains", "AN")) == [2]
    assert ids(df, ("s", "contains", None)) == [1, 2, 4, 5]
    assert ids(df, ("s", "not_contains", "an")) == [1, 3, 4, 5]
    assert ids(df, ("n", "contains", "5")) == [1, 2]


def test_missing(df):
    assert ids(df, ("s", "is_null")) == [3, 4]
    assert ids(df, ("s", "not_null")) == [1, 2, 5]
    assert ids(df, ("n", "is_null")) == [3]


def test_filters_are_combined(df):
    assert ids(df, ("n", "not_null"), ("s", "not_null"), ("n", "lt", 10)) == [1, 5]


def test_unknown_names_raise(df):
    for bad in (Filter("s", "like", "x"), Filter("zzz", "eq", "x"), Filter("d", "gt", "soon")):
        with pytest.raises(ValueError):
            condition(df, bad)
    for options in (
        {"group_by": "zzz"},
        {"sort_by": "zzz"},
        {"group_by": "s", "aggregation": "median", "agg_column": "n"},
        {"group_by": "s", "aggregation": "sum"},
        {"group_by": "s", "aggregation": "sum", "agg_column": "zzz"},
        {"aggregation": "sum", "agg_column": "n"},
        {"sort_by": "id", "sort_dir": "down"},
        {"limit": -1},
    ):
        with pytest.raises(ValueError):
            run_query(df, **options)


def test_groups_keep_null_and_sum_nothing_to_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, None), ("", 2.0)], "k string, v double")
    sums = {r["k"]: (r["count"], r["sum_v"]) for r in aggregate(df, "k", "sum", "v").collect()}
    assert sums == {"a": (2, 1.0), None: (1, 0.0), "": (1, 2.0)}
    means = {r["k"]: r["mean_v"] for r in aggregate(df, "k", "mean", "v").collect()}
    assert means == {"a": 1.0, None: None, "": 2.0}
    assert aggregate(df, "k", "count").columns == ["k", "count"]
    zero = {r["k"]: r["mean_v"] for r in aggregate(df, "k", "mean", "v", "zero").collect()}
    assert zero == {"a": 0.5, None: 0.0, "": 2.0}


def test_sort_puts_nulls_last_and_settles_ties(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (1, "z"), (2, "a")], "n int, s string")
    assert [tuple(r) for r in sort_rows(df, "n").collect()] == [(1, "z"), (2, "a"), (2, "b"), (None, "a")]
    assert [tuple(r) for r in sort_rows(df, "n", "desc").collect()] == [(2, "a"), (2, "b"), (1, "z"), (None, "a")]


def test_locale_order(spark):
    df = spark.createDataFrame([("Zebra",), ("apple",), ("Äpfel",)], "s string")
    assert [r["s"] for r in sort_rows(df, "s").collect()] == ["Zebra", "apple", "Äpfel"]
    assert [r["s"] for r in sort_rows(df, "s", locale=True).collect()][-1] == "Zebra"


def test_limit_and_total(spark):
    df = spark.range(3000)
    result = run_query(df, limit=500)
    assert (result.rows.count(), result.total_count(), result.columns) == (500, 3000, ["id"])
    assert run_query(df, limit=5000).rows.count() == min(5000, df.count())
    assert run_query(df).rows.count() == df.count()
    assert run_query(df, limit=0).rows.count() == 0


def test_rows_and_their_count_take_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(30_000).selectExpr("id", "id % 7 AS k").write.parquet(path)
    df = spark.read.parquet(path)
    with scans(spark, 30_000) as counted:
        rows, total = run_query(df, [Filter("k", "gt", "2")], sort_by="id", sort_dir="desc", limit=3).fetch()
    assert counted() == 1
    assert ([r["id"] for r in rows.collect()], total) == ([29_999, 29_998, 29_994], sum(i % 7 > 2 for i in range(30_000)))
    grouped, groups = run_query(df, group_by="k", aggregation="count", sort_by="k", limit=2).fetch()
    assert ([r["k"] for r in grouped.collect()], groups) == ([0, 1], 7)
    for result in (run_query(df, limit=4), run_query(df, sort_by="id", limit=0), run_query(df.where("false"), sort_by="id", limit=4)):
        found, total = result.fetch()
        assert (found.count(), total) == (result.rows.count(), result.total_count())
    with pytest.raises(ValueError):
        run_query(df, sort_by="id").fetch()


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "string(id) AS s", "id * 2 AS unused").write.parquet(path)
    df = apply_filters(spark.read.parquet(path), [Filter("id", "gt", "5"), Filter("s", "eq", "7")]).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "EqualTo(s,7)" in plan and "unused" not in plan


def test_equality_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT id, string(id) AS s, id % 2 = 0 AS flag, float(id / 10) AS x FROM range(50)").write.parquet(path)
    df = spark.read.parquet(path)

    def pushed(f):
        plan = apply_filters(df, [f])._jdf.queryExecution().executedPlan().toString()
        return plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]

    assert "Not(EqualNullSafe(s,7))" in pushed(Filter("s", "neq", "7"))
    assert "Not(EqualNullSafe(id,7))" in pushed(Filter("id", "neq", "7"))
    assert "EqualTo(flag,true)" in pushed(Filter("flag", "eq", "true"))
    assert "EqualTo(x,0.1)" in pushed(Filter("x", "eq", "0.1")) and apply_filters(df, [Filter("x", "eq", "0.1")]).count() == 1
    assert apply_filters(df, [Filter("flag", "neq", "maybe")]).count() == 50
