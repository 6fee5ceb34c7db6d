import json
import math

import pytest

from rowlens.plans import column, detail, eda, quality, report
from tests.scans import scans, shuffled


@pytest.fixture(scope="module")
def table(spark):
    """200 rows: skewed and constant numbers, an id, half-empty text, a category of one value."""
    return spark.range(200).selectExpr(
        "id AS n",
        "double(pow(id % 20, 6)) AS skewed",
        "3.0D AS constant",
        "concat('u', id) AS code",
        "IF(id % 2 = 0, NULL, 'x') AS half",
        "IF(id = 0, 'b', 'a') AS dominant",
        "IF(id % 5 < 3, '', 'y') AS mostly_blank",
    )


@pytest.fixture(scope="module")
def profile(table):
    return eda.full_profile(table, ["n"])


def rules(df):
    return {r["rule"]: (r["severity"], r["value"], r["affected_columns"]) for r in df.collect()}


def test_overview(profile):
    row = profile.overview.first()
    assert (row["rows"], row["cols"], row["numeric_columns"], row["categorical_columns"]) == (200, 7, 3, 4)
    assert (row["duplicate_rows"], row["missing_cells"], row["missing_columns"]) == (0, 220, 2)
    assert not row["was_sampled"] and row["sample_size"] == 200


def test_every_column_is_profiled_once(profile):
    names = [r["column"] for r in profile.numeric.collect()] + [r["column"] for r in profile.categorical.collect()]
    assert sorted(names) == sorted(profile.types)


def test_score(profile):
    row = quality.quality_score(profile).first()
    # 220 of 1400 cells are missing: 100 - 2 * 15.714 = 68.57.
    assert (row["score"], row["fitness"]) == (69, "adequately suited")


def test_issues(profile):
    assert rules(quality.issues(profile)) == {
        "high_null_columns": (None, 2.0, ["half", "mostly_blank"]),
        "id_like_columns": (None, 1.0, ["code"]),
    }


def test_findings(profile):
    found = rules(quality.findings(profile))
    assert found["rows"][1] == 200 and found["columns"][1] == 7
    assert found["numeric_columns"][1] == 3 and found["categorical_columns"][1] == 4
    assert found["skewed_columns"] == (None, 1.0, ["skewed"])
    assert found["constant_columns"] == (None, 1.0, ["constant"])
    assert found["mostly_null_columns"] == (None, 1.0, ["mostly_blank"])
    assert found["widest_range"] == (None, float(19**6), ["skewed"])


def test_insights(profile):
    assert rules(quality.insights(profile)) == {
        "skewed_distributions": ("warning", 1.0, ["skewed"]),
        "missing_value_patterns": ("critical", 2.0, ["half", "mostly_blank"]),
        "multivariate_relationships": ("info", 3.0, ["n", "skewed", "constant"]),
    }


def test_recommendations(profile):
    assert rules(quality.recommendations(profile)) == {
        "address_missing_values": (None, 2.0, []),
        "transform_skewed": (None, 1.0, ["skewed"]),
        "no_duplicates": (None, 0.0, []),
        "check_multicollinearity": (None, 3.0, []),
        "encode_high_cardinality": (None, 1.0, ["code"]),
        "validate_types": (None, 7.0, []),
    }


def test_unusual(profile, spark):
    found = rules(quality.unusual(profile))
    assert found["near_constant_categories"] == (None, 1.0, ["dominant"])
    plain = eda.full_profile(spark.range(20).selectExpr("id", "string(id % 5) || 'x' AS s"))
    assert rules(quality.unusual(plain)) == {"none": (None, 0.0, [])}


def test_low_variance_and_duplicates(spark):
    df = spark.range(100_000).selectExpr("IF(id = 0, 1e9, 0D) AS spike")
    found = rules(quality.insights(eda.full_profile(df)))
    assert found["low_variance_columns"] == ("info", 1.0, ["spike"])
    assert found["duplicate_rows_detected"][:2] == ("critical", 99_998.0)


def test_snapshot_holds_all_sections(profile):
    sections = {r["section"] for r in quality.snapshot(profile).collect()}
    assert sections == {"issue", "finding", "insight", "recommendation", "unusual"}


def test_a_table_without_rows(spark):
    profile = eda.full_profile(spark.createDataFrame([], "a double, s string"))
    row = quality.quality_score(profile).first()
    assert row["score"] is None and row["fitness"] is None
    assert profile.overview.first()["rows"] == 0
    assert rules(quality.findings(profile))["rows"][1] == 0


def test_a_sampled_profile_counts_duplicates_on_all_rows(spark):
    df = spark.range(1000).selectExpr("id % 10 AS a", "IF(id % 4 = 0, NULL, 'x') AS s")
    row = eda.full_profile(df, ["a"], sample_threshold=100).overview.first()
    assert row["was_sampled"] and row["sample_size"] == 100 and row["rows"] == 1000
    assert row["missing_cells"] == 250 and row["duplicate_rows"] == 985
    with pytest.raises(ValueError):
        eda.full_profile(df, sample_threshold=100)


def test_a_sample_without_equal_rows_hides_no_duplicates(spark):
    """Every row occurs twice, and the sample takes one of each pair."""
    df = spark.range(4000).selectExpr("id div 2 AS a", "string(id div 2) AS s")
    for size in (100, 1000):
        row = eda.full_profile(df, ["a"], sample_threshold=size).overview.first()
        assert row["duplicate_rows"] == 2000


def test_a_sampled_profile_shuffles_no_whole_rows(spark, tmp_path):
    """A digest a row, and the rows near the sampled ones."""
    path = str(tmp_path / "table")
    spark.range(60_000).selectExpr("id * 7919 % 60000 AS k", *[f"sha2(concat(id, {i}), 256) AS s{i}" for i in range(4)]).write.parquet(path)
    df = spark.read.parquet(path)
    with shuffled(spark) as moved:
        row = eda.full_profile(df, ["k"], sample_threshold=50).overview.first()
    assert (row["rows"], row["sample_size"], row["duplicate_rows"]) == (60_000, 50, 0)
    assert moved() < 60_000 * 100


def test_a_profile_takes_five_scans(spark, tmp_path):
    """Numbers, dates, categories, numbers written as text, missing cells and repeated rows, all from the same scans."""
    path = str(tmp_path / "table")
    spark.range(30_000).selectExpr(
        "id % 20000 AS n",
        "exp(id % 20000 / 1000) AS spread",
        "IF(id % 20000 % 7 = 0, NULL, double(id % 20000) / 3) AS holes",
        "string(id % 20000 / 4) AS written",
        "concat('c', id % 50) AS kind",
        "id % 2 = 0 AS flag",
        "timestamp_seconds(id % 20000) AS at",
    ).write.parquet(path)
    df = spark.read.parquet(path)
    with scans(spark, 30_000) as counted:
        found = eda.full_profile(df)
    assert counted() <= 5
    row = found.overview.first()
    assert (row["rows"], row["duplicate_rows"], row["numeric_columns"]) == (30_000, 10_000, 4)
    assert found.types["written"] == "numeric" and row["memory_mb"] > 0
    assert found.quartiles["spread"].median == pytest.approx(math.exp(7.4995), rel=1e-3)


def test_report_tables(profile, table):
    assert [r["column"] for r in report.numeric_table(profile).collect()] == ["n", "skewed", "constant"]
    shown = {r["column"]: r for r in report.categorical_table(profile).collect()}
    assert (shown["dominant"]["top_value"], shown["dominant"]["second_pct"]) == ("a", 0.5)
    assert shown["half"]["second_value"] is None
    assert report.categorical_table(profile, k=2).count() == 2
    kinds = [(r["column"], r["type"], r["unique_count"]) for r in report.column_directory(profile).collect()]
    assert kinds[0] == ("n", "Numeric", None) and kinds[3] == ("code", "Categorical", 200)
    assert {r["metric"] for r in report.overview(profile).collect()} >= {"rows", "missing_columns", "memory_mb"}
    assert report.outlier_table(profile, table).count() == 3
    assert [r["column"] for r in report.missing_report(profile).collect()] == ["mostly_blank", "half"]


def test_bundle(profile, table):
    full = json.loads(report.bundle(table, "t", profile).toJSON().first())
    assert full["dataset"] == "t" and len(full["numeric"]) == 3 and len(full["correlation"]) == 3
    assert full["quality_score"][0]["score"] == 69
    bare = report.bundle(table, "t", with_correlation=False, with_outliers=False).first()
    assert bare["numeric"] is None and bare["outliers"] is None


def test_column_report(table, spark):
    row = column.column_overview(table, "half").first()
    assert tuple(row) == ("half", "categorical", 100, 50.0, 1)
    stats, bins = column.numeric_column(table, "n")
    assert stats.first()["median"] == 99.5 and bins.count() == 20
    found, top = column.categorical_column(table, "dominant")
    assert found.first()["unique_count"] == 2 and top.count() == 2
    empty = spark.createDataFrame([], "a string")
    assert tuple(column.column_overview(empty, "a").first()) == ("a", "categorical", 0, None, 0)


def test_dataset_detail_takes_one_scan(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(20_000).selectExpr("id", "string(id) AS written", "IF(id % 4 = 0, '', 'x') AS s").write.parquet(path)
    df = spark.read.parquet(path)
    with scans(spark, 20_000) as counted:
        found = detail.dataset_detail(df, ["id"], k=3)
    assert counted() == 1
    assert [tuple(r)[1:] for r in found.columns.collect()] == [
        ("id", "bigint", "numeric", 0), ("written", "string", "numeric", 0), ("s", "string", "categorical", 5000)
    ]
    size = found.size.first()
    assert (size["rows"], size["cols"]) == (20_000, 3) and size["memory_mb"] > 0
    assert [r["id"] for r in found.preview.collect()] == [0, 1, 2]
    empty = detail.dataset_detail(df.where("false"))
    assert tuple(empty.size.first()) == (0, 3, 0.0) and empty.preview.count() == 0


def test_whole_column_report(table):
    found = column.column_report(table, "skewed", ["n"], samples=3)
    assert found.overview.first()["dtype"] == "numeric" and found.distribution.count() == 20
    assert [r["value"] for r in found.samples.collect()] == ["0", "1", "64"]
    found = column.column_report(table, "half", ["n"])
    assert found.statistics.first()["unique_count"] == 1 and [r["value"] for r in found.distribution.collect()] == ["x"]
