import json

import pytest
from pyspark.sql import functions as F

from rowlens.operators import table


def test_missing_cells(spark):
    df = spark.createDataFrame([(1, ""), (None, "a"), (2, None), (3, "b")], "n int, s string")
    assert [tuple(r) for r in table.null_counts(df).collect()] == [("n", 1), ("s", 2)]
    assert [tuple(r) for r in table.missing_values(df).collect()] == [("s", 2, 50.0), ("n", 1, 25.0)]
    assert [r["column"] for r in table.missing_values(df, k=1).collect()] == ["s"]


def test_no_rows(spark):
    df = spark.createDataFrame([], "n int, s string")
    assert table.missing_values(df).count() == 0
    assert table.duplicate_rows(df).first().asDict() == {"duplicate_rows": 0, "rows": 0}
    assert table.memory_estimate(df).first().asDict() == {"json_chars": 2, "memory_mb": 0.0}
    assert tuple(table.shape(df).first()) == (0, 2)


def test_duplicates_compare_whole_rows(spark):
    long = "x" * 100
    rows = [("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1), ("", 1), (long, 1), (long, 1), (long + "y", 1)]
    df = spark.createDataFrame(rows, "s string, n int")
    assert table.duplicate_rows(df).first()["duplicate_rows"] == 3


def test_a_short_text_is_not_taken_for_a_digest(spark):
    df = spark.sql("SELECT repeat('a', 31) AS s UNION ALL SELECT repeat('a', 32) UNION ALL SELECT repeat('a', 33)")
    assert table.duplicate_rows(df).first()["duplicate_rows"] == 0


def test_one_row_on_most_rows(spark):
    df = spark.range(9000).selectExpr("IF(id % 3 = 0, -1, id) AS x")
    assert table.duplicate_rows(df).first()["duplicate_rows"] == 2999


@pytest.mark.parametrize("most", [0, 1, 100])
@pytest.mark.parametrize("digests", ["all", "one"])
def test_repeated_rows_are_compared_cell_by_cell(spark, monkeypatch, most, digests):
    """Also where all rows share a digest, and where more digests are shared than are broadcast."""
    monkeypatch.setattr(table, "MOST_SHARED", most)
    if digests == "one":
        monkeypatch.setattr(table, "_digested", lambda df: [F.lit(0)])
    cells = "SELECT string(nullif(id % 3, 0)) AS s, IF(id = 0, -0.0D, double(id % 2)) AS x, repeat('x', int(id % 6)) AS t"
    df = spark.sql(f"{cells} FROM range(20) UNION ALL SELECT NULL, double('NaN'), 'a' FROM range(3) UNION ALL SELECT 'a', NULL, NULL")
    assert table.repeated_rows(df) == table.duplicate_rows(df).first()["duplicate_rows"] == 24 - 8
    assert table.repeated_rows(df.limit(0)) == 0
    assert table.repeated_rows(spark.range(100).toDF("_copies")) == 0


def test_memory_is_the_length_of_the_json_text(spark):
    rows = [{"id": i, "x": i / 4, "s": 'q"' if i % 2 else None, "b": i % 3 == 0} for i in range(50)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, x double, s string, b boolean")
    for r in rows:
        r["x"] = int(r["x"]) if r["x"] == int(r["x"]) else r["x"]
    assert table.memory_estimate(df).first()["json_chars"] == len(json.dumps(rows, separators=(",", ":")))


def test_nested_columns_are_refused(spark):
    with pytest.raises(TypeError):
        table.duplicate_rows(spark.sql("SELECT array(1) AS a"))


def test_preview_is_ordered(spark):
    df = spark.range(100).selectExpr("-id AS id")
    assert [r["id"] for r in table.preview(df, ["id"]).collect()] == list(range(-99, -49))


def test_wide_tables(spark):
    df = spark.range(3).selectExpr(*[f"IF(id = 0, NULL, id) AS c{i}" for i in range(130)])
    assert {r["null_count"] for r in table.null_counts(df).collect()} == {1}
