import pytest

from rowlens.operators import schema


def test_shares_at_the_limit_do_not_reach_it(spark):
    rows = [
        (
            i,
            "7" if i % 10 < 8 else "n/a",
            "7" if i % 100 < 81 else "n/a",
            "true" if i % 10 < 9 else "maybe",
            "false" if i % 100 < 91 else "maybe",
            "" if i % 2 else None,
        )
        for i in range(100)
    ]
    df = spark.createDataFrame(
        rows, "id long, num_80 string, num_81 string, bool_90 string, bool_91 string, empty string"
    )
    assert schema.semantic_types(df) == {
        "id": "numeric",
        "num_80": "categorical",
        "num_81": "numeric",
        "bool_90": "categorical",
        "bool_91": "boolean",
        "empty": "categorical",
    }


def test_all_rows_are_judged(spark):
    df = spark.range(3000).selectExpr("id", "if(id < 1000, string(id), 'text') AS x", "if(id < 400, 'text', string(id)) AS y")
    assert schema.semantic_types(df) == {"id": "numeric", "x": "categorical", "y": "numeric"}


def test_declared_types(spark):
    df = spark.sql("SELECT 1 AS i, 1.5BD AS d, true AS b, current_date() AS day, current_timestamp() AS ts, '' AS s")
    kinds = [r["semantic_type"] for r in schema.infer_types(df).orderBy("position").collect()]
    assert kinds == ["numeric", "numeric", "boolean", "date", "date", "categorical"]


def test_iso_date_time_text_is_a_date(one_column):
    df = one_column(["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5+01:00", ""], "string")
    assert schema.semantic_types(df) == {"x": "date"}


def test_nested_columns_are_refused_by_name(spark):
    with pytest.raises(TypeError, match="tags"):
        schema.semantic_types(spark.sql("SELECT 1 AS a, array(1) AS tags"))


def test_numeric_projection_keeps_table_order(spark):
    df = spark.sql("SELECT 'a' AS s, 2 AS b, 1.0D AS a, true AS t")
    assert schema.project_numeric(df).columns == ["b", "a"]
