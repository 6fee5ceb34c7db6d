from rowlens.operators import outliers


def test_values_beyond_the_fences(spark):
    rows = [(float(i), 1.0) for i in range(20)] + [(500.0, 1.0), (-300.0, 9.0), (None, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = {r["column"]: r for r in outliers.with_severity(outliers.outliers(df)).collect()}
    assert (found["a"]["count"], found["a"]["pct"], found["a"]["severity"]) == (2, 9.09, "Moderate")
    # Sorted a has 22 values: q25 is number 5, q75 number 16, counted from 0.
    assert (found["a"]["lower_bound"], found["a"]["upper_bound"]) == (4 - 16.5, 15 + 16.5)
    assert (found["b"]["count"], found["b"]["lower_bound"]) == (1, 1.0)
    total = outliers.outlier_total(df).first()
    assert (total["total_outlier_values"], total["total_outlier_rows"]) == (3, 2)


def test_a_column_without_numbers_has_zeros(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    row = outliers.outliers(df).where("column = 'a'").first()
    assert tuple(row) == ("a", "IQR", 0, 0.0, 0.0, 0.0)
    empty = spark.createDataFrame([], "a double")
    assert tuple(outliers.outlier_total(empty).first()) == (0, 0)
