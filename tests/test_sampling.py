import math

import pytest

from rowlens.operators import sampling
from rowlens.operators.sampling import systematic_sample


def expected(rows, size):
    return [rows[math.floor(i * (len(rows) / size))] for i in range(size)]


@pytest.mark.parametrize("n", [50_000, 50_001, 123_457])
def test_default_size(spark, n):
    df = spark.range(n).selectExpr("id", "id * 2 AS x").repartition(5)
    found = sorted(r["id"] for r in systematic_sample(df, ["id"]).collect())
    assert found == (list(range(n)) if n <= 50_000 else expected(list(range(n)), 50_000))


@pytest.mark.parametrize("size", [1, 7, 100, 999])
def test_ties_are_ordered_by_the_other_columns(spark, size):
    """A third of all rows share one key, and some rows are identical."""
    df = spark.range(1000).selectExpr("IF(id % 3 = 0, 5, id % 11) AS k", "id % 50 AS x", "string(id % 4) AS s")
    rows = sorted(tuple(r) for r in df.collect())
    found = sorted(tuple(r) for r in systematic_sample(df.repartition(6), ["k"], size).collect())
    assert found == sorted(expected(rows, size))


def test_null_keys(spark):
    df = spark.range(10).selectExpr("IF(id < 5, NULL, id) AS k", "id AS x")
    assert sorted(r["x"] for r in systematic_sample(df, ["k"], 5).collect()) == [0, 2, 4, 6, 8]


def test_one_key_holds_the_table(spark):
    """No window over the key: its rows are sorted by all columns, identical ones combined."""
    df = spark.range(30_000).selectExpr("1 AS k", "id % 7000 AS x")
    found = systematic_sample(df.repartition(8), ["k"], 999)
    rows = sorted(tuple(r) for r in df.collect())
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, 999)


def test_order_by_all_columns(spark):
    df = spark.range(300).selectExpr("id % 10 AS k", "id % 3 AS x")
    rows = sorted(tuple(r) for r in df.collect())
    assert sorted(tuple(r) for r in systematic_sample(df.repartition(3), ["k", "x"], 70).collect()) == expected(rows, 70)


def test_null_ties(spark):
    df = spark.range(100).selectExpr("IF(id < 60, NULL, 1) AS k", "IF(id % 3 = 0, NULL, id) AS x")
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, v or 0) for v in r])
    found = [tuple(r) for r in systematic_sample(df.repartition(3), ["k"], 30).collect()]
    assert sorted(found, key=str) == sorted(expected(rows, 30), key=str)


def test_size_is_checked(spark):
    with pytest.raises(ValueError):
        systematic_sample(spark.range(3), ["id"], 0)


def test_rows_far_from_the_sampled_ones_are_not_sorted(spark, monkeypatch):
    """What is sorted is written: counts of steps of the key, and the rows of the steps that hold a sampled position."""
    written, sorted_rows = sampling._written, []

    def counted(df, name):
        table = written(df, name)
        sorted_rows.append(table.count())
        return table

    monkeypatch.setattr(sampling, "_written", counted)
    df = spark.range(40_000).selectExpr("id DIV 4 AS k", "id * 7 % 40000 AS x").repartition(5)
    rows = sorted(tuple(r) for r in df.collect())
    assert sorted(tuple(r) for r in systematic_sample(df, ["k"], 40).collect()) == expected(rows, 40)
    assert sum(sorted_rows) < 5_000


_NUMBERS = {
    "doubles": "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN double('NaN') WHEN id % 50 = 2 THEN double('Infinity') "
    "WHEN id % 50 = 3 THEN double('-Infinity') WHEN id % 50 = 4 THEN -0.0D ELSE double(id * 37 % 1000 - 500) / 3 END",
    "wide doubles": "CASE WHEN id = 7 THEN -1.7e308D WHEN id = 8 THEN 1.7e308D ELSE double(id * 37 % 3000) END",
    "longs beyond doubles": "9007199254740993 + id * 37 % 3000",
    "decimals": "decimal(id * 37 % 3000) / 7",
    "dates": "date_add(date'1970-01-01', int(id * 37 % 3000) - 1500)",
    "timestamps": "timestamp_micros(id * 37 % 3000 * 1000003 - 1000000000)",
    "texts": "string(id * 37 % 3000)",
    "one value": "int(5)",
    "nulls": "int(NULL)",
}


@pytest.mark.parametrize("size", [9, 900])
@pytest.mark.parametrize("name", _NUMBERS)
def test_kinds_of_keys(spark, name, size):
    """Positions are those of the whole sorted table, whichever rows are sorted to find them."""
    df = spark.range(3000).selectExpr(f"{_NUMBERS[name]} AS k", "id % 700 AS x").repartition(3)
    rows = [str(tuple(r)) for r in df.coalesce(1).sortWithinPartitions("k", "x").selectExpr("string(k + 0) AS k" if "doubles" in name else "string(k) AS k", "x").collect()]
    found = systematic_sample(df, ["k"], size).selectExpr("string(k + 0) AS k" if "doubles" in name else "string(k) AS k", "x")
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(expected(rows, size))
