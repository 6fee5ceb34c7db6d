import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest

from rowlens.operators.table import memory_estimate
from rowlens.sources import catalog, tables
from rowlens.sources.scratch import scratch_path

CSV = """id,flag,n,d,ts,mixed,empty
1,TRUE,1.5,2024-01-01,2024-01-01T00:00:00Z,a,
2,false,2,2024-01-02,2024-01-01T10:30:00.250Z,"say ""hi"", ok",

3,true,,2024-01-03,2024-01-02T00:00:00+01:00,7,
,,,,,,
"""


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_is_typed(spark, csv_path):
    df = tables.scan_csv(spark, csv_path)
    assert dict(df.dtypes) == {
        "id": "bigint",
        "flag": "boolean",
        "n": "double",
        "d": "string",
        "ts": "timestamp",
        "mixed": "string",
        "empty": "string",
    }
    rows = df.orderBy("id").collect()
    assert len(rows) == 4 and all(v is None for v in rows[0])
    assert [r["flag"] for r in rows[1:]] == [True, False, True]
    assert [r["n"] for r in rows[1:]] == [1.5, 2.0, None]
    assert rows[2]["mixed"] == 'say "hi", ok'
    assert df.selectExpr("date_format(max(ts), 'yyyy-MM-dd HH:mm') AS t").first()["t"] == "2024-01-01 23:00"


def test_no_cell_is_lost(spark, tmp_path):
    """Several files; the first thousands of rows say otherwise than the last ones."""
    for part in range(4):
        rows = [f"{2**53 + 1 + i},{i if part < 3 else 'text'},{10**20 + i},{i}.5,{2**53 + 1 + i if i % 2 else '0.5'}" for i in range(1500)]
        (tmp_path / f"{part}.csv").write_text("\n".join(["id,mixed,wide,half,both", *rows]))
    df = tables.scan_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"id": "bigint", "mixed": "string", "wide": "decimal(38,0)", "half": "double", "both": "string"}
    found = df.selectExpr("count(mixed) AS present", "count(distinct id) AS ids", "count(distinct wide) AS wide", "count_if(mixed = 'text') AS text").first()
    assert tuple(found) == (6000, 1500, 1500, 1500)


@pytest.mark.parametrize("torn", ['3,"a\nb",x', "3,a,x,more", "3"])
def test_malformed_rows_are_not_taken_silently(spark, tmp_path, torn):
    path = tmp_path / "torn.csv"
    path.write_text(f"n,s,t\n1,a,b\n{torn}\n4,c,d\n")
    with pytest.raises(ValueError, match="rows of .* do not have the cells"):
        tables.scan_csv(spark, str(path))
    kept = tables.scan_csv(spark, str(path), malformed="keep").collect()
    assert sum(r["_malformed"] is not None for r in kept) == len(kept) - 2 >= 1
    with pytest.raises(Exception, match="MALFORMED"):
        tables.scan_csv(spark, str(path), typed=False).collect()
    if "\n" in torn:
        assert [r["s"] for r in tables.scan_csv(spark, str(path), multi_line=True).orderBy("n").collect()] == ["a", "a\nb", "c"]


def test_csv_as_text(spark, csv_path):
    df = tables.scan_csv(spark, csv_path, typed=False)
    assert set(dict(df.dtypes).values()) == {"string"} and df.count() == 4


def test_scan_formats(spark, csv_path, tmp_path):
    stored = tables.ingest(tables.scan(spark, csv_path, "csv"), str(tmp_path / "p"))
    assert tables.scan(spark, str(tmp_path / "p"), "parquet").count() == stored.count() == 4
    with pytest.raises(ValueError):
        tables.scan(spark, csv_path, "xlsx")


@pytest.mark.parametrize("kind", tables.SINKS)
def test_sinks(spark, tmp_path, kind):
    path = str(tmp_path / "out")
    tables.write_table(spark.range(3), path, kind)
    assert spark.read.format(kind).option("header", True).load(path).count() == 3


def test_catalog(spark, tmp_path, csv_path):
    root = str(tmp_path / "root")
    first = catalog.register(tables.scan_csv(spark, csv_path), root, "my data.csv", source_path=csv_path)
    catalog.register(spark.range(10), root, "numbers.parquet", name="Numbers")
    assert first.count() == 4
    rows = catalog.catalog_list(catalog.read_catalog(spark, root)).collect()
    assert [r["name"] for r in rows] == ["Numbers", "my data"]
    assert (rows[1]["row_count"], rows[1]["column_count"], rows[1]["file_type"]) == (4, 7, "csv")
    assert rows[1]["file_size_bytes"] == len(CSV) and rows[1]["columns"][:2] == ["id", "flag"]
    summary = catalog.catalog_summary(catalog.read_catalog(spark, root)).first()
    assert (summary["total_datasets"], summary["total_rows"], summary["total_columns"]) == (2, 14, 8)
    assert catalog.catalog_recent(catalog.read_catalog(spark, root), 1).first()["name"] == "Numbers"


def test_a_repeated_registration_adds_nothing(spark, tmp_path):
    root = str(tmp_path / "root")
    for _ in range(3):
        stored = catalog.register(spark.range(10), root, "n.parquet", dataset_id="n")
    assert stored.count() == 10
    assert [r["row_count"] for r in catalog.read_catalog(spark, root).collect()] == [10]
    assert len(list((tmp_path / "root" / "data" / "n").iterdir())) == 1
    with pytest.raises(ValueError, match="stands for"):
        catalog.register(spark.range(10).withColumnRenamed("id", "other"), root, "n.parquet", dataset_id="n")
    with pytest.raises(ValueError, match="folder name"):
        catalog.register(spark.range(10), root, "n.parquet", dataset_id="_n")
    assert catalog.open_dataset(spark, root, "n").count() == 10
    with pytest.raises(KeyError):
        catalog.open_dataset(spark, root, "m")


@pytest.mark.parametrize("step", ["one_scan", "stored_bytes", "small_table"])
def test_a_registration_repeated_after_a_failure(spark, tmp_path, monkeypatch, step):
    """The table is written, its manifest is not: nothing is shown, and the next call completes it."""
    root = str(tmp_path / "root")
    catalog.register(spark.range(3), root, "before.parquet")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(catalog, step, fails)
        with pytest.raises(OSError):
            catalog.register(spark.range(10), root, "n.parquet", dataset_id="n")
    assert [r["name"] for r in catalog.read_catalog(spark, root).collect()] == ["before"]
    assert catalog.register(spark.range(10), root, "n.parquet", dataset_id="n").count() == 10
    assert sorted(r["name"] for r in catalog.read_catalog(spark, root).collect()) == ["before", "n"]


def test_a_write_that_was_not_committed_is_not_read(spark, tmp_path):
    root = tmp_path / "root"
    catalog.register(spark.range(3), str(root), "a.parquet", dataset_id="a")
    torn = root / "catalog" / "b" / "x" / "_temporary" / "0"
    torn.mkdir(parents=True)
    (torn / "part-0.parquet").write_bytes(b"PAR1")
    assert [r["id"] for r in catalog.read_catalog(spark, str(root)).collect()] == ["a"]


def test_registrations_at_the_same_time(spark, tmp_path):
    """None is lost, and two of one id are one dataset."""
    root = str(tmp_path / "root")
    with ThreadPoolExecutor(8) as pool:
        names = [f"t{i % 6}" for i in range(8)]
        found = list(pool.map(lambda n: catalog.register(spark.range(5), root, f"{n}.parquet", dataset_id=n).count(), names))
    assert found == [5] * 8
    assert sorted(r["id"] for r in catalog.read_catalog(spark, root).collect()) == sorted(set(names))


def test_memory_size_in_the_catalog(spark, tmp_path):
    root = str(tmp_path / "root")
    df = spark.range(100_000).selectExpr("id", "'x' AS s")
    catalog.register(df, root, "t.parquet")
    expected = df.transform(memory_estimate).first()["memory_mb"]
    assert catalog.read_catalog(spark, root).first()["memory_size_mb"] == expected > 1


def test_a_store_without_datasets(spark, tmp_path):
    assert catalog.read_catalog(spark, str(tmp_path / "none")).count() == 0


def test_an_empty_catalog(spark):
    empty = spark.createDataFrame([], catalog.CATALOG_SCHEMA)
    assert tuple(catalog.catalog_summary(empty).first()) == (0, 0, 0, None)


def test_catalog_of_tables(spark):
    rows = catalog.catalog_of({"a": spark.range(2), "b": spark.range(3)}, dict.fromkeys("ab", dt.datetime(2024, 1, 1)))
    assert {r["id"]: r["row_count"] for r in rows.collect()} == {"a": 2, "b": 3}


def test_file_names():
    assert catalog.plain_name("a.b.csv") == "a.b" and catalog.plain_name("plain") == "plain"
    assert catalog.file_type_of("x.CSV") == "csv"


def test_scratch_paths_lie_below_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "t")
    assert path != scratch_path(spark, "t")
    assert named is None or path.startswith(named)
