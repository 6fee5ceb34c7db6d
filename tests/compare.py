"""Runs registered queries beside their SQL and reports the first difference."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from rowlens.registry.tables import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    return str(value)


def difference(df, con, sql: str) -> str | None:
    """None where columns, rows and values agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    ours = sorted(tuple(_key(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(_key(r[names.index(c)]) for c in order) for r in expected)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{dict(zip(order, a))} != {dict(zip(order, b))}"
    return None


def main() -> int:
    """python -m tests.compare <sf_dir> [query ...]"""
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            found = difference(query(spark, sf_dir), con, sql[name]) if name in sql else "no SQL"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:400]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'BAD '} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
