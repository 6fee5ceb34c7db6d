"""Whole-table facts: shape, missing cells, duplicate rows, size, preview."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions.cells import column, data_type, is_missing, is_text, json_length, percent
from rowlens.functions.small import small_table
from rowlens.operators.passes import ROWS, keyed, one_scan
from rowlens.operators.schema import check_scalar_columns
from rowlens.sources.scratch import scratch_path

PREVIEW_ROWS = 50
# Text cells shorter than a SHA-256 digest are compared as they are, longer ones by digest.
_DIGEST_BYTES = 32
# Shared digests that are broadcast: 16 bytes each.
MOST_SHARED = 200_000


def missing_state(df: DataFrame, name: str) -> list[Column]:
    """The state of a column's missing cells, for a scan that several operators share."""
    return [F.count_if(is_missing(df, name)).alias("missing")]


def rows_state() -> list[Column]:
    return [F.count(F.lit(1)).alias("rows")]


def count_missing(df: DataFrame, columns: list[str] | None = None) -> tuple[int, list[tuple[str, int]]]:
    """Row count and (column, missing cells), in table order."""
    columns = df.columns if columns is None else columns
    found = one_scan(df, {("rows",): rows_state(), **{c: missing_state(df, c) for c in columns}})
    return found[("rows",)]["rows"], [(c, found[c]["missing"]) for c in columns]


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing cells per column; empty text counts as missing."""
    _, counts = count_missing(df, columns)
    return small_table(df.sparkSession, counts, "column string, null_count long")


def missing_table(df: DataFrame, rows: int, counts: list[tuple[str, int]]) -> DataFrame:
    found = [(c, n, rows) for c, n in counts if n > 0]
    return (
        small_table(df.sparkSession, found, "column string, count long, rows long")
        .select("column", "count", percent(F.col("count"), F.col("rows")).alias("pct"))
        .orderBy(F.col("pct").desc(), "column")
    )


def missing_values(df: DataFrame, columns: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Columns with missing cells, the emptiest first; ``k`` keeps the first k for a report."""
    rows, counts = count_missing(df, columns)
    table = missing_table(df, rows, counts)
    return table if k is None else table.limit(k)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)).cast("long"))


def _row_key(df: DataFrame, name: str) -> Column:
    """Grouping key of at most 32 bytes for a text cell, the cell itself otherwise.

    Cells of 32 bytes and more are replaced by their SHA-256 digest. Shorter ones keep their bytes
    and so can never be taken for a digest.
    """
    cell = column(name)
    if not is_text(data_type(df, name)):
        return cell
    short = F.octet_length(cell) < _DIGEST_BYTES
    return F.when(short, cell.cast("binary")).otherwise(F.unhex(F.sha2(cell, 256)))


def _digested(df: DataFrame) -> list[Column]:
    """What a digest takes of a row: its cells and which of them are null."""
    cells = []
    for c in df.columns:
        cell = column(c)
        # Digests pass over nulls; -0.0 and 0.0 are one value.
        cells += [cell.isNull(), cell + F.lit(0).cast(data_type(df, c)) if isinstance(data_type(df, c), (T.DoubleType, T.FloatType)) else cell]
    return cells


def row_keys(df: DataFrame) -> list[Column]:
    """Entry of a grouped scan: each row as a 128-bit digest of its cells and of which of them are null."""
    cells = _digested(df)
    return [keyed(ROWS, k1=F.xxhash64(F.lit(1), *cells), k2=F.xxhash64(F.lit(2), *cells))]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows whose whole content occurred before: every copy but the first.

    Identical rows are combined before the shuffle, and long text crosses it as a digest.
    """
    check_scalar_columns(df)
    keys = [_row_key(df, c).alias(f"key_{i}") for i, c in enumerate(df.columns)]
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0).cast("long")).alias("duplicate_rows"),
        F.coalesce(F.sum("copies"), F.lit(0).cast("long")).alias("rows"),
    )


def repeated_rows(df: DataFrame) -> int:
    """The duplicate_rows of a large table: only rows that share a 64-bit digest with another are compared cell by cell.

    A table of distinct rows shuffles a digest a row and is done. Where more than MOST_SHARED digests are shared, all rows
    are compared, since as many digests are no longer broadcast.
    """
    check_scalar_columns(df)
    digest = F.xxhash64(*_digested(df))
    copies = df.groupBy(digest.alias("_digest")).agg(F.count(F.lit(1)).alias("copies"))
    path = scratch_path(df.sparkSession, "shared")
    copies.where(F.col("copies") > 1).select("_digest").write.parquet(path)
    shared = df.sparkSession.read.schema("_digest long").parquet(path)
    held = shared.count()
    if not held:
        return 0
    rows = df.join(F.broadcast(shared), digest == F.col("_digest"), "left_semi") if held <= MOST_SHARED else df
    return duplicate_rows(rows).first()["duplicate_rows"]


def json_state(df: DataFrame) -> list[Column]:
    """The state of the table's size, for a scan that several operators share: its length as one JSON array of objects."""
    row = F.lit(sum(len(_json_name(c)) + 1 for c in df.columns) + len(df.columns) + 1).cast("long")
    for c in df.columns:
        row = row + json_length(df, c)
    return [F.when(F.count(F.lit(1)) > 0, F.sum(row + 1) + 1).otherwise(2).cast("long").alias("json_chars")]


def megabytes(json_chars: Column) -> Column:
    """Two decimals, halves up, in whole numbers: 2 bytes per unit, 1024 * 1024 bytes per MB."""
    return F.floor((json_chars * 2 * 100) / F.lit(1024 * 1024) + 0.5).cast("double") / 100


def size_in_mb(json_chars: int) -> float:
    """The same of a length at hand."""
    return math.floor(json_chars * 2 * 100 / (1024 * 1024) + 0.5) / 100


def memory_estimate(df: DataFrame) -> DataFrame:
    """Length of the table as one JSON array of objects, and its size at two bytes per unit."""
    check_scalar_columns(df)
    return df.agg(*json_state(df)).withColumn("memory_mb", megabytes(F.col("json_chars")))


def _json_name(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def preview(df: DataFrame, order_by: list[str] | None = None, k: int = PREVIEW_ROWS) -> DataFrame:
    """First k rows in the stated order; arbitrary rows where none is stated."""
    ordered = df.orderBy(*[column(c) for c in order_by]) if order_by else df
    return ordered.limit(k)
