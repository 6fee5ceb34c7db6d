"""The report on one column, on all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.functions.cells import column, percent
from rowlens.functions.small import small_table
from rowlens.operators import categorical, numeric, schema, table


def column_overview(df: DataFrame, name: str, types: dict[str, str] | None = None) -> DataFrame:
    """One row: column, dtype, null_count, null_pct, unique_count."""
    one = df.select(name)
    dtype = (types or schema.semantic_types(one))[name]
    rows, [(_, missing)] = table.count_missing(df, [name])
    unique = categorical.unique_count(df, [name])
    facts = small_table(
        df.sparkSession, [(name, dtype, missing, rows)], "column string, dtype string, null_count long, rows long"
    )
    return facts.join(F.broadcast(unique), "column", "left").select(
        "column",
        "dtype",
        "null_count",
        percent(F.col("null_count"), F.col("rows")).alias("null_pct"),
        F.coalesce("unique_count", F.lit(0).cast("long")).alias("unique_count"),
    )


def numeric_column(df: DataFrame, name: str, null_policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Statistics and histogram of a numeric column."""
    stats, bins, _ = numeric.numeric_with_histogram(df, [name], null_policy)
    return stats, bins


def categorical_column(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Profile and top values of any other column."""
    return categorical.frequencies(df, [name], df.count())


@dataclass(frozen=True)
class ColumnReport:
    """All that is known of one column."""

    overview: DataFrame
    statistics: DataFrame  # the numeric or the categorical profile
    distribution: DataFrame  # the histogram of numbers, the top values of others
    samples: DataFrame  # the first distinct values in the stated order


def column_report(df: DataFrame, name: str, order_by: list[str], null_policy: str = "skip", samples: int = 10) -> ColumnReport:
    """The deep dive into one column, by its semantic type."""
    types = schema.semantic_types(df.select(column(name)))
    numbers = types[name] == "numeric"
    found, spread = numeric_column(df, name, null_policy) if numbers else categorical_column(df, name)
    return ColumnReport(column_overview(df, name, types), found, spread, categorical.sample_values(df, name, order_by, samples))
