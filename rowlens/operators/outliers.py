"""Outliers beyond 1.5 interquartile ranges from the quartiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.functions.cells import number, percent, round_half
from rowlens.functions.labels import outlier_severity
from rowlens.functions.small import small_table
from rowlens.operators.numeric import Quartiles, locate_quartiles
from rowlens.operators.passes import aggregate_each
from rowlens.operators.schema import numeric_columns

FENCE = 1.5
_BATCH = 8


def fences(found: dict[str, Quartiles]) -> dict[str, tuple[float, float]]:
    out = {}
    for name, q in found.items():
        if q.q25 is not None:
            reach = FENCE * (q.q75 - q.q25)
            out[name] = (q.q25 - reach, q.q75 + reach)
    return out


def _outside(df: DataFrame, name: str, limits: tuple[float, float], null_policy: str):
    x = number(df, name, null_policy)
    return F.coalesce((x < F.lit(limits[0])) | (x > F.lit(limits[1])), F.lit(False))


def _limits(df, columns, null_policy, quartiles):
    if quartiles is None:
        quartiles = locate_quartiles(df, columns, null_policy)
    return fences(quartiles)


def outliers(
    df: DataFrame,
    columns: list[str] | None = None,
    null_policy: str = "skip",
    quartiles: dict[str, Quartiles] | None = None,
) -> DataFrame:
    """Per numeric column: method, count and pct of values outside the fences, and the fences.

    ``quartiles`` takes those of a profile already at hand, and saves their scans.
    """
    columns = numeric_columns(df) if columns is None else columns
    limits = _limits(df, columns, null_policy, quartiles)
    inside = [c for c in columns if c in limits]
    figures = [
        [
            F.count_if(_outside(df, c, limits[c], null_policy)).alias("outside"),
            F.count(number(df, c, null_policy)).alias("valid"),
        ]
        for c in inside
    ]
    counted = {c: (r["outside"], r["valid"]) for c, r in zip(inside, aggregate_each(df, figures, _BATCH))}
    rows = [(c, *counted.get(c, (0, 0)), *limits.get(c, (0.0, 0.0))) for c in columns]
    schema = "column string, count long, valid long, lower double, upper double"
    return small_table(df.sparkSession, rows, schema).select(
        "column",
        F.lit("IQR").alias("method"),
        "count",
        F.coalesce(percent(F.col("count"), F.col("valid")), F.lit(0.0)).alias("pct"),
        round_half(F.col("lower"), 4).alias("lower_bound"),
        round_half(F.col("upper"), 4).alias("upper_bound"),
    )


def outlier_total(
    df: DataFrame,
    columns: list[str] | None = None,
    null_policy: str = "skip",
    quartiles: dict[str, Quartiles] | None = None,
) -> DataFrame:
    """total_outlier_values over all columns, and total_outlier_rows with one such value or more."""
    columns = numeric_columns(df) if columns is None else columns
    limits = _limits(df, columns, null_policy, quartiles)
    flags = [_outside(df, c, limits[c], null_policy) for c in columns if c in limits]
    if not flags:
        return small_table(df.sparkSession, [(0, 0)], "total_outlier_values long, total_outlier_rows long")
    values = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    per_row = df.select(values.alias("values"))
    return per_row.agg(
        F.coalesce(F.sum("values"), F.lit(0)).cast("long").alias("total_outlier_values"),
        F.count_if(F.col("values") > 0).alias("total_outlier_rows"),
    )


def with_severity(table: DataFrame) -> DataFrame:
    return table.withColumn("severity", outlier_severity(F.col("pct")))
