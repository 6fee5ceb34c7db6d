"""Tables of the reports, and the bundle of all results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions.cells import round_half
from rowlens.functions.small import small_table
from rowlens.operators import correlation, outliers
from rowlens.plans import quality
from rowlens.plans.eda import Profile

META_SCHEMA = (
    "exported_at timestamp, dataset_id string, dataset_name string, original_name string, row_count long, "
    "column_count long, file_type string"
)
BUNDLE_PARTS = (
    "meta",
    "overview",
    "numeric",
    "histogram",
    "categorical",
    "top_values",
    "missing",
    "quality_score",
    "snapshot",
    "correlation",
    "outliers",
)


def _positioned(profile: Profile, df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(profile.columns.select("column", "position")), "column").orderBy("position")


def _first(df: DataFrame, k: int | None) -> DataFrame:
    return df if k is None else df.limit(k)


def overview(profile: Profile) -> DataFrame:
    """(metric, value) rows of the table's composition."""
    names = [
        "rows",
        "cols",
        "numeric_columns",
        "categorical_columns",
        "duplicate_rows",
        "missing_columns",
        "memory_mb",
    ]
    doubles = profile.overview.select(*[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot([], names, "metric", "value")


def numeric_table(profile: Profile, k: int | None = None, places: int = 3) -> DataFrame:
    def shown(name: str) -> Column:
        return F.coalesce(round_half(F.col(name), places), F.lit(0.0)).alias(name)

    figures = ["mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis"]
    table = _positioned(profile, profile.numeric).select("column", *[shown(f) for f in figures], "null_count")
    return _first(table, k)


def categorical_table(profile: Profile, k: int | None = None) -> DataFrame:
    """Profile of each categorical column with its first and second value."""

    def ranked(rank: int, name: str) -> DataFrame:
        rows = profile.top_values.where(F.col("rank") == rank)
        share = round_half(F.col("pct"), 1).alias(f"{name}_pct")
        return F.broadcast(rows.select("column", F.col("value").alias(f"{name}_value"), share))

    table = (
        profile.categorical.join(ranked(1, "top"), "column", "left")
        .join(ranked(2, "second"), "column", "left")
        .withColumn("entropy", round_half(F.col("entropy"), 3))
    )
    return _first(_positioned(profile, table).drop("position"), k)


def missing_report(profile: Profile, k: int | None = None) -> DataFrame:
    shown = round_half(F.col("pct"), 1).alias("pct")
    return _first(profile.missing.orderBy(F.col("pct").desc(), "column"), k).select("column", "count", shown)


def outlier_table(profile: Profile, df: DataFrame, k: int | None = None, null_policy: str = "skip") -> DataFrame:
    found = outliers.outliers(df, list(profile.quartiles), null_policy, profile.quartiles)
    return _first(_positioned(profile, outliers.with_severity(found)).drop("position"), k)


def column_directory(profile: Profile) -> DataFrame:
    """Numeric columns, then the others: type, missing cells, distinct values of the latter."""
    numbers = profile.numeric.select(
        "column", F.lit("Numeric").alias("type"), "null_count", F.lit(None).cast("long").alias("unique_count")
    )
    others = profile.categorical.select("column", F.lit("Categorical").alias("type"), "null_count", "unique_count")
    return _positioned(profile, numbers.unionByName(others)).orderBy(F.col("type").desc(), "position").drop("position")


def bundle(
    df: DataFrame,
    dataset: str,
    profile: Profile | None = None,
    with_correlation: bool = True,
    with_outliers: bool = True,
    null_policy: str = "skip",
    entry: Row | None = None,
    exported_at: dt.datetime | None = None,
) -> DataFrame:
    """One nested row of all results: a list of result rows per part, null where not computed.

    Every part holds a few rows per column; none of the table's own rows is in it. ``meta`` says what was exported and
    when, in the words of the catalog's ``entry`` where one is given.
    """
    columns = list(profile.quartiles) if profile else None
    known = entry.asDict() if entry else {"name": dataset, "column_count": len(df.columns)}
    if profile is not None:
        known.setdefault("row_count", profile.overview.first()["rows"])
    named = [known.get(f) for f in ("id", "name", "original_name", "row_count", "column_count", "file_type")]
    meta = small_table(df.sparkSession, [(exported_at or dt.datetime.now(dt.timezone.utc), *named)], META_SCHEMA)
    parts: dict[str, DataFrame] = {}
    if profile is not None:
        parts = {
            "overview": profile.overview,
            "numeric": profile.numeric,
            "histogram": profile.histogram,
            "categorical": profile.categorical,
            "top_values": profile.top_values,
            "missing": profile.missing,
            "quality_score": quality.quality_score(profile),
            "snapshot": quality.snapshot(profile),
        }
    parts["meta"] = meta
    if with_correlation:
        parts["correlation"] = correlation.correlation_pairs(df, columns, null_policy)
    if with_outliers:
        found = profile.quartiles if profile else None
        parts["outliers"] = outliers.outliers(df, columns, null_policy, found)

    fields = [T.StructField("dataset", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType()))]
    values: list = [dataset, df.columns]
    for name in BUNDLE_PARTS:
        part = parts.get(name)
        kind = T.StringType() if part is None else T.ArrayType(part.schema)
        fields.append(T.StructField(name, kind))
        values.append(None if part is None else [r.asDict(recursive=True) for r in part.collect()])
    return small_table(df.sparkSession, [tuple(values)], T.StructType(fields))
