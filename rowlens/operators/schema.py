"""Semantic column types, and the projections that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions.cells import NUMBER_PATTERN, column, is_missing, is_text
from rowlens.functions.small import small_table
from rowlens.operators.passes import aggregate_each

# Fixed values of the inference rule.
BOOLEAN_SHARE = 0.9
NUMERIC_SHARE = 0.8
BOOLEAN_WORDS = ("true", "false")
DATE_TIME_PATTERN = (
    r"^\d{4}-[01]\d-[0-3]\dT[0-2]\d:[0-5]\d(:[0-5]\d(\.\d+)?)?([+-][0-2]\d:[0-5]\d|Z)$"
)

TYPES_SCHEMA = "position int, column string, spark_type string, semantic_type string"

# Text columns judged by one aggregate.
_BATCH = 8

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def check_scalar_columns(df: DataFrame) -> None:
    """Cells are scalars: nested and binary columns are refused by name."""
    nested = [f"{f.name} ({f.dataType.simpleString()})" for f in df.schema.fields if isinstance(f.dataType, _NESTED)]
    if nested:
        raise TypeError("only scalar columns can be profiled; drop or flatten: " + ", ".join(nested))


def _declared_type(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return None if is_text(dtype) else "categorical"


def semantic_types(df: DataFrame, boolean_words: tuple[str, ...] = BOOLEAN_WORDS) -> dict[str, str]:
    """Semantic type of every column, in table order.

    Typed columns follow their declared type. Text columns are judged by the shares of all their cells, in one
    scan. Text of full ISO date-times is of type date.
    """
    found = declared_types(df)
    texts = [name for name, kind in found.items() if kind is None]
    for name, counts in zip(texts, aggregate_each(df, [shares(df, c, boolean_words) for c in texts], _BATCH)):
        found[name] = judged_type(counts)
    return found


def declared_types(df: DataFrame) -> dict[str, str | None]:
    """Semantic type of every column that its declared type settles; null for text, which its cells have to show."""
    check_scalar_columns(df)
    return {f.name: _declared_type(f.dataType) for f in df.schema.fields}


def shares(df: DataFrame, name: str, boolean_words: tuple[str, ...] = BOOLEAN_WORDS) -> list[Column]:
    """Counts of a text column's present cells, and of those that are numbers, booleans or date-times."""
    cell, present = column(name), ~is_missing(df, name)
    return [
        F.count_if(present).alias("present"),
        F.count_if(present & cell.rlike(NUMBER_PATTERN)).alias("numbers"),
        F.count_if(present & cell.isin(*boolean_words)).alias("words"),
        F.count_if(present & cell.rlike(DATE_TIME_PATTERN)).alias("dates"),
    ]


def judged_type(counts: Row) -> str:
    """Semantic type that the shares of a text column stand for."""
    present, numbers, words, dates = (counts[c] for c in ("present", "numbers", "words", "dates"))
    if present == 0:
        return "categorical"
    if words / present > BOOLEAN_SHARE:
        return "boolean"
    if numbers / present > NUMERIC_SHARE:
        return "numeric"
    return "date" if dates / present > NUMERIC_SHARE else "categorical"


def infer_types(df: DataFrame) -> DataFrame:
    """One row per column: position, column, spark_type, semantic_type."""
    kinds = semantic_types(df)
    rows = [(i, f.name, f.dataType.simpleString(), kinds[f.name]) for i, f in enumerate(df.schema.fields)]
    return small_table(df.sparkSession, rows, TYPES_SCHEMA)


def numeric_columns(df: DataFrame, types: dict[str, str] | None = None) -> list[str]:
    types = types or semantic_types(df)
    return [c for c in df.columns if types[c] == "numeric"]


def categorical_columns(df: DataFrame, types: dict[str, str] | None = None) -> list[str]:
    """Every column that is not numeric; boolean and date columns are profiled as categories."""
    types = types or semantic_types(df)
    return [c for c in df.columns if types[c] != "numeric"]


def project_numeric(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    return df.select(*[column(c) for c in numeric_columns(df, types)])
