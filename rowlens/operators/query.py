"""The query builder: filters, one grouping with one aggregate, one sort key, a limit."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions.cells import NUMBER_PATTERN, column, data_type, is_missing, is_text, number
from rowlens.functions.small import pinned

COMPARISONS = ("gt", "gte", "lt", "lte")
OPERATORS = ("eq", "neq", *COMPARISONS, "contains", "not_contains", "is_null", "not_null")
AGGREGATIONS = ("count", "sum", "mean", "min", "max")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: str | int | float | bool | dt.date | dt.datetime | None = None


def _is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _number_literal(value) -> int | float | None:
    """The number a filter value stands for, None where it is not one."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return value
    text = str(value)
    if not re.match(NUMBER_PATTERN, text):
        return None
    return int(text) if re.fullmatch(r"\s*[+-]?\d{1,18}\s*", text) else float(text)


def _text_literal(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return "" if value is None else str(value)


def _literal(df: DataFrame, f: Filter) -> Column | None:
    """The filter value in the column's own type, so that the cell is compared as it is; None where nothing equals it."""
    dtype = data_type(df, f.column)
    if isinstance(dtype, T.NumericType):
        value = _number_literal(f.value)
        if value is None:
            return None
        return F.lit(value).cast(dtype) if isinstance(dtype, (T.FloatType, T.DoubleType)) else F.lit(value)
    if isinstance(dtype, T.BooleanType):
        return {"true": F.lit(True), "false": F.lit(False)}.get(_text_literal(f.value))
    return _moment(f, dtype) if _is_temporal(dtype) else F.lit(_text_literal(f.value))


def _moment(f: Filter, dtype: T.DataType) -> Column:
    """The filter value as a date or timestamp, parsed here once."""
    value = f.value
    try:
        if isinstance(value, str):
            value = dt.datetime.fromisoformat(value.strip())
        elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
            value = dt.datetime(value.year, value.month, value.day)
        text = value.isoformat(sep=" ")
    except (ValueError, AttributeError):
        raise ValueError(f"{f.value!r} is not a date or time, as column {f.column!r} needs") from None
    if isinstance(dtype, T.DateType) and value.time() == dt.time():
        return F.lit(value.date())
    kind = "timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz"
    return F.lit(text).cast(kind)


def _compared(df: DataFrame, f: Filter, null_policy: str) -> Column:
    cell, dtype = column(f.column), data_type(df, f.column)
    if _is_temporal(dtype):
        return _ordering(cell, f.operator, _moment(f, dtype))
    value = _number_literal(f.value)
    if value is None:
        return F.lit(False)
    if not isinstance(dtype, T.NumericType) or null_policy == "zero":
        return _ordering(number(df, f.column, null_policy), f.operator, F.lit(value))
    compared = _ordering(cell, f.operator, F.lit(value))
    # Spark puts NaN above every number.
    if isinstance(dtype, (T.DoubleType, T.FloatType)) and f.operator in ("gt", "gte"):
        compared = compared & ~F.isnan(cell)
    return compared


def _ordering(cell: Column, operator: str, value: Column) -> Column:
    return {"gt": cell > value, "gte": cell >= value, "lt": cell < value, "lte": cell <= value}[operator]


def condition(df: DataFrame, f: Filter, null_policy: str = "skip") -> Column:
    """Row condition of one filter. A missing cell passes only neq, not_contains and is_null."""
    if f.operator not in OPERATORS:
        raise ValueError(f"unknown operator {f.operator!r}; use one of {OPERATORS}")
    cell = column(f.column)
    if f.operator == "is_null":
        return is_missing(df, f.column)
    if f.operator == "not_null":
        return ~is_missing(df, f.column)
    if f.operator in ("eq", "neq"):
        value = _literal(df, f)
        if value is None:
            return F.lit(f.operator == "neq")
        return cell == value if f.operator == "eq" else ~cell.eqNullSafe(value)
    if f.operator in COMPARISONS:
        return _compared(df, f, null_policy)
    holds = F.lower(cell.cast("string")).contains(F.lower(F.lit(_text_literal(f.value))))
    return holds if f.operator == "contains" else ~F.coalesce(holds, F.lit(False))


def apply_filters(df: DataFrame, filters: list[Filter], null_policy: str = "skip") -> DataFrame:
    """Rows that pass every filter."""
    kept = df
    for f in filters:
        kept = kept.where(condition(df, f, null_policy))
    return kept


def aggregate(
    df: DataFrame,
    group_by: str,
    aggregation: str | None = None,
    agg_column: str | None = None,
    null_policy: str = "skip",
) -> DataFrame:
    """Rows per value of one column, null being a value too, and one aggregate of another column."""
    data_type(df, group_by)
    figures = [F.count(F.lit(1)).alias("count")]
    if aggregation is not None and aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {aggregation!r}; use one of {AGGREGATIONS}")
    if aggregation not in (None, "count"):
        if agg_column is None:
            raise ValueError(f"{aggregation} needs agg_column")
        x = number(df, agg_column, null_policy)
        figure = {
            "sum": F.coalesce(F.sum(x), F.lit(0.0)),
            "mean": F.avg(x),
            "min": F.min(x),
            "max": F.max(x),
        }[aggregation]
        figures.append(figure.alias(f"{aggregation}_{agg_column}"))
    return df.groupBy(column(group_by)).agg(*figures)


def sort_rows(df: DataFrame, sort_by: str, sort_dir: str = "asc", locale: bool = False) -> DataFrame:
    """Order by one column, nulls last; the other columns settle ties.

    ``locale`` orders text by the Unicode collation instead of by code point.
    """
    if sort_dir not in ("asc", "desc"):
        raise ValueError("sort_dir must be asc or desc")
    key = column(sort_by)
    if locale and is_text(data_type(df, sort_by)):
        key = F.collate(key, "UNICODE")
    data_type(df, sort_by)
    first = key.desc_nulls_last() if sort_dir == "desc" else key.asc_nulls_last()
    return df.orderBy(first, *[column(c).asc_nulls_last() for c in df.columns if c != sort_by])


def limit_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The first rows; all of them without a limit."""
    if limit is None:
        return df
    if limit < 0:
        raise ValueError("limit must not be negative")
    return df.limit(limit)


@dataclass(frozen=True)
class QueryResult:
    """The limited rows, and the rows there are without the limit, counted only when asked."""

    rows: DataFrame
    unlimited: DataFrame = field(repr=False)
    order: Callable[[DataFrame], DataFrame] | None = field(default=None, repr=False)
    limit: int | None = None

    @property
    def columns(self) -> list[str]:
        return self.rows.columns

    def total_count(self) -> int:
        return self.unlimited.count()

    def fetch(self) -> tuple[DataFrame, int]:
        """The limited rows as a local relation, and total_count.

        Sorted rows are counted on their way to the sort, so both come from one scan. Without an order Spark stops reading
        at the limit, and the rows are counted by a scan of their own.
        """
        if self.limit is None:
            raise ValueError("only a limited number of rows is fetched")
        if self.order is None or self.limit == 0:
            return pinned(self.rows), self.total_count()
        seen = Observation()
        counted = self.unlimited.observe(seen, F.count(F.lit(1)).alias("rows"))
        found = pinned(limit_rows(self.order(counted), self.limit))
        return found, seen.get["rows"]


def run_query(
    df: DataFrame,
    filters: list[Filter] | None = None,
    group_by: str | None = None,
    aggregation: str | None = None,
    agg_column: str | None = None,
    sort_by: str | None = None,
    sort_dir: str = "asc",
    limit: int | None = None,
    null_policy: str = "skip",
    locale: bool = False,
) -> QueryResult:
    """Filter, group, sort and limit, in this order; without a limit all rows are returned."""
    result = apply_filters(df, filters or [], null_policy)
    if group_by is not None:
        result = aggregate(result, group_by, aggregation, agg_column, null_policy)
    elif aggregation is not None or agg_column is not None:
        raise ValueError("an aggregation needs group_by")
    if sort_by is None:
        return QueryResult(limit_rows(result, limit), result, None, limit)

    def order(rows: DataFrame) -> DataFrame:
        return sort_rows(rows, sort_by, sort_dir, locale)

    return QueryResult(limit_rows(order(result), limit), result, order, limit)
