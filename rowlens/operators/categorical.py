"""Frequency tables, distinct counts and entropy, all from one table of counted keys that holds no long text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.functions.cells import column, percent, round_half, value_text
from rowlens.functions.small import pinned, small_table
from rowlens.operators.passes import HEAD, kept, keyed, value_key
from rowlens.operators.schema import categorical_columns

TOP_VALUES = 20

PROFILE_SCHEMA = "column string, unique_count long, null_count long, entropy double"
# Rows that a round of sample_values takes for each value asked for.
_FIRST_ROWS = 8

TOP_SCHEMA = "column string, rank int, value string, count long, pct double"


def value_keys(df: DataFrame, columns: list[str], start: int = 0) -> list[Column]:
    """Entries of a grouped scan: the values of all columns, as parts from ``start``."""
    return [keyed(start + i, value=value_text(df, c)) for i, c in enumerate(columns)]


def _values(df: DataFrame, cells: dict[int, Column]) -> DataFrame:
    """(part, value) of every row and part."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(part).alias("part"), cell.alias("value")) for part, cell in cells.items()])))


def _with_keys(values: DataFrame) -> DataFrame:
    return values.select("part", *[k.alias(name) for k, name in zip(value_key(F.col("value")), ("k1", "k2", "head"))], "value")


def key_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(part, k1, k2, head, n) of every distinct value, part being the column's place; null keys count the missing cells.

    Counts are combined before the shuffle, so a value held by most rows costs one row per task, and no text of more
    than HEAD characters leaves the scan.
    """
    values = _values(df, {i: value_text(df, c) for i, c in enumerate(columns)})
    return _with_keys(values).groupBy("part", "k1", "k2", "head").agg(F.count(F.lit(1)).alias("n"))


def _named(columns: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("part") + 1).alias("column")


def _summary(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: unique_count, null_count and entropy.

    With c the count of a value and n the sum of the counts, the entropy is
    log2(n) - sum(c * log2(c)) / n, which needs no second pass for n.
    """
    present = F.col("head").isNotNull()
    c = F.col("n").cast("double")
    n = F.sum(F.when(present, c))
    spread = F.sum(F.when(present, c * F.log2(c)))
    entropy = F.when(n > 0, F.greatest(F.log2(n) - F.try_divide(spread, n), F.lit(0.0))).otherwise(0.0)
    found = counts.groupBy("part").agg(
        F.count_if(present).alias("unique_count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0).cast("long")).alias("null_count"),
        round_half(entropy, 4).alias("entropy"),
    )
    return found.select(_named(columns), "unique_count", "null_count", "entropy")


def _nothing(df: DataFrame, schema: str) -> DataFrame:
    return small_table(df.sparkSession, [], schema)


def categorical_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: unique_count, null_count, entropy. A table without rows gives none."""
    columns = categorical_columns(df) if columns is None else columns
    return _summary(key_counts(df, columns), columns) if columns else _nothing(df, PROFILE_SCHEMA)


def unique_count(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column; exact unless ``approximate`` is asked for."""
    columns = df.columns if columns is None else columns
    if approximate:
        texts = df.select(*[value_text(df, c).alias(c) for c in columns])
        long = texts.unpivot([], [column(c) for c in columns], "column", "value")
        return long.groupBy("column").agg(F.approx_count_distinct("value").alias("unique_count"))
    return categorical_profile(df, columns).select("column", "unique_count")


def entropy(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return categorical_profile(df, columns).select("column", "entropy")


def _candidates(counts: DataFrame, k: int) -> DataFrame:
    """The keys that can be among the k most frequent of their part: ties that their first characters do not order stay in.

    Spark keeps only the keys of these ranks of each part and task before the shuffle of the window.
    """
    order = Window.partitionBy("part").orderBy(F.col("n").desc(), F.col("head").asc())
    return counts.where(F.col("head").isNotNull()).withColumn("place", F.rank().over(order)).where(F.col("place") <= k).drop("place")


def _with_values(df: DataFrame, columns: list[str], candidates: DataFrame, start: int) -> DataFrame:
    """(part, value, n) of the candidates: short values are their own keys, longer ones are read from the table."""
    found = candidates.where(F.length("head") < HEAD).select("part", F.col("head").alias("value"), "n")
    long = candidates.where(F.length("head") >= HEAD)
    parts = sorted(r["part"] for r in long.select("part").distinct().collect())
    if not parts:
        return found
    values = _values(df, {part: value_text(df, columns[part - start]) for part in parts}).where(F.length("value") >= HEAD)
    # Only rows of a candidate reach the shuffle, equal ones combined.
    fetched = _with_keys(values).join(long, ["part", "k1", "k2", "head"]).select("part", "value", "n").distinct()
    return found.unionByName(fetched)


def _top(df: DataFrame, columns: list[str], counts: DataFrame, rows: int, k: int, start: int = 0) -> DataFrame:
    """The k most frequent values of each column; equal counts go by value."""
    valued = _with_values(df, columns, _candidates(counts, k), start)
    order = Window.partitionBy("part").orderBy(F.col("n").desc(), F.col("value").asc())
    ranked = valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    share = percent(F.col("n"), F.lit(rows))
    return ranked.select((F.col("part") - start).alias("part"), "rank", "value", "n", share.alias("pct")).select(_named(columns), "rank", "value", F.col("n").alias("count"), "pct")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """Most frequent values per column, with their share of all rows (missing cells included)."""
    columns = categorical_columns(df) if columns is None else columns
    if not columns:
        return _nothing(df, TOP_SCHEMA)
    counts = kept(key_counts(df, columns), "values")
    # Every row has one key in the first column.
    rows = counts.where(F.col("part") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _top(df, columns, counts, rows, k)


def frequencies(df: DataFrame, columns: list[str], rows: int, k: int = TOP_VALUES) -> tuple[DataFrame, DataFrame]:
    """The categorical profile and the top values, computed from one scan of keys; both are small and brought to the driver."""
    if not columns:
        return from_keys(df, df, columns, rows, k)
    return from_keys(df, kept(key_counts(df, columns), "values"), columns, rows, k)


def from_keys(df: DataFrame, keys: DataFrame, columns: list[str], rows: int, k: int = TOP_VALUES, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same from a grouped scan already made, in which the columns are the parts from ``start``."""
    if not columns:
        return _nothing(df, PROFILE_SCHEMA), _nothing(df, TOP_SCHEMA)
    mine = keys.where(F.col("part").between(start, start + len(columns) - 1)).select("part", "k1", "k2", "head", "n")
    profile = pinned(_summary(mine.withColumn("part", F.col("part") - start), columns))
    return profile, pinned(_top(df, columns, mine, rows, k, start))


def sample_values(df: DataFrame, name: str, order_by: list[str], k: int = 10) -> DataFrame:
    """The first k distinct non-missing values of a column, in the stated row order.

    A round takes the earliest rows whose value is not known yet; each task keeps no more than that many, and the value
    of the earliest of them is the next one in order, as are those of the rows after it. A column whose values change within the
    first rows takes one round, one of fewer than k values one more than it takes to find them; a round always finds a
    value, so there are k + 1 at most, and no round moves more than its rows, whatever the table holds.
    """
    value = value_text(df, name)
    keys = [f"key_{i}" for i in range(len(order_by))]
    present = df.select(value.alias("value"), *[column(c).alias(n) for c, n in zip(order_by, keys)]).where(F.col("value").isNotNull())
    found: list[str] = []
    size = _FIRST_ROWS * k
    while len(found) < k:
        unknown = present.where(~F.col("value").isin(found)) if found else present
        rows = [r["value"] for r in unknown.orderBy(*keys, "value").limit(size).select("value").collect()]
        found += dict.fromkeys(rows)
        if len(rows) < size:
            break
    return small_table(df.sparkSession, [(name, v) for v in found[:k]], "column string, value string")
