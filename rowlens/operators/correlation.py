"""Pearson correlation of all numeric column pairs, over the rows where both cells are valid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rowlens.functions.cells import number, round_half
from rowlens.functions.labels import direction, report_strength, strength
from rowlens.functions.small import small_table
from rowlens.operators.numeric import Measure, extent
from rowlens.operators.passes import one_scan
from rowlens.operators.schema import numeric_columns

# Columns per block. The pairs of two blocks are figures of one aggregate that reads these columns alone.
BLOCK = 8

PAIRS_SCHEMA = "i int, j int, col1 string, col2 string, r double"


def correlations(df: DataFrame, columns: list[str], null_policy: str = "skip") -> list[tuple]:
    """(i, j, column i, column j, r) for i < j; r is 0 without two rows or without variance."""
    if len(columns) < 2:
        return []
    return _co_moments(df, columns, *_measured(df, columns, null_policy), null_policy)


def _measured(df: DataFrame, columns: list[str], null_policy: str) -> tuple[int, list[Measure]]:
    """The number of rows and the first figures of every column, from one scan."""
    found = one_scan(df, {("rows",): [F.count(F.lit(1)).alias("rows")], **{c: extent(df, c, null_policy) for c in columns}})
    return found[("rows",)]["rows"], [Measure(c, *found[c]) for c in columns]


def _co_moments(df: DataFrame, columns: list[str], rows: int, measures: list[Measure], null_policy: str) -> list[tuple]:
    """The pairs from sums of products of deviations: mergeable, as all tasks measure from the same means.

    Blocks of columns are taken two by two; rows are neither copied nor shuffled. A pair of columns without gaps costs one
    sum, beside one a column; where cells are missing the sums run over the rows in which both are valid.
    """
    whole = [m.count == rows for m in measures]
    varied = [m.count > 0 and m.min < m.max for m in measures]
    d = [number(df, c, null_policy) - F.lit(m.mean if m.count else 0.0) for c, m in zip(columns, measures)]
    states = {}
    blocks = [range(b, min(b + BLOCK, len(columns))) for b in range(0, len(columns), BLOCK)]
    for p, block in enumerate(blocks):
        for other in blocks[p:]:
            for i in block:
                for j in other:
                    if i <= j and varied[i] and varied[j]:
                        states[i, j] = _products(d[i], d[j], whole[i] and whole[j])
    found = one_scan(df, states)
    pairs = []
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            r = 0.0
            if (i, j) in found:
                r = _full(found[i, j], found[i, i], found[j, j]) if whole[i] and whole[j] else _gapped(found[i, j])
            pairs.append((i, j, columns[i], columns[j], r))
    return pairs


def _products(x: Column, y: Column, whole: bool) -> list[Column]:
    """The state of a pair; x and y are deviations from their means, null where there is no number."""
    if whole:
        return [F.sum(x * y).alias("xy")]
    own, other = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    sums = {"n": F.count(x * y), "x": F.sum(own), "y": F.sum(other), "xx": F.sum(own * own), "yy": F.sum(other * other), "xy": F.sum(x * y)}
    ends = {"x0": F.min(own), "x1": F.max(own), "y0": F.min(other), "y1": F.max(other)}
    return [figure.alias(name) for name, figure in {**sums, **ends}.items()]


def _full(pair: Row, first: Row, second: Row) -> float:
    spread = math.sqrt(first["xy"]) * math.sqrt(second["xy"])
    return pair["xy"] / spread if spread > 0 else 0.0


def _gapped(pair: Row) -> float:
    """Covariance over both deviations, taken over the rows where x and y are both valid."""
    if not pair["n"] or pair["x0"] == pair["x1"] or pair["y0"] == pair["y1"]:
        return 0.0
    xx = pair["xx"] - pair["x"] * pair["x"] / pair["n"]
    yy = pair["yy"] - pair["y"] * pair["y"] / pair["n"]
    spread = math.sqrt(max(xx, 0.0)) * math.sqrt(max(yy, 0.0))
    return (pair["xy"] - pair["x"] * pair["y"] / pair["n"]) / spread if spread > 0 else 0.0


def pairs_table(spark, pairs: list[tuple]) -> DataFrame:
    return (
        small_table(spark, pairs, PAIRS_SCHEMA)
        .select("i", "j", "col1", "col2", round_half(F.col("r"), 4).alias("value"), strength(F.col("r")).alias("strength"))
        .orderBy(F.abs("value").desc(), "i", "j")
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, null_policy: str = "skip") -> DataFrame:
    """Pairs in table order i < j, strongest first: col1, col2, value (4 decimals), strength."""
    columns = numeric_columns(df) if columns is None else columns
    table = pairs_table(df.sparkSession, correlations(df, columns, null_policy))
    return table.select("col1", "col2", "value", "strength")


def matrix_table(spark, columns: list[str], pairs: list[tuple], varied: dict[str, bool]) -> DataFrame:
    cells = [(c, c, 1.0 if varied[c] else 0.0) for c in columns] if pairs else []
    cells += [(a, b, r) for _, _, a, b, r in pairs] + [(b, a, r) for _, _, a, b, r in pairs]
    table = small_table(spark, cells, "row_col string, col_col string, r double")
    return table.select("row_col", "col_col", round_half(F.col("r"), 4).alias("value"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, null_policy: str = "skip") -> DataFrame:
    """Long form of the full matrix; a constant column has 0 on the diagonal. Empty below 2 columns."""
    columns = numeric_columns(df) if columns is None else columns
    rows, measures = _measured(df, columns, null_policy)
    varied = {m.column: m.count > 0 and m.min < m.max for m in measures}
    pairs = _co_moments(df, columns, rows, measures, null_policy) if len(columns) > 1 else []
    return matrix_table(df.sparkSession, columns, pairs, varied)


def report_table(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Pairs with the report's labels; ``k`` keeps the strongest k."""
    table = pairs.select(
        "col1",
        "col2",
        "value",
        report_strength(F.col("value")).alias("strength"),
        direction(F.col("value")).alias("direction"),
    ).orderBy(F.abs("value").desc(), "col1", "col2")
    return table if k is None else table.limit(k)


def strong_count(pairs: DataFrame) -> DataFrame:
    strong = F.count_if(report_strength(F.col("value")) == "Strong")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), strong.alias("strong_pairs"))
