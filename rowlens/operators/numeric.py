"""Numeric profiles: moments, exact quartiles and histograms of all numeric columns together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions.cells import fixed_text, is_missing, number, number_text, round_half
from rowlens.functions.small import small_table
from rowlens.operators import ranks
from rowlens.operators.passes import Scale, aggregate_each, kept, keyed, one_scan, plain_zero, written
from rowlens.operators.schema import numeric_columns

HISTOGRAM_BINS = 20
# Columns per aggregate, for figures and for histograms.
_BATCH = 4
_HISTOGRAMS = 2

PROFILE_SCHEMA = (
    "column string, mean double, median double, std double, min double, max double, q25 double, "
    "q75 double, skewness double, kurtosis double, null_count long"
)
HISTOGRAM_SCHEMA = (
    "column string, bin int, range_start double, range_end double, count long, label string"
)
QUARTILE_SCHEMA = "column string, q25 double, median double, q75 double"


@dataclass(frozen=True)
class Measure:
    """First-pass figures of one numeric column."""

    column: str
    count: int = 0
    null_count: int = 0
    mean: float | None = None
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class Moments:
    """Second-pass figures: spread and shape around the mean."""

    std: float | None = None
    skewness: float | None = None
    kurtosis: float | None = None


@dataclass(frozen=True)
class Quartiles:
    q25: float | None = None
    median: float | None = None
    q75: float | None = None


def extent(df: DataFrame, name: str, null_policy: str = "skip") -> list[Column]:
    """The state of a column's first figures, for a scan that several operators share."""
    x = number(df, name, null_policy)
    return [
        F.count(x).alias("count"),
        F.count_if(is_missing(df, name)).alias("null_count"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ]


def measure(df: DataFrame, columns: list[str], null_policy: str = "skip") -> list[Measure]:
    """Counts, means and extremes of every column in one scan of all rows."""
    found = one_scan(df, {c: extent(df, c, null_policy) for c in columns})
    return [Measure(c, *found[c]) for c in columns]


def scales(measures: list[Measure], bins: int = HISTOGRAM_BINS) -> list[Scale]:
    """How a grouped scan cuts each column: one of equal values, or without any, has one bin."""
    return [Scale(m.mean, m.min, (m.max - m.min) / bins, bins) if m.count else Scale(0.0, 0.0, 0.0, bins) for m in measures]


def number_keys(df: DataFrame, measures: list[Measure], null_policy: str = "skip") -> list[Column]:
    """Entries of a grouped scan: the numbers, whose logarithmic buckets and histogram bins are the keys.

    Both ascend with the number, so a column has hardly more keys than buckets. Cells without a number have null keys.
    """
    return [keyed(part, x=plain_zero(number(df, m.column, null_policy))) for part, m in enumerate(measures)]


def _bin(x: Column, low: float, high: float, bins: int) -> Column:
    width = (high - low) / bins
    # least() would take a missing cell for the last bin.
    place = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
    return F.when(x.isNotNull(), place.cast("int"))


def _by_bin(keys: DataFrame, measures: list[Measure]) -> list:
    """(part, k2, n, p2, p3, p4) of each bin of a grouped scan."""
    rows = keys.where(F.col("k1").isNotNull() & (F.col("part") < len(measures)))
    return rows.groupBy("part", "k2").agg(*[F.sum(c).alias(c) for c in ("n", "p2", "p3", "p4")]).collect()


def _shapes(bins: list, measures: list[Measure]) -> dict[str, Moments]:
    """Population moments from the sums of powers around the mean.

    The deviation, skewness and excess kurtosis of a constant column are 0.
    """
    out = {}
    for part, m in enumerate(measures):
        second, third, fourth = (sum(r[p] for r in bins if r["part"] == part) / max(m.count, 1) for p in ("p2", "p3", "p4"))
        std = second**0.5
        if not m.count:
            out[m.column] = Moments()
        elif m.min < m.max and std > 0:
            out[m.column] = Moments(std, third / std / std / std, fourth / std / std / std / std - 3)
        else:
            out[m.column] = Moments(0.0, 0.0, 0.0)
    return out


def _wanted(counts: dict[str, int]) -> dict[str, list[int]]:
    """Ranks of the quartiles and of the two middle values; a column without numbers has none."""
    return {c: [n // 4, (n - 1) // 2, n // 2, 3 * n // 4] for c, n in counts.items() if n}


def locate_quartiles(
    df: DataFrame,
    columns: list[str],
    null_policy: str = "skip",
    buckets: DataFrame | None = None,
    totals: dict[str, int] | None = None,
) -> dict[str, Quartiles]:
    """Exact quartiles: the values at 0-based ranks floor(n/4) and floor(3n/4), and the median.

    ``buckets`` takes the (part, k1, n, lo, hi) of a scan already made, part being a column's place in ``columns``, and
    ``totals`` the numbers in each column.
    """
    out = {c: Quartiles() for c in columns}
    numbers = {c: number(df, c, null_policy) for c in columns}
    if not columns:
        return out
    if buckets is None:
        # A few hundred rows a column; kept, as the counts and the ranks are both read from it.
        buckets = kept(ranks.first_buckets(df, numbers), "buckets")
    if totals is None:
        totals = {columns[r["part"]]: r["n"] for r in buckets.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    wanted = _wanted(totals)
    values = ranks.select_ranks(df, numbers, wanted, buckets) if wanted else {}
    for name, (low, left, right, high) in wanted.items():
        median = (values[name, left] + values[name, right]) / 2
        out[name] = Quartiles(values[name, low], median, values[name, high])
    return out


def profile_rows(
    measures: list[Measure], quartiles: dict[str, Quartiles], shapes: dict[str, Moments]
) -> list[tuple]:
    rows = []
    for m in measures:
        q, s = quartiles[m.column], shapes[m.column]
        rows.append(
            (m.column, m.mean, q.median, s.std, m.min, m.max, q.q25, q.q75, s.skewness, s.kurtosis, m.null_count)
        )
    return rows


def numeric_profile(df: DataFrame, columns: list[str] | None = None, null_policy: str = "skip") -> DataFrame:
    """One row per numeric column. A column without valid numbers keeps its row, with nulls."""
    columns = numeric_columns(df) if columns is None else columns
    return numeric_with_histogram(df, columns, null_policy)[0]


def quartiles(df: DataFrame, columns: list[str] | None = None, null_policy: str = "skip") -> DataFrame:
    columns = numeric_columns(df) if columns is None else columns
    found = locate_quartiles(df, columns, null_policy)
    rows = [(c, found[c].q25, found[c].median, found[c].q75) for c in columns]
    return small_table(df.sparkSession, rows, QUARTILE_SCHEMA)


def extremes(df: DataFrame, columns: list[str], null_policy: str = "skip") -> list[tuple]:
    """(column, min, max) of every column that has valid numbers."""
    values = [number(df, c, null_policy) for c in columns]
    rows = aggregate_each(df, [[F.min(x).alias("min"), F.max(x).alias("max")] for x in values], _BATCH)
    return [(c, r["min"], r["max"]) for c, r in zip(columns, rows) if r["min"] is not None]


def histogram(
    df: DataFrame,
    columns: list[str] | None = None,
    bins: int = HISTOGRAM_BINS,
    null_policy: str = "skip",
    limits: list[tuple] | None = None,
) -> DataFrame:
    """Equal-width bins from min to max, empty ones kept; one bin where all values are equal.

    ``limits`` takes the (column, min, max) rows of a profile already at hand, and saves a scan.
    """
    columns = numeric_columns(df) if columns is None else columns
    limits = extremes(df, columns, null_policy) if limits is None else limits
    if not limits:
        return small_table(df.sparkSession, [], HISTOGRAM_SCHEMA)
    bin_columns, figures = [], []
    for entry, (name, low, high) in enumerate(limits):
        bin_columns.append(_bin(number(df, name, null_policy), low, high, bins).alias(f"bin_{entry}"))
        held = [F.count_if(F.col(f"bin_{entry}") == b) for b in range(bins if low < high else 1)]
        figures.append([F.array(*held).alias("held")])
    rows = aggregate_each(df.select(*bin_columns), figures, _HISTOGRAMS)
    counts = [(c, b, n) for (c, _, _), r in zip(limits, rows) for b, n in enumerate(r["held"])]
    table = small_table(df.sparkSession, counts, "column string, bin int, count long")
    return _all_bins(limits, table, bins)


def _edges(spark, limits: list[tuple], bins: int) -> DataFrame:
    rows = [(c, low, high, (high - low) / bins) for c, low, high in limits]
    return small_table(spark, rows, "column string, low double, high double, width double")


def _all_bins(limits: list[tuple], counts: DataFrame, bins: int) -> DataFrame:
    """The bins with their edges and labels."""
    low, width = F.col("low"), F.col("width")
    start = low + F.col("bin") * width
    stop = low + (F.col("bin") + 1) * width
    single = width == 0
    return counts.join(F.broadcast(_edges(counts.sparkSession, limits, bins)), "column").select(
        "column",
        "bin",
        F.when(single, low).otherwise(round_half(start, 4)).alias("range_start"),
        F.when(single, F.col("high")).otherwise(round_half(stop, 4)).alias("range_end"),
        "count",
        F.when(single, number_text(low))
        .otherwise(F.concat(fixed_text(start, 2), F.lit("–"), fixed_text(stop, 2)))
        .alias("label"),
    )


def _histogram(spark, rows: list, measures: list[Measure], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """The histogram of a grouped scan, empty bins too."""
    limits = [(m.column, m.min, m.max) for m in measures if m.count]
    found = {(measures[r["part"]].column, r["k2"]): r["n"] for r in rows}
    counts = [(c, b, found.get((c, b), 0)) for c, low, high in limits for b in range(bins if low < high else 1)]
    return _all_bins(limits, small_table(spark, counts, "column string, bin int, count long"), bins)


def numeric_with_histogram(
    df: DataFrame, columns: list[str], null_policy: str = "skip"
) -> tuple[DataFrame, DataFrame, dict[str, Quartiles]]:
    """The numeric profile, the histogram with the profile's limits, and the quartiles, in five scans at most."""
    measures = measure(df, columns, null_policy)
    if not columns:
        return small_table(df.sparkSession, [], PROFILE_SCHEMA), small_table(df.sparkSession, [], HISTOGRAM_SCHEMA), {}
    keys, _ = written(df, number_keys(df, measures, null_policy), scales(measures))
    return from_keys(df, keys, measures, null_policy)


def from_keys(
    df: DataFrame, keys: DataFrame, measures: list[Measure], null_policy: str = "skip"
) -> tuple[DataFrame, DataFrame, dict[str, Quartiles]]:
    """The same from a grouped scan already made; what is left are the scans that narrow the quartiles."""
    # Bins only cut a bucket in pieces.
    found = keys.where(F.col("k1").isNotNull() & (F.col("part") < len(measures)))
    buckets = found.groupBy("part", "k1").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    located = locate_quartiles(df, [m.column for m in measures], null_policy, buckets, {m.column: m.count for m in measures})
    # A bin is a row of figures: a few for each column.
    bins = _by_bin(keys, measures)
    rows = profile_rows(measures, located, _shapes(bins, measures))
    spark = df.sparkSession
    return small_table(spark, rows, PROFILE_SCHEMA), _histogram(spark, bins, measures), located
