"""Exact order statistics of many columns at once by radix selection, in four scans at most.

The first scan counts the rows of each logarithmic bucket: some 16 to a power of two, so tasks add them up to a few
hundred rows a column before the shuffle. The cumulated counts tell in which bucket a wanted rank lies, and the bucket's
least and largest value bound it. Each further scan looks only at the values within such bounds and cuts them into 65,536
equal steps. A first bucket holds less than 2 ** 48 doubles, so the third such scan gives every double a step of its
own; a rank is found earlier where its bounds meet. All ranks of all columns go through the same scans.

Every step is a non-decreasing function of the value, which is all that counting needs: rounding shifts borders, not ranks.
No value is listed: what is shuffled are counts, at most 65,536 per interval and task, however hot or many the values are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.functions.small import small_table
from rowlens.operators.passes import bucket, plain_zero

STEPS = 1 << 16


@dataclass(frozen=True)
class Interval:
    """Bounds of the value of one rank (0-based among the rows within the bounds) of one column."""

    column: str
    rank: int
    inner_rank: int
    low: float
    high: float


def select_ranks(df: DataFrame, values: dict[str, Column], wanted: dict[str, list[int]], first: DataFrame | None = None) -> dict[tuple[str, int], float]:
    """The value at every wanted rank (0-based, below the column's count) of ``values``, each column's numbers or null.

    ``first`` takes the (part, k1, n, lo, hi) of the first scan where it is already at hand, part being a column's place
    in ``values``.
    """
    names = list(values)
    if first is None:
        first = first_buckets(df, values)
    asked = [(names.index(c), rank, rank) for c, ranks in wanted.items() for rank in dict.fromkeys(ranks)]
    found: dict[tuple[str, int], float] = {}
    open_ = _settled(found, [Interval(names[r["part"]], r["rank"], r["inner_rank"], r["lo"], r["hi"]) for r in _reached(first, asked)])
    while open_:
        bounds = list(dict.fromkeys((i.column, i.low, i.high) for i in open_))
        asked = [(bounds.index((i.column, i.low, i.high)), i.rank, i.inner_rank) for i in open_]
        reached = _reached(_steps(df, values, bounds), asked)
        open_ = _settled(found, [Interval(bounds[r["part"]][0], r["rank"], r["inner_rank"], r["lo"], r["hi"]) for r in reached])
    return found


def _settled(found: dict[tuple[str, int], float], intervals: list[Interval]) -> list[Interval]:
    """Notes the ranks whose bounds meet, and returns the others."""
    found.update({(i.column, i.rank): i.low for i in intervals if i.low == i.high})
    return [i for i in intervals if i.low < i.high]


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "k1").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def _cells(df: DataFrame, values: list[Column]) -> DataFrame:
    """(part, x): the numbers of all columns below each other, part being the place in `values`."""
    cells = [F.struct(F.lit(i).alias("part"), plain_zero(x).alias("x")) for i, x in enumerate(values)]
    return df.select(F.inline(F.array(*cells)))


def first_buckets(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(part, k1, n, lo, hi): the logarithmic buckets of every column, and the values that bound them."""
    x = F.col("x")
    return _counted(_cells(df, list(values.values())).where(x.isNotNull()).select("part", bucket(x).alias("k1"), "x"))


def _steps(df: DataFrame, values: dict[str, Column], bounds: list[tuple[str, float, float]]) -> DataFrame:
    """(part, k1, n, lo, hi): equal steps of each interval, part being its place in `bounds`; only values within one are grouped."""
    names = list(dict.fromkeys(c for c, _, _ in bounds))
    held = {c: [(part, low, high) for part, (column, low, high) in enumerate(bounds) if column == c] for c in names}
    x, inside, found = F.col("x"), None, {"interval": None, "low": None, "high": None}
    # A column has four intervals at most, which do not overlap.
    for n in range(max(len(h) for h in held.values())):
        nth = [held[c][n] if n < len(held[c]) else (None, None, None) for c in names]
        part, low, high = (F.get(F.array(*[F.lit(v[i]).cast(t) for v in nth]), F.col("part")) for i, t in enumerate(("int", "double", "double")))
        within = (x >= low) & (x <= high)
        inside = within if inside is None else inside | within
        for name, cell in (("interval", part), ("low", low), ("high", high)):
            found[name] = F.when(within, cell) if found[name] is None else found[name].when(within, cell)
    hits = _cells(df, [values[c] for c in names]).where(inside).select("x", *[cell.alias(name) for name, cell in found.items()])
    step = F.least(F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * STEPS), F.lit(STEPS - 1)).cast("int")
    return _counted(hits.select(F.col("interval").alias("part"), step.alias("k1"), "x"))


def _reached(counts: DataFrame, asked: list[tuple[int, int, int]]) -> list:
    """For each (part, rank, inner_rank) the key at which the part's cumulated counts pass it: its bounds, and the rank within."""
    upward = Window.partitionBy("part").orderBy("k1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A few short rows per column.
    ranks = F.broadcast(small_table(counts.sparkSession, asked, "part int, rank long, inner_rank long"))
    cumulated = counts.select("part", "k1", "n", "lo", "hi", (F.sum("n").over(upward) - F.col("n")).alias("before"))
    at = F.col("inner_rank") - F.col("before")
    return cumulated.join(ranks, "part").where((at >= 0) & (at < F.col("n"))).select("part", "rank", at.alias("inner_rank"), "lo", "hi").collect()
