"""Scans shared by many figures: global aggregates of many columns, and one grouped scan for all that needs a key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rowlens.sources.scratch import scratch_path

# Figures of one global aggregate; beyond, its generated code is no longer compiled well and a further scan is cheaper.
WIDEST = 256

# The part of a grouped scan that holds whole rows; other parts are columns by their position.
ROWS = -1


def aggregate_each(df: DataFrame, figures: list[list[Column]], batch: int) -> list:
    """One row of aggregates per entry of ``figures``; all entries name the same aliases.

    ``batch`` entries share one global aggregate, each of which reads only its own columns; all of
    them run in one job. Generated code grows with the entries of an aggregate, and beyond the size
    that the JVM compiles it runs tens of times slower, so a wide table takes several.
    """
    branches = []
    for start in range(0, len(figures), batch):
        rows = [
            F.struct(F.lit(start + i).alias("entry"), *columns)
            for i, columns in enumerate(figures[start : start + batch])
        ]
        branches.append(df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    if not branches:
        return []
    return sorted(reduce(DataFrame.unionAll, branches).collect(), key=lambda r: r["entry"])


def one_scan(df: DataFrame, states: dict[str, list[Column]]) -> dict:
    """The figures of many operators from one scan: a row of results under each state's name.

    A state is what an operator wants to know of all rows, as mergeable aggregates. States of more than WIDEST figures in
    total take further scans.
    """
    found, part, held = {}, {}, 0
    for name, figures in states.items():
        if part and held + len(figures) > WIDEST:
            found.update(_scanned(df, part))
            part, held = {}, 0
        part[name], held = figures, held + len(figures)
    if part:
        found.update(_scanned(df, part))
    return found


def _scanned(df: DataFrame, states: dict[str, list[Column]]) -> dict:
    row = df.agg(*[F.struct(*figures).alias(f"s{i}") for i, figures in enumerate(states.values())]).first()
    return {name: row[f"s{i}"] for i, name in enumerate(states)}


# Characters of a value that are grouped as they are.
HEAD = 32
# Buckets to a power of two, and one more than the largest place of a double's logarithm at that rate.
_PER_OCTAVE = 16
_ABOVE_ZERO = 17_200


@dataclass(frozen=True)
class Scale:
    """How the numbers of one part are cut: their mean, least value, and the width and number of their bins."""

    mean: float
    low: float
    width: float
    bins: int


def keyed(part: int, x: Column | None = None, value: Column | None = None, k1: Column | None = None, k2: Column | None = None) -> Column:
    """What one row adds to a grouped scan: a number, a text, or a key of its own."""
    kinds = {"x": (x, "double"), "value": (value, "string"), "k1": (k1, "long"), "k2": (k2, "long")}
    cells = [(F.lit(None) if cell is None else cell).cast(kind).alias(name) for name, (cell, kind) in kinds.items()]
    return F.struct(F.lit(part).alias("part"), *cells)


def bucket(x: Column) -> Column:
    """The logarithmic bucket of a number, ascending with it; 0 holds zero alone."""
    place = F.floor(F.log2(F.abs(x)) * _PER_OCTAVE) + _ABOVE_ZERO
    return F.when(x > 0, place).when(x < 0, -place).when(x == 0, F.lit(0)).cast("long")


def plain_zero(x: Column) -> Column:
    """The number with -0.0 as 0.0."""
    return x + F.lit(0.0)


def value_key(value: Column) -> tuple[Column, Column, Column]:
    """(k1, k2, head) of a text: all of a short one, or the first HEAD characters and a 128-bit digest; null where it is null.

    A short text is its own key; two longer ones that differ share a key with a chance of 2 ** -128, if they begin alike.
    """
    long = F.length(value) >= HEAD
    first, second = (F.when(long, F.xxhash64(F.lit(seed), value)).when(value.isNotNull(), F.lit(0)) for seed in (1, 2))
    return first.cast("long"), second.cast("long"), F.substring(value, 1, HEAD)


def grouped(df: DataFrame, entries: list[Column], scales: list[Scale]) -> DataFrame:
    """(part, k1, k2, head, n, lo, hi, p2, p3, p4) of every key that `entries`, made by `keyed`, give: one scan, one exchange.

    The first parts are numbers, cut by `scales`: k1 is the bucket, k2 the bin, p2 to p4 sums of powers of the deviation from
    the mean. Texts go by `value_key`. n counts the rows of a key, lo and hi are its least and largest number. All are
    added up before the shuffle. Keys are computed on the rows of single cells, so the code stays as small as for one column.
    """
    x, value, part = F.col("x"), F.col("value"), F.col("part")

    def of_part(figure: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(s, figure)) for s in scales]), part) if scales else F.lit(None).cast("double")

    k1, k2, head = value_key(value)
    width = of_part("width")
    # least() would take a missing cell for the last bin.
    place = F.when(width > 0, F.least(F.floor((x - of_part("low")) / width), of_part("bins") - 1)).otherwise(0)
    number = x.isNotNull()
    cells = df.select(F.inline(F.array(*entries)))
    keys = cells.select(
        "part",
        F.when(number, bucket(x)).otherwise(F.coalesce("k1", k1)).alias("k1"),
        F.when(number, place.cast("long")).otherwise(F.coalesce("k2", k2)).alias("k2"),
        head.alias("head"),
        "x",
        (x - of_part("mean")).alias("d"),
    )
    d = F.col("d")
    return keys.groupBy("part", "k1", "k2", "head").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.sum(d * d).alias("p2"),
        F.sum(d * d * d).alias("p3"),
        F.sum(d * d * d * d).alias("p4"),
    )


def written(df: DataFrame, entries: list[Column], scales: list[Scale]) -> tuple[DataFrame, int]:
    """The keys of `grouped` as a written table, and the rows that repeat another one.

    Keys of whole rows, as many as there are distinct rows, are only counted while the others are written.
    """
    copies = Observation()
    repeats = F.sum(F.when(F.col("part") == ROWS, F.col("n") - 1)).alias("repeats")
    counts = grouped(df, entries, scales).observe(copies, repeats).where(F.col("part") != ROWS)
    return kept(counts, "keys"), copies.get["repeats"] or 0


def kept(counts: DataFrame, name: str) -> DataFrame:
    """Counts as a written table, so that the scan behind them runs once."""
    path = scratch_path(counts.sparkSession, name)
    counts.write.parquet(path)
    return counts.sparkSession.read.schema(counts.schema).parquet(path)
