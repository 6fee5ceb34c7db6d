"""Systematic sample: every (rows / size)-th row of the table in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions.cells import column, data_type
from rowlens.functions.small import small_table
from rowlens.sources.scratch import scratch_path

SAMPLE_ROWS = 50_000

# Steps of the first order key for each sampled row: so many times fewer rows are sorted where the key is evenly spread.
_STEPS = 16
# Rows that are sorted by all columns to save the sort of all keys: fewer than one in so many.
_MOST_NEAR = 8

# monotonically_increasing_id holds the partition number above this bit, the row number below.
_ROW_BITS = 33


def systematic_sample(df: DataFrame, order_by: list[str], size: int = SAMPLE_ROWS) -> DataFrame:
    """Rows at positions floor(i * rows / size), i < size; the whole table where it is no larger.

    ``order_by`` states the row order; rows that tie on it are taken in order of the other columns,
    so that the sample does not depend on how the table is laid out.

    The rows are first counted by steps of the first order key, where it has a number, and only those of the steps that
    hold a sampled position are sorted by all columns. Where these are an eighth of the table or more, and for other keys,
    the order keys are sorted, equal keys combined first. Where each sampled key is held by one row, the rows are then picked from
    the table by key, a join that broadcasts them only if they are small; else the rows of the sampled keys, and no others,
    are sorted by all columns. All sorts are made over all executors, identical rows combined: a key that holds a third
    of the table is spread like any other.
    """
    if size < 1:
        raise ValueError("size must be positive")
    place = _number(df, order_by[0]) if order_by else None
    ends = [] if place is None else [f(F.when(F.abs(place) < float("inf"), place)) for f in (F.min, F.max)]
    total, *ends = df.agg(F.count(F.lit(1)), *ends).first()
    if total <= size:
        return df
    step = _step(place, *ends, _STEPS * size) if ends else None
    if step is not None:
        steps = _hits(df.select(step.alias("_step")), ["_step"], total, size)
        if _MOST_NEAR * steps.agg(F.sum("_copies").alias("rows")).first()["rows"] < total:
            return _among(df, steps, step == F.col(_key(0)), order_by, total, size)
    hits = _hits(df, order_by, total, size)
    if hits.agg(F.max("_copies").alias("copies")).first()["copies"] == 1:
        return df.join(hits, _same(order_by), "left_semi")
    return _among(df, hits, _same(order_by), order_by, total, size)


def _number(df: DataFrame, name: str) -> Column | None:
    """A number that never falls along the order of a column, if its type has one."""
    cell, dtype = column(name), data_type(df, name)
    if isinstance(dtype, T.DateType):
        cell = F.unix_date(cell)
    return cell.cast("double") if isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType)) else None


def _step(x: Column, low: float | None, high: float | None, steps: int) -> Column | None:
    """The place of a number among equal steps from low to high, if these differ: nulls before, NaN behind all others."""
    width = 0.0 if low is None else high / steps - low / steps
    if not width:
        return None
    inside = F.least(F.greatest((x - F.lit(low)) / F.lit(width), F.lit(0.0)), F.lit(float(steps - 1)))
    return F.when(x.isNull(), -1).when(F.isnan(x), steps).otherwise(F.floor(inside)).cast("long")


def _key(position: int) -> str:
    return f"_key_{position}"


def _hits(df: DataFrame, keys: list[str], total: int, size: int) -> DataFrame:
    """The keys that hold a sampled position: how many rows hold them, and the place of the first of these rows.

    They are written, as later steps use them more than once; there are no more of them than sampled rows.
    """
    placed = _placed(df, keys)
    holds = F.size(_positions(F.col("_first"), F.col("_copies"), total, size)) > 0
    return _written(placed.where(_may_hold(F.col("_first"), F.col("_copies"), total, size)).where(holds), "hits")


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys in order, with the number of their rows and ``_first``, the number of rows before them.

    The sorted keys are written with their numbers, since positions rest on the rows before each
    partition and a sort computed again could split them elsewhere. Only the row count of each partition reaches the
    driver.
    """
    names = [_key(i) for i in range(len(keys))]
    grouped = df.groupBy(*[column(c).alias(n) for c, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_copies"))
    ordered = _written(grouped.orderBy(*names).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    numbered = ordered.select(
        *names,
        "_copies",
        F.shiftright("_id", _ROW_BITS).cast("int").alias("_part"),
        F.col("_id").bitwiseAND(F.lit(2**_ROW_BITS - 1)).alias("_row"),
    )
    held = numbered.groupBy("_part").agg(F.sum("_copies").alias("rows"), F.max("_copies").alias("most")).collect()
    starts, passed = [], 0
    for part in sorted(held, key=lambda r: r["_part"]):
        starts.append((part["_part"], passed))
        passed += part["rows"]
    if max(part["most"] for part in held) == 1:
        before = F.col("_row")
    else:
        upward = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_copies").over(upward), F.lit(0))
    offsets = small_table(df.sparkSession, starts, "_part int, _before long")
    # One row per partition is broadcast.
    return (
        numbered.withColumn("_inside", before)
        .join(F.broadcast(offsets), "_part")
        .select(*names, "_copies", (F.col("_before") + F.col("_inside")).alias("_first"))
    )


def _written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: nothing before them is computed again, and their size is known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _may_hold(first: Column, copies: Column, total: int, size: int) -> Column:
    """Cheap test that no run of rows with a sampled position fails."""
    step = F.lit(total / size)
    return F.ceil((first - 1) / step) <= F.floor((first + copies + 1) / step)


def _positions(first: Column, copies: Column, total: int, size: int) -> Column:
    """Sampled positions in [first, first + copies)."""
    step = F.lit(total / size)
    nearby = F.sequence(F.floor(first / step) - 1, F.floor((first + copies) / step) + 1)
    asked = F.filter(nearby, lambda i: (i >= 0) & (i < size))
    places = F.transform(asked, lambda i: F.floor(i * step))
    return F.filter(places, lambda p: (p >= first) & (p < first + copies))


def _same(keys: list[str]) -> Column:
    """A table row beside the hit that has its keys; nulls are equal to each other."""
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & column(key).eqNullSafe(F.col(_key(i)))
    return same


def _among(df: DataFrame, hits: DataFrame, same: Column, keys: list[str], total: int, size: int) -> DataFrame:
    """The sampled rows among the rows of the hits, to which ``same`` leads.

    The place of a hit's first row stands for the hit: it sorts like it, and with the row's place among the rows
    of its hit it gives the position in the table.
    """
    held = df.join(hits.drop("_copies").withColumnRenamed("_first", "_group"), same, "inner").select("_group", *[column(c) for c in df.columns])
    fields = ["_group", *keys, *[c for c in df.columns if c not in keys]]
    rows = _placed(held, fields).withColumnRenamed(_key(0), "_group")
    # One row a hit; written, as Spark then knows whether they are few enough to be broadcast.
    starts = _written(rows.groupBy("_group").agg(F.min("_first").alias("_start")), "starts")
    found = rows.join(starts, "_group").withColumn("_place", F.col("_group") + F.col("_first") - F.col("_start"))
    taken = F.explode(_positions(F.col("_place"), F.col("_copies"), total, size)).alias("_position")
    near = found.where(_may_hold(F.col("_place"), F.col("_copies"), total, size))
    return near.select(*[F.col(_key(fields.index(c))).alias(c) for c in df.columns], taken).drop("_position")
