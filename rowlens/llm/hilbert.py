"""Sharding along a Hilbert curve over quantised metadata, so that every file covers a small box of all dimensions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.llm.common import save

SHARDS = 40
DIMENSIONS = ("source", "lang", "n_chars")
# Each dimension is cut into 2 ** BITS bins of about equal row counts.
BITS = 6


def turns(dims: int) -> tuple[list[int], list[int]]:
    """The curve as a machine: for state * 2**dims + corner, the corner's rank on the curve and the next state.

    A state is the corner where the curve enters a cube and the axis along which it leaves; corners are visited in
    Gray-code order, turned to that axis, and each sub-cube is entered where the one before it was left.
    """
    size = 1 << dims
    gray = [i ^ (i >> 1) for i in range(size)]
    rank_of = {g: i for i, g in enumerate(gray)}

    def rotate(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (size - 1)

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(size)]
    axis = [0 if i == 0 else trailing_ones(i if i % 2 else i - 1) % dims for i in range(size)]
    ranks, states = [], []
    for state in range(dims * size):
        start, along = state % size, state // size
        for corner in range(size):
            rank = rank_of[rotate(corner ^ start, -(along + 1))]
            begin = start ^ rotate(entry[rank], along + 1)
            ranks.append(rank)
            states.append(begin + size * ((along + axis[rank] + 1) % dims))
    return ranks, states


def curve_index(bins: Sequence[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a cell given by one bin of 0 to 2**bits - 1 for each dimension."""
    dims = len(bins)
    ranks, states = ([F.lit(x) for x in xs] for xs in turns(dims))
    ranks, states = F.array(*ranks), F.array(*states)

    def step(acc: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for d in range(dims):
            corner = corner + F.floor(acc["bins"][d] / F.pow(F.lit(2), bit)).cast("int") % 2 * (1 << d)
        at = acc["state"] * (1 << dims) + corner
        return F.struct((acc["index"] * (1 << dims) + ranks[at]).cast("long").alias("index"), states[at].alias("state"), acc["bins"].alias("bins"))

    # The bins travel along, so that they are computed once a row and not once a step.
    begin = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"), F.array(*bins).alias("bins"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), begin, step, lambda acc: acc["index"])


def _value(df: DataFrame, name: str) -> tuple[Column, str]:
    """A dimension's value with its type, in the dimension's own order: NaN is null, times are microseconds, text goes by code point."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.IntegralType):
        return column.cast("long"), "long"
    if isinstance(kind, T.DecimalType):
        return column, kind.simpleString()
    if isinstance(kind, T.FractionalType):
        return F.nullif(column.cast("double"), F.lit(float("nan"))), "double"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")), "long"
    return column.cast("string"), "string"


def _limits(value: Column, df: DataFrame, bits: int) -> dict[int, object]:
    """The least value of each bin, by whole values, null first.

    Distinct values with their counts are range-sorted and written, and numbered from the sums of the written
    partitions, so no task holds all of them; what reaches the driver is one value for each bin. Values far from the
    others take no more than their own rows, as counts decide and not distances.
    """
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    ordered = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    ordered = save(ordered, "values")
    sums = ordered.groupBy("part").agg(F.sum("n").alias("sum"))
    # One row for each written partition.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = save(sums.select("part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"), F.sum("sum").over(whole).alias("all")), "starts")
    before = F.sum("n").over(Window.partitionBy("part").orderBy("value")) - F.col("n") + F.col("start")
    binned = ordered.join(starts, "part").withColumn("bin", F.floor(before * (1 << bits) / F.col("all")).cast("int"))
    return {r["bin"]: r["value"] for r in binned.groupBy("bin").agg(F.min("value").alias("value")).collect()}


def bins(df: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> list[Column]:
    """A bin of 0 to 2**bits - 1 for each dimension, in its order, with about as many rows as the others; null is 0.

    A scan of each dimension alone counts its whole values, so that values which differ anywhere are told apart.
    What reaches the driver is 2**bits limits a dimension.
    """
    out = []
    for name in dimensions:
        value, kind = _value(df, name)
        own = _limits(value, df, bits)
        # The first value of each bin; an empty bin begins where the next one does, and none after the last.
        firsts, following = [], None
        for b in range((1 << bits) - 1, 0, -1):
            following = own.get(b, following)
            firsts.append(following)
        firsts = F.array(*(F.lit(x).cast(kind) for x in reversed(firsts)))
        # Binary search for the number of limits that are no larger than the value, which travels along.
        steps = F.array(*(F.lit(1 << b) for b in range(bits - 1, -1, -1)))
        begin = F.struct(F.lit(0).alias("bin"), value.alias("value"))
        out.append(F.aggregate(steps, begin, _search(firsts), lambda acc: acc["bin"]))
    return out


def _search(firsts: Column) -> Callable[[Column, Column], Column]:
    def step(acc: Column, by: Column) -> Column:
        higher = firsts[acc["bin"] + by - 1] <= acc["value"]
        return F.struct(F.when(higher, acc["bin"] + by).otherwise(acc["bin"]).alias("bin"), acc["value"].alias("value"))

    return step


def shard(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS, key: str = "doc_id", shards: int = SHARDS, bits: int = BITS, columns: Sequence[Column | str] = ("*",)) -> DataFrame:
    """`columns` of `docs` with curve, shard and slot: rows along the Hilbert curve, cut into runs of equal row counts.

    Shard sizes differ by one row at most; slots count from 0 inside a shard. Rows in one cell go by key, null
    first, then as read, so repeated rows have slots of their own. A null dimension counts as the least value.
    The range sort splits a cell of any size over many tasks; row numbers come from the counts of the sorted,
    written partitions, not from one task. An empty table gives an empty result; columns of `docs` with the names
    of the added ones are replaced.
    """
    own = ("__curve", "__key", "__read", "__at")
    cells = docs.select(*(F.lit(0) if d is None else F.col(d) for d in dimensions))
    index = curve_index(bins(cells, dimensions, bits), bits)
    placed = docs.select(*columns, index.alias(own[0]), F.col(key).alias(own[1]), F.monotonically_increasing_id().alias(own[2]))
    ordered = placed.repartitionByRange(F.col(own[0]), F.col(own[1]), F.col(own[2])).sortWithinPartitions(*own[:3])
    ordered = save(ordered.drop(own[1], own[2]).withColumn(own[3], F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(own[3], 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row for each written partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias("__all"))
    starts = save(starts, "starts")
    ranked = ordered.withColumn("__part", part).join(starts, "__part")
    rank = F.col("__start") + F.col(own[3]).bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ranked.withColumn("__rank", rank).withColumn("__shard", F.expr(f"__rank * {shards} div __all").cast("int"))
    slot = F.col("__rank") - F.expr(f"(__shard * __all + {shards - 1}) div {shards}")
    kept = [c for c in ordered.columns if c not in (*own, "curve", "shard", "slot")]
    return ranked.select(*kept, F.col(own[0]).alias("curve"), F.col("__shard").alias("shard"), slot.cast("long").alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order: the statistics of a file bound all dimensions."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
