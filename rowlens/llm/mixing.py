"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree deals permuted blocks to shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import WORD, save

# Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
# No source gives more than this many times its size.
REPEATS = 3
# About so many blocks in all; each source has a share by its size, and one at least. A bound that does not grow.
BLOCKS = 4096
# Output shards: a power of two, the leaves of the tree.
SHARDS = 16
SEED = "mix"


def size_in_words(text: str = "text") -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def place(key: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """A row's place in the permutation of its source: 60 bits of a keyed digest of its key and text.

    Equal rows share a place; a null key counts as the empty text.
    """
    parts = [F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) for `sizes(source, source_size)`, one row a source.

    Sources by code point, null last, weigh as `weights` repeat and share the sum of all sizes. A target
    stops at `repeats` times its size and the excess goes to the others by weight: with the sources in order of
    size over weight, those before the first that fits into its share of the rest are full.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    order = Window.orderBy("__fill", F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    filled = weighed.withColumn("__full", F.col("source_size") * repeats).withColumn("__fill", F.col("source_size") / F.col("__weight"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__full").over(before), F.lit(0))
    weight = F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0))
    rated = filled.withColumns({"__rate": left / weight, "__turn": F.row_number().over(order)})
    # The first by turn: of sources that fill up alike, the later ones' rates take the earlier for full.
    first = F.when(F.col("__full") >= F.col("__rate") * F.col("__weight"), F.col("__turn"))
    rate = F.min_by(F.col("__rate"), first).over(everything)
    target = F.least(F.col("__full").cast("double"), F.coalesce(rate, F.lit(0.0)) * F.col("__weight"))
    return rated.select("source", "source_size", target.alias("target"))


def _same(source: str = "__source") -> Column:
    return F.col("source").eqNullSafe(F.col(source))


def _cut(sums: DataFrame, by: str) -> DataFrame:
    """`sums(source, rest, base, <by>, words)` with the words of the source before and after each group."""
    so_far = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    ended = sums.withColumn("after", F.col("base") + F.sum("words").over(so_far))
    return ended.withColumn("before", F.col("after") - F.col("words"))


def _limits(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, last): the last place of each source that its final, partial round takes.

    Words are summed by block, then inside the block where the round ends by a prefix of the place, then there by place:
    three grouped sums, each over a few thousand groups. A place is taken if half its words fit.
    """
    ends = blocks.where("before <= rest and rest < after").select(F.col("source").alias("__source"), F.col("block").alias("__block"), "rest", F.col("before").alias("base"))
    inside = rows.where("size > 0").join(ends, _same() & (F.col("block") == F.col("__block"))).withColumn("prefix", F.shiftright("place", 36))
    prefixes = _cut(inside.groupBy("source", "rest", "base", "prefix").agg(F.sum("size").alias("words")), "prefix")
    ends = prefixes.where("before <= rest and rest < after").select(F.col("source").alias("__s"), F.col("prefix").alias("__prefix"), F.col("before").alias("__base"))
    inside = inside.join(ends, F.col("source").eqNullSafe(F.col("__s")) & (F.col("prefix") == F.col("__prefix"))).withColumn("base", F.col("__base"))
    places = _cut(inside.groupBy("source", "rest", "base", "block", "prefix", "place").agg(F.sum("size").alias("words")), "place")
    # Where not even the first place under the prefix is taken, the round ends with the place before that prefix.
    last = F.max(F.when(F.expr("before + words / 2 <= rest"), F.col("place")).otherwise(F.shiftleft("prefix", 36) - 1))
    return places.groupBy("source", F.col("block").alias("end_block")).agg(last.alias("last")).withColumnRenamed("source", "__source")


def split(quotas: DataFrame, shards: int, seed: str = SEED, groups: int = 1) -> DataFrame:
    """(source, unit, shard) for `quotas(source, unit)`, the units 1 to n of every source.

    Every node of a binary tree gets exact quotas of all sources and hands half its units to the left: it
    draws without replacement, ranking its units by a keyed digest, so the counts by source are multivariate
    hypergeometric. Only the counts pass on: the left child has the first units of each source, in permuted order.
    Units are blocks, and sources are dealt to `groups` by a digest, each with a tree of its own, so that no node
    holds more than its group's blocks and repeats; a source is never cut.
    """
    group = F.pmod(F.conv(F.substring(F.md5(F.coalesce("source", F.lit("\0"))), 1, 8), 16, 10).cast("long"), F.lit(groups))
    nodes = quotas.select("source", "unit", group.alias("group"), F.lit(0).alias("node"))
    for level in range(shards.bit_length() - 1):
        ticket = F.md5(F.concat_ws("|", F.lit(seed), F.lit(level), "node", F.coalesce("source", F.lit("\0")), "unit"))
        of_node = Window.partitionBy("group", "node")
        drawn = F.row_number().over(of_node.orderBy(ticket, "source", "unit")) * 2
        nodes = nodes.withColumn("__left", (drawn <= F.count("*").over(of_node)).cast("int"))
        of_source = Window.partitionBy("group", "node", "source")
        quota = F.sum("__left").over(of_source)
        turn = F.row_number().over(of_source.orderBy("unit"))
        nodes = nodes.select("source", "unit", "group", (F.col("node") * 2 + (turn > quota).cast("int")).alias("node"))
    return nodes.select("source", "unit", F.col("node").alias("shard"))


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, shards: int = SHARDS, blocks: int = BLOCKS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """What to take of every block, for `rows(source, size, place)`.

    First (source, source_size, target, blocks), then (source, block, takes): the draws of a block as
    (round, shard, last), where only places up to `last` belong to the draw (null: all of them).
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, repeats)
    total = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.ceil(F.col("source_size") * blocks / F.greatest(total, F.lit(1))).cast("long")
    aims = save(aims.withColumn("blocks", F.greatest(share, F.lit(1))), "targets")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    aimed = aims.select(F.col("source").alias("__source"), "blocks", rounds.alias("rounds"), (F.col("target") - rounds * F.col("source_size")).alias("rest"))
    blocked = rows.join(aimed, _same()).withColumn("block", block())
    sums = blocked.groupBy("source", "rounds", "rest", "block").agg(F.sum("size").alias("words")).withColumn("base", F.lit(0))
    summed = save(_cut(sums, "block"), "blocks")
    limits = save(_limits(blocked.select("source", "size", "place", "block"), summed), "limits")
    ended = summed.join(limits, _same(), "left").drop("__source")
    partial = F.when(F.col("after") <= F.col("rest"), F.lit((1 << 60) - 1)).when(F.col("block") == F.col("end_block"), F.col("last"))
    partial = F.when(F.col("rounds") < repeats, partial)
    draws = F.filter(
        F.transform(F.sequence(F.lit(1), F.col("rounds") + 1), lambda r: F.struct(r.alias("round"), F.when(r <= F.col("rounds"), F.lit((1 << 60) - 1)).otherwise(partial).alias("last"))),
        lambda x: x["last"].isNotNull(),
    )
    units = ended.select("source", "block", F.explode(draws).alias("draw")).select("source", "block", "draw.*")
    units = save(units.withColumn("unit", F.row_number().over(Window.partitionBy("source").orderBy("round", "block"))), "units")
    # As many sources as blocks to a tree: each source has a block at least, whatever its share.
    groups = max(1, -(-aims.count() // blocks))
    dealt = split(units.select("source", "unit"), shards, seed, groups).select(F.col("source").alias("__source"), F.col("unit").alias("__unit"), "shard")
    takes = units.join(dealt, _same() & (F.col("unit") == F.col("__unit"))).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("round", "shard", "last"))).alias("takes"))
    return aims, save(takes, "takes")


def block(place_column: str = "place", blocks: str = "blocks") -> Column:
    """Blocks are equal runs of places."""
    return F.shiftright(F.shiftright(place_column, 28) * F.col(blocks), 32)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, shards: int = SHARDS, blocks: int = BLOCKS, seed: str = SEED, narrow: bool = False) -> DataFrame:
    """The rows of `docs` with size, source_size, target and takes: one (round, shard) for each time the mix takes the row.

    Sizes are words. Every source gives its whole permuted blocks round after round until its target is met, and of
    the last block the places up to it, to half a document; so its words are within one document of the target
    and no row is taken more than `repeats` times. Nothing is random between runs. All rows of a place, equal rows, are
    taken alike. Rows without words are taken with their block. Null sources are one source; an empty table gives an
    empty result. With `narrow`, only key and source are kept; else columns named as the added ones are replaced.
    `expand` turns the result into the mix itself.
    """
    columns = [key, source] if narrow else docs.columns
    needed = docs.select(F.col(source).cast("string").alias("source"), size_in_words(text).alias("size"), place(key, text, seed).alias("place"), *([F.col(key).alias("key")] if narrow else []))
    rows = save(needed, "sizes")
    aims, takes = plan(rows.select("source", "size", "place"), weights, repeats, shards, blocks, seed)
    if narrow:
        held = rows.select(F.col("key").alias(key), F.col("source").alias("__own"), "size", "place")
    else:
        held = docs.drop("size", "source_size", "target", "takes").withColumns({"__own": F.col(source).cast("string"), "size": size_in_words(text), "place": place(key, text, seed)})
    aims = aims.select(F.col("source").alias("__source"), "source_size", "target", "blocks")
    placed = held.join(aims, F.col("__own").eqNullSafe(F.col("__source"))).drop("__source").withColumn("__block", block())
    takes = takes.select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.col("takes").alias("__takes"))
    dealt = placed.join(takes, F.col("__own").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left")
    own = F.filter(F.coalesce("__takes", F.array().cast("array<struct<round:int,shard:int,last:bigint>>")), lambda x: F.col("place") <= x["last"])
    own = F.transform(own, lambda x: F.struct(x["round"].alias("round"), x["shard"].alias("shard")))
    if narrow:
        return dealt.select(key, F.col("__own").alias(source), "size", "source_size", "target", own.alias("takes"))
    kept = [c for c in columns if c not in ("size", "source_size", "target", "takes")]
    return dealt.select(*kept, "size", "source_size", "target", own.alias("takes"), F.col("place").alias("__place"))


def expand(mixed: DataFrame, columns: Sequence[str], seed: str = SEED) -> DataFrame:
    """`columns` of the mix, a row for each time it is taken, shard by shard, each shard shuffled by keyed digests."""
    each = mixed.select(*columns, F.col("__place"), F.explode("takes").alias("__take"))
    each = each.withColumn("__shard", F.col("__take.shard"))
    # As many pieces of a shard as the session has shuffle partitions, so that pieces follow the size it is set up for.
    pieces = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.xxhash64(F.lit(seed), "__place", "__take")
    return each.withColumn("__turn", turn).repartition("__shard", F.pmod("__turn", F.lit(pieces))).sortWithinPartitions("__shard", "__turn").select(*columns)
