"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly, tile against tile."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.llm.common import mix, save
from rowlens.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 3

# A tile holds fingerprints with the same population counts of all parts.
TILE = 1024

# Shingle hashes summed at once, so that a very long document needs no more memory than a short one.
_HASHES = 1 << 16

_LANE = 0x9E3779B97F4A7C15
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, lanes: int = 1) -> bytes:
    """SimHash of the XXH64 (seed 42) of all shingles, repeats included: a bit is 1 if set in over half of them.

    A-Z count as a-z; words end at space and tab to carriage return. Fewer words than a shingle has are one
    shingle; null and text without words give 0. A lane has 64 bits, big-endian; the first is that of the hashes
    themselves, further ones mix them anew.
    """
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return bytes(8 * lanes)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(stops), _HASHES):
        part = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + _HASHES], stops[i : i + _HASHES])], "<u8")
        each = np.stack([part, *(mix(part + np.uint64(k * _LANE & 0xFFFFFFFFFFFFFFFF)) for k in range(1, lanes))], axis=1)
        bits = np.unpackbits(each.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * total > len(stops), bitorder="little").view("<u8").astype(">u8").tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, lanes: int = 1) -> DataFrame:
    """(key, text_hash, fp) of every row; fp is the fingerprint's bytes, text_hash tells rows of one key apart."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    narrow = narrow.select("key", F.xxhash64("text").alias("text_hash"), "text")
    schema = T.StructType([*narrow.schema.fields[:2], T.StructField("fp", T.BinaryType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py(), words, lanes) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["key", "text_hash", "fp"])

    return narrow.mapInArrow(hashed, schema)


def _offsets(radius: int, parts: int) -> list[int]:
    """Differences of tile codes to visit: count vectors within `radius`, one of each pair of opposites.

    Two fingerprints that differ in r bits have counts whose differences sum to r at most, so all other
    pairs of tiles are skipped. A code holds 16 bits for each part.
    """
    near = [d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return sorted(sum(x << (16 * (parts - 1 - i)) for i, x in enumerate(d)) for d in near if d >= (0,) * parts)


def _parts(lanes: int, radius: int) -> int:
    """Finer parts skip more tiles but send a tile to more others: four parts for a small radius, else the whole."""
    return 4 if lanes == 1 and radius <= 3 else 1


def tiles(classes: DataFrame, lanes: int, parts: int) -> DataFrame:
    """(code, block, ids, data): fingerprints `classes(id, fp)` packed into blocks of at most TILE with equal counts."""
    size = 8 * lanes // parts
    masks = np.array([[1 << (16 * (parts - 1 - i // size)) if i // size < parts else 0 for i in range(8 * lanes)]])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 8 * lanes)
            code = (np.bitwise_count(raw).astype(np.int64) * masks).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(code), *batch.columns], names=["code", "id", "fp"])

    # A code goes to one task, so that its blocks are full; the task streams them and holds one at a time.
    dealt = classes.select("id", "fp").mapInArrow(coded, "code long, id long, fp binary").repartition("code").sortWithinPartitions("code", "id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        code = None
        rows: list[tuple[int, int, bytes, bytes]] = []

        def close() -> None:
            ids = np.array([i for i, _ in held], np.int64)
            rows.append((code, int(ids[0]), ids.tobytes(), b"".join(d for _, d in held)))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["code", "block", "ids", "data"])
            rows.clear()
            return out

        for batch in batches:
            for c, i, d in zip(*(column.to_pylist() for column in batch.columns)):
                if held and (c != code or len(held) == TILE):
                    close()
                    if len(rows) == 256:
                        yield batch_of()
                code = c
                held.append((i, d))
        if held:
            close()
        if rows:
            yield batch_of()

    # A block goes by its first id, which no other block has.
    return dealt.mapInArrow(packed, "code long, block long, ids binary, data binary")


def near(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of rows, one 64-bit lane a column, that differ in `radius` bits or fewer."""
    step = max(1, (1 << 16) // max(1, len(right)))
    found = []
    lanes = [np.ascontiguousarray(right[:, k]) for k in range(right.shape[1])]
    for i in range(0, len(left), step):
        differ = np.bitwise_count(left[i : i + step, :1] ^ lanes[0][None, :]).astype(np.uint16 if len(lanes) > 3 else np.uint8)
        for k in range(1, len(lanes)):
            differ += np.bitwise_count(left[i : i + step, k : k + 1] ^ lanes[k][None, :])
        a, b = np.nonzero(differ <= radius)
        if len(a):
            found.append((a + i, b))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as keep the same fingerprints connected: each one to the least of its part of the graph."""
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def links(classes: DataFrame, radius: int = RADIUS, lanes: int = 1) -> DataFrame:
    """(a, b) of ids of `classes(id, fp)`: enough pairs within `radius` bits that components equal those of all such pairs.

    Tiles whose population counts differ by more than the radius never meet; the others are compared bit for
    bit. What a pair of blocks finds leaves its task as a spanning forest, not as all its pairs.
    """
    parts = _parts(lanes, radius)
    blocks = save(tiles(classes, lanes, parts), "tiles")
    moves = F.explode(F.array([F.lit(d).cast("long") for d in _offsets(radius, parts)]))
    left = blocks.select(F.col("block").alias("left_block"), F.col("ids").alias("left_ids"), F.col("data").alias("left"), F.col("code").alias("from"), moves.alias("move"))
    left = left.select("left_block", "left_ids", "left", "move", (F.col("from") + F.col("move")).alias("code"))
    pairs = left.join(blocks, "code").where("move <> 0 or left_block <= block").select("left_ids", "left", "ids", "data")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in zip(*batch.columns):
                ids = [np.frombuffer(row[i].as_buffer(), np.int64) for i in (0, 2)]
                data = [np.frombuffer(row[i].as_buffer(), np.uint64).reshape(-1, lanes) for i in (1, 3)]
                i, j = near(data[0], data[1], radius)
                a, b = ids[0][i], ids[1][j]
                if (a != b).any():
                    found.append(forest(a[a != b], b[a != b]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, lanes: int = 1) -> DataFrame:
    """(key, text_hash, fp, component, kept_hash): the near-duplicate group of every row.

    Rows whose fingerprints differ in `radius` bits or fewer are linked; component is the smallest key
    reachable over links, the row itself included, and kept_hash the text_hash of the one row the group keeps: the
    least text_hash of that key. Rows of one fingerprint form a class, so copies are never compared; classes meet as
    tiles. A row without a key is compared like any other but never names a group unless all of it lack one:
    then component is null. An empty table gives an empty result. Further columns are not read.
    """
    rows = save(fingerprints(docs, key, text, words, lanes), "fingerprints")
    least = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "text_hash")))
    classes = rows.groupBy("fp").agg(least.alias("least"), F.min("text_hash").alias("any_hash"))
    # One lane is its own name; more are named by a hash.
    name = F.conv(F.hex("fp"), 16, -10).cast("long") if lanes == 1 else F.xxhash64("fp")
    classes = save(classes.withColumn("id", name), "classes")
    roots = components(links(classes, radius, lanes)).select(F.col("vertex").alias("id"), "root")
    rooted = save(classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("least"), F.min("any_hash").alias("any_hash"))
    named = rooted.select("fp", "root").join(groups, "root").select("fp", F.col("least.key").alias("component"), F.coalesce("least.text_hash", "any_hash").alias("kept_hash"))
    return rows.join(named, "fp").select(F.col("key").alias(key), "text_hash", "fp", "component", "kept_hash")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, lanes: int = 1) -> DataFrame:
    """The rows of `docs` with one row left of each group of `near_duplicates`, all columns as they were.

    Stays: the row with the group's smallest key (of several, the least hash of the text; of repeated rows, any one).
    """
    groups = near_duplicates(docs, key, text, words, radius, lanes)
    kept = groups.where(F.col(key).eqNullSafe(F.col("component")) & (F.col("text_hash") == F.col("kept_hash")))
    kept = save(kept.select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).distinct(), "kept")
    held = docs.withColumns({"__row_key": F.col(key), "__row_hash": F.xxhash64(F.col(text).cast("string"))})
    same = F.col("__row_key").eqNullSafe(F.col("__key")) & (F.col("__row_hash") == F.col("__hash"))
    return held.join(kept, same, "left_semi").dropDuplicates(["__row_key", "__row_hash"]).drop("__row_key", "__row_hash")


def hexadecimal(fp: str = "fp"):
    """A fingerprint of one lane as 16 lower-case hexadecimal digits."""
    return F.lower(F.hex(fp))
