"""Hard negatives: integer inner products of anchors and candidates by Strassen multiplication, kept in mergeable heaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import save

SCALE = 256.0
POSITIVES = 5
NEGATIVES = 5

# Anchors and candidates that meet in one group of a task, and rows of a tile that is multiplied at once.
ANCHORS = 8192
CANDIDATES = 4096
TILE = 512
# Below this edge the blocks of a product are multiplied directly.
LEAF = 32


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The matrix product of int64 arrays by seven half-sized products a level, sides filled up with zeros to halve.

    All additions are exact modulo 2 ** 64, so every element that fits 64 bits comes out right whatever the sums
    between need.
    """
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
    b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * k), np.int64)
    out[:i, :k] = m1 + m4 - m5 + m7
    out[:i, k:] = m3 + m5
    out[i:, :k] = m2 + m4
    out[i:, k:] = m1 - m2 + m3 + m6
    return out[:rows, :columns]


def _packed(x: np.ndarray) -> np.ndarray:
    """The narrowest integers that hold the components."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def integer_rows(rows: DataFrame) -> DataFrame:
    """(id, label, dims, data, copies): the distinct rows of `rows(id, label, vector)` with their floor(256 * x) as bytes.

    Left out: rows with a null id, label, vector or component, a component that is not finite, or one that scaled
    does not fit 64 bits. Equal rows become one with their number, which tasks add up before the shuffle.
    """

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            flat = vectors.flatten()
            values = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            bounds = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False))]).astype(np.int64)
            fits = (values >= -(2.0**63)) & (values < 2.0**63)
            bad = np.concatenate([[0], np.cumsum(~fits)])
            data = [None if bad[e] > bad[s] else _packed(values[s:e].astype(np.int64)).tobytes() for s, e in zip(bounds, bounds[1:])]
            dims = pa.array(np.diff(bounds).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dims, pa.array(data, pa.binary())], names=["id", "label", "dims", "data"])

    whole = rows.where("id is not null and label is not null and vector is not null")
    packed = whole.mapInArrow(scaled, "id long, label long, dims int, data binary").where("data is not null")
    return packed.groupBy("id", "label", "dims", "data").agg(F.count("*").alias("copies"))


class _Side:
    """Rows of one side of a group, ascending by id, with their vectors as int64."""

    def __init__(self, table: pa.Table, dims: int):
        def numbers(name: str) -> np.ndarray:
            return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)

        order = np.argsort(numbers("id"), kind="stable")
        self.id, self.label, self.copies = (numbers(n)[order] for n in ("id", "label", "copies"))
        data = table.column("data").to_pylist()
        self.x = np.zeros((len(order), dims), np.int64)
        width = np.array([len(d) // dims if dims else 0 for d in data])[order]
        for w in {int(w) for w in width} - {0}:
            rows = np.flatnonzero(width == w)
            self.x[rows] = np.frombuffer(b"".join(data[order[r]] for r in rows), f"<i{w}").reshape(-1, dims)
        self.order = order


def first_rows(slot: np.ndarray, score: np.ndarray, name: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """A heap merge: of the entries of each slot those that make its first k rows, by score and then by smaller name."""
    order = np.lexsort((name, ~score, slot))
    slot, score, name, copies = slot[order], score[order], name[order], copies[order]
    before = np.cumsum(copies) - copies
    head = np.flatnonzero(np.diff(slot, prepend=-1) != 0)
    before -= np.repeat(before[head], np.diff(head, append=len(slot)))
    stays = before < k
    return slot[stays], score[stays], name[stays], copies[stays]


class _Heaps:
    """The first k rows of many slots, and for full ones the score that a later row with a larger id has to exceed."""

    def __init__(self, slots: int, k: int):
        self.k, self.rows = k, tuple(np.empty(0, np.int64) for _ in range(4))
        self.full, self.least = np.zeros(slots, bool), np.zeros(slots, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, name: np.ndarray, copies: np.ndarray) -> None:
        if len(slot):
            self.rows = first_rows(*(np.concatenate(pair) for pair in zip(self.rows, (slot, score, name, copies))), self.k)
            last = np.flatnonzero(np.diff(self.rows[0], append=-1) != 0)
            held = np.bincount(self.rows[0], self.rows[3], len(self.full))
            self.full = held >= self.k
            self.least[self.rows[0][last]] = self.rows[1][last]


def _positives(anchors: _Side, number: np.ndarray, rows: _Side) -> list[np.ndarray]:
    """Entries (number, score, id, copies) of the first rows with each anchor's label, the anchor itself left out."""
    heaps = _Heaps(len(number), POSITIVES)
    for label in np.intersect1d(anchors.label, rows.label):
        mine, same = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        for i in range(0, len(mine), TILE):
            a = mine[i : i + TILE]
            for j in range(0, len(same), TILE):
                b = same[j : j + TILE]
                score = strassen(anchors.x[a], rows.x[b].T)
                r, c = np.nonzero((score > heaps.least[a][:, None]) | ~heaps.full[a][:, None])
                value, r, c = score[r, c], a[r], b[c]
                copies = rows.copies[c].copy()
                # Equal rows are one entry, of which the anchor is one copy.
                alike = np.flatnonzero(anchors.id[r] == rows.id[c])
                copies[alike] -= (anchors.x[r[alike]] == rows.x[c[alike]]).all(axis=1)
                some = copies > 0
                heaps.add(r[some], value[some], rows.id[c[some]], copies[some])
    slot, score, name, copies = heaps.rows
    return [number[slot], score, name, copies]


def _negatives(anchors: _Side, number: np.ndarray, windows: list[np.ndarray], rows: _Side) -> list[np.ndarray]:
    """Entries (number, positive score, score, id, copies) of the first rows of other labels in each window."""
    owner, top, low = windows
    heaps = _Heaps(len(owner), NEGATIVES)
    # Windows of an anchor lie together; one row of slots holds its n-th windows.
    head = np.searchsorted(owner, np.arange(len(number)))
    held = np.bincount(owner, minlength=len(number))
    ceiling, floor = np.full(len(number), np.iinfo(np.int64).min), np.full(len(number), np.iinfo(np.int64).max)
    np.maximum.at(ceiling, owner, top)
    np.minimum.at(floor, owner, low)
    for i in range(0, len(number), TILE):
        a = np.arange(i, min(i + TILE, len(number)))
        for j in range(0, len(rows.id), TILE):
            b = np.arange(j, min(j + TILE, len(rows.id)))
            score = strassen(anchors.x[a], rows.x[b].T)
            within = (score <= ceiling[a][:, None]) & (score >= floor[a][:, None])
            r, c = np.nonzero(within & (anchors.label[a][:, None] != rows.label[b][None, :]))
            value, r, c = score[r, c], a[r], b[c]
            for n in range(int(held[a].max(initial=0))):
                has = held[r] > n
                w = head[r[has]] + n
                fit = (value[has] <= top[w]) & (value[has] >= low[w]) & (~heaps.full[w] | (value[has] > heaps.least[w]))
                heaps.add(w[fit], value[has][fit], rows.id[c[has][fit]], rows.copies[c[has][fit]])
    slot, score, name, copies = heaps.rows
    return [number[owner[slot]], top[slot], score, name, copies]


def _lowest(top: np.ndarray) -> np.ndarray:
    """The least n with 100 * n >= 80 * top, without leaving 64 bits."""
    return 4 * (top // 5) + (4 * (top % 5) + 4) // 5


def _grid(anchors: DataFrame, rows: DataFrame, chunks: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt over a grid of bounded groups: an anchor into all groups of its chunk, a row into all chunks of its group."""
    spread = F.xxhash64("id", "label", "data")
    dealt = anchors.withColumn("chunk", F.pmod(spread, F.lit(chunks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = rows.withColumn("group", F.pmod(spread, F.lit(groups)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # Vectors of unlike lengths have no inner product.
    keys = ["chunk", "group", "dims"]
    return dealt.groupBy(*keys), met.groupBy(*keys)


_POSITIVE = "number long, score long, id long, copies long"
_NEGATIVE = "number long, top long, score long, id long, copies long"


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k entries of each slot over all groups, with `before`, the rows that the entries ahead stand for.

    Tasks keep k entries a slot before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    ahead = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("before", F.coalesce(ahead, F.lit(0))).where(F.col("before") < k)


def _repeated(best: DataFrame, k: int) -> DataFrame:
    """One line for each row that an entry stands for, as `rank` from 1 to k."""
    last = F.least(F.col("before") + F.col("copies"), F.lit(k))
    return best.withColumn("rank", F.explode(F.sequence((F.col("before") + 1).cast("int"), last.cast("int"))))


def hard_negatives(rows: DataFrame, label: Column, anchor: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of `rows` where `anchor` holds.

    `label` and `anchor` are expressions over the columns of `rows`. Components become floor(256 * x); a score is the integer
    inner product with the anchor, exact wherever it fits 64 bits; rows meet only rows with as many components. Each anchor's positives
    are its first 5 other rows of its label, and each positive has the first 5 rows of other labels that score between 80 % and 100 % of
    it, higher scores first, ties by smaller id. A null `anchor` is false. Rows without id, label or a whole finite vector
    take no part; equal rows count one by one, on either side; anchors without a positive, and positives without a
    row in their window, have no line. An empty table gives none. Further columns are not read.

    Anchors and candidates meet in groups of bounded size on a grid; two passes, as the windows follow
    from the positives. Distinct rows are dealt by their hash, so copies and common labels fill no group.
    """
    narrow = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    every = save(integer_rows(narrow.select("id", "label", "vector")), "rows")
    asked = narrow.where("asks and id is not null and label is not null").select(F.col("id").alias("i"), F.col("label").alias("l")).distinct()
    asking = every.join(asked, (F.col("id") == F.col("i")) & (F.col("label") == F.col("l")), "left_semi")
    anchors = save(asking.withColumn("number", F.monotonically_increasing_id()), "anchors")
    chunks, groups = max(1, -(-anchors.count() // ANCHORS)), max(1, -(-every.count() // CANDIDATES))

    def near(mine: pa.Table, met: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _POSITIVE.split(", ")]
        if not mine.num_rows or not met.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        dims = mine.column("dims")[0].as_py()
        side = _Side(mine, dims)
        number = mine.column("number").combine_chunks().to_numpy()[side.order]
        return pa.table(dict(zip(names, _positives(side, number, _Side(met, dims)))))

    left, right = _grid(anchors, every, chunks, groups)
    positives = save(_best(left.cogroup(right).applyInArrow(near, _POSITIVE), ["number"], POSITIVES), "positives")

    def within(mine: pa.Table, met: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _NEGATIVE.split(", ")]
        if not mine.num_rows or not met.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        dims = mine.column("dims")[0].as_py()
        side = _Side(mine, dims)
        tops = mine.column("tops").to_pylist()
        sizes = np.array([len(tops[o]) for o in side.order])
        top = np.array([t for o in side.order for t in tops[o]], np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        number = mine.column("number").combine_chunks().to_numpy()[side.order]
        return pa.table(dict(zip(names, _negatives(side, number, [owner, top, _lowest(top)], _Side(met, dims)))))

    windows = positives.groupBy("number").agg(F.array_sort(F.collect_set("score")).alias("tops"))
    left, right = _grid(anchors.join(windows, "number"), every, chunks, groups)
    negatives = _best(left.cogroup(right).applyInArrow(within, _NEGATIVE), ["number", "top"], NEGATIVES)
    negatives = save(negatives, "negatives")
    named = anchors.select("number", F.col("id").alias("anchor_id"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    each = _repeated(positives, POSITIVES).select("number", F.col("id").alias("positive_id"), F.col("score").alias("top"))
    lines = _repeated(negatives, NEGATIVES).select("number", "top", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(each, "number").join(lines, ["number", "top"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("top").alias("positive_score"), "negative_score")
