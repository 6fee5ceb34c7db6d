"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore, and the shards' heaps merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.llm.common import ascii_lower_table, save, slices, word_spans

K = 10
# Bytes of text in a shard (a longer document is one alone), postings in a block, and items searched together.
SHARD_BYTES = 1 << 24
BLOCK = 64
ITEMS = 256
# Documents scored at once: few at first, so that a threshold is there early.
FIRST_WINDOW, WINDOW = 256, 4096

# Terms are runs of a-z, 0-9 and bytes beyond ASCII, after A-Z are lower-cased.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TERM_BYTES = ascii_lower_table(_SEPARATORS)

_INDEX = "shard long, term binary, df int, top int, firsts binary, tops binary, places binary, widths binary, data binary"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a run of rows, coded by their bytes, and how many each row has."""
    codes = _TERM_BYTES[data]
    starts, ends, of_row = word_spans(codes, offsets)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    joined = np.ascontiguousarray(codes[codes != 0])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(joined)])
    return words.dictionary_encode(), np.diff(of_row)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's occurrences are worth in a document of length norm m, before the term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 25 + 75 * n.astype(np.int64) * documents // max(terms, 1)


def _widths(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes that the largest value of each block needs: 1, 2 or 4."""
    most = np.maximum.reduceat(values, starts)
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.int64)


def _scatter(out: np.ndarray, values: np.ndarray, at: np.ndarray, width: np.ndarray) -> None:
    for byte in range(4):
        some = width > byte
        out[at[some] + byte] = (values[some] >> (8 * byte)) & 255


def _gather(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    values = np.zeros(len(at), np.int64)
    for byte in range(4):
        some = np.flatnonzero(width > byte)
        if not len(some):
            break
        values[some] |= data[at[some] + byte].astype(np.int64) << (8 * byte)
    return values


def _slots(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of `counts` elements."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def build_shard(shard: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, documents: int, terms: int) -> pa.RecordBatch:
    """Index rows of one shard: a row for each term, and one without a term that holds its documents.

    Documents are numbered by ascending id, null last. Postings come in blocks of BLOCK, each as differences of
    document numbers and as frequencies, in as many bytes as the block needs, beside its first document and its largest impact.
    """
    coded, counts = _terms(data, offsets)
    null = np.asarray(ids.is_null())
    names = ids.fill_null(0).to_numpy()
    order = np.lexsort((names, null))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    m = length_norm(counts, documents, terms)[order]
    rows: list[list] = [[None], [len(order)], [0], [m.tobytes()], [b""], [b""], [null[order].tobytes()], [names[order].astype(np.int64).tobytes()]]
    kinds = [pa.binary(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    columns = [pa.array(r, k) for r, k in zip(rows, kinds)]
    if len(coded):
        pairs = np.sort(np.asarray(coded.indices).astype(np.int64) * len(order) + np.repeat(number, counts))
        head = np.flatnonzero(np.diff(pairs, prepend=-1) != 0)
        tf = np.diff(head, append=len(pairs))
        term, doc = np.divmod(pairs[head], len(order))
        first = np.flatnonzero(np.diff(term, prepend=-1) != 0)
        df = np.diff(first, append=len(term))
        slot = _slots(df)
        starts = np.flatnonzero(slot % BLOCK == 0)
        held = np.diff(starts, append=len(term))
        delta = np.diff(doc, prepend=0)
        delta[starts] = 0
        tops = np.maximum.reduceat(impact(tf, m[doc]), starts)
        wide, high = _widths(delta, starts), _widths(tf, starts)
        sizes = held * (wide + high)
        places = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint8)
        inside, base = _slots(held), np.repeat(places, held)
        _scatter(out, delta, base + inside * np.repeat(wide, held), np.repeat(wide, held))
        _scatter(out, tf, base + np.repeat(held * wide, held) + inside * np.repeat(high, held), np.repeat(high, held))
        blocks = -(-df // BLOCK)
        head_block = np.cumsum(blocks) - blocks
        # Places count from the start of the term's own bytes.
        own = places - np.repeat(places[head_block], blocks)

        def cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
            raw = np.ascontiguousarray(values)
            bounds = (np.concatenate([[0], ends]) * raw.itemsize).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])

        last = np.cumsum(blocks)
        more = [
            coded.dictionary.cast(pa.binary()),
            pa.array(df.astype(np.int32)),
            pa.array(np.maximum.reduceat(tops, head_block).astype(np.int32)),
            cut(doc[starts].astype(np.int32), last),
            cut(tops.astype(np.int32), last),
            cut(own.astype(np.int32), last),
            cut((wide * 16 + high).astype(np.uint8), last),
            cut(out, np.cumsum(np.add.reduceat(sizes, head_block))),
        ]
        columns = [pa.concat_arrays([a, b]) for a, b in zip(columns, more)]
    shards = pa.array(np.full(len(columns[0]), shard))
    return pa.RecordBatch.from_arrays([shards, *columns], names=[f.split()[0] for f in _INDEX.split(", ")])


class Postings:
    """One term's list in a shard; blocks are decompressed when first needed, each at most once."""

    def __init__(self, df: int, top: int, firsts: bytes, tops: bytes, places: bytes, widths: bytes, data: bytes):
        self.df, self.top = df, top
        self.firsts, self.tops, self.places = (np.frombuffer(x, np.int32) for x in (firsts, tops, places))
        self.widths, self.data = np.frombuffer(widths, np.uint8), np.frombuffer(data, np.uint8)
        self.ready = np.zeros(len(self.firsts), bool)
        self.docs, self.tf = np.empty(df, np.int32), np.empty(df, np.int64)

    def open(self, blocks: np.ndarray) -> None:
        new = blocks[~self.ready[blocks]]
        if not len(new):
            return
        self.ready[new] = True
        held = np.minimum(BLOCK, self.df - new * BLOCK)
        wide, high = (np.repeat(w, held) for w in (self.widths[new] >> 4, self.widths[new] & 15))
        inside, base = _slots(held), np.repeat(self.places[new].astype(np.int64), held)
        delta = _gather(self.data, base + inside * wide, wide)
        total = np.cumsum(delta)
        heads = np.cumsum(held) - held
        at = np.repeat(new * BLOCK, held) + inside
        self.docs[at] = total - np.repeat(total[heads], held) + np.repeat(self.firsts[new], held)
        self.tf[at] = _gather(self.data, base + np.repeat(held, held) * wide + inside * high, high)

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents in [low, high) and their frequencies."""
        a = max(int(np.searchsorted(self.firsts, low, "right")) - 1, 0)
        b = int(np.searchsorted(self.firsts, high, "left"))
        if b <= a:
            return self.docs[:0], self.tf[:0]
        self.open(np.arange(a, b))
        part = slice(a * BLOCK, min(b * BLOCK, self.df))
        docs = self.docs[part]
        i, j = np.searchsorted(docs, [low, high])
        return docs[i:j], self.tf[part][i:j]


def search(lists: list[Postings], weights: np.ndarray, m: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a shard and their scores, of scores above 0, ties to the smaller number.

    Lists are ordered by the most they can add. Those that together cannot lift a document above the k-th best score so far
    are non-essential: only documents of the other lists are candidates, and a candidate is looked up in a non-essential list
    only if the list's block at its place could still lift it; the other blocks stay compressed. Documents go by
    ascending number, so one that merely equals the threshold comes too late.
    """
    best, score = np.empty(0, np.int64), np.empty(0, np.int64)
    most = weights * np.array([p.top for p in lists], np.int64)
    order = np.argsort(most, kind="stable")
    lists, weights, most = [lists[i] for i in order], weights[order], most[order]
    reach = np.concatenate([[0], np.cumsum(most)])
    threshold = 0
    low = 0
    while low < len(m):
        high = min(low + (WINDOW if low else FIRST_WINDOW), len(m))
        # The first `essential` lists reach the threshold at most.
        essential = int(np.searchsorted(reach, threshold, "right")) - 1
        if essential == len(lists):
            break
        total = np.zeros(high - low, np.int64)
        for p, w in zip(lists[essential:], weights[essential:]):
            docs, tf = p.between(low, high)
            total[docs - low] += w * impact(tf, m[docs])
        found = np.flatnonzero(total)
        for i in range(essential - 1, -1, -1):
            found = found[total[found] + reach[i + 1] > threshold]
            if not len(found):
                break
            p, docs = lists[i], found + low
            block = np.searchsorted(p.firsts, docs, "right") - 1
            bound = np.where(block >= 0, weights[i] * p.tops[np.maximum(block, 0)].astype(np.int64), 0)
            hopeful = total[found] + reach[i] + bound > threshold
            found, docs, block = found[hopeful], docs[hopeful], block[hopeful]
            inside = block >= 0
            if inside.any():
                blocks = np.unique(block[inside])
                p.open(blocks)
                size = np.minimum(BLOCK, p.df - blocks * BLOCK)
                at = np.repeat(blocks * BLOCK, size) + _slots(size)
                held, tf = p.docs[at], p.tf[at]
                place = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                there = held[place] == docs
                total[found[there]] += weights[i] * impact(tf[place[there]], m[docs[there]])
        found = found[total[found] > threshold]
        if len(found):
            best, score = np.concatenate([best, found + low]), np.concatenate([score, total[found]])
            first = np.lexsort((best, -score))[:k]
            best, score = best[first], score[first]
            threshold = int(score[-1]) if len(score) == k else 0
        low = high
    return best, score


def _counted(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(word_spans(_TERM_BYTES[data], offsets)[2]) for _, _, data, offsets in slices(batch.column(0))]
            n = np.concatenate(n) if n else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(np.count_nonzero(n))]), pa.array([int(n.sum())])], names=["documents", "terms"])

    total = docs.select("text").mapInArrow(counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return total[0] or 0, total[1] or 0


def index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The inverted index of `docs(key, text)`, one row for each shard and term, and the number of documents with a term.

    A shard is made within a task from some 16 MB of text or one Arrow batch, whichever is less, so no list outgrows it however common its term.
    """
    documents, terms = _counted(docs)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1), SHARD_BYTES):
                yield build_shard(shard, batch.column(0).slice(first, last - first), data, offsets, documents, terms)
                shard += 1

    return docs.mapInArrow(built, _INDEX), documents


def _queries(items: DataFrame) -> DataFrame:
    """(number, term, n): the terms of each item with their repeats."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in slices(batch.column(1)):
                coded, counts = _terms(data, offsets)
                numbers = np.repeat(batch.column(0).to_numpy()[first : first + len(counts)], counts)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), coded.cast(pa.large_binary()).cast(pa.binary())], names=["number", "term"])

    return items.mapInArrow(split, "number long, term binary").groupBy("number", "term").agg(F.count("*").alias("n"))


def search_all(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = K) -> DataFrame:
    """(item_key, rank, key, score): the k best documents of every row of `items`, best first, ties by ascending key, null last.

    Terms, weights and scores are those of the module's rule: 64-bit integers, but for a term's weight, floor(1000 * ln((2N + 2) / (2 df + 1))).
    Documents of score 0 are not found, so null, empty and term-free texts on either side have no line; equal rows
    are documents, or items, each for itself; empty tables give no row. Further columns are not read.

    Every shard is searched for the items of a group at once, from the lists of their terms; each hands on k rows an item, of which
    tasks keep the best k before the shuffle.
    """
    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    built, documents = index(narrow)
    built = save(built, "index")
    numbered = save(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text")), "items")
    asked = save(_queries(numbered.select("number", "text")), "asked")
    groups = max(1, -(-numbered.count() // ITEMS))
    found = built.where("term is not null").join(asked.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.sum("df").alias("total"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * documents + 2)) / (2 * F.col("total") + 1))).cast("long")
    weighed = asked.join(df.select("term", weight.alias("weight")), "term")
    group = F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("group")
    wanted = weighed.groupBy("term", group).agg(F.collect_list(F.struct("number", (F.col("weight") * F.col("n")).alias("weight"))).alias("wanted"))
    kind = wanted.schema["wanted"].dataType
    holders = built.where("term is null").withColumns({"group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "wanted": F.lit(None).cast(kind)})
    met = found.join(save(wanted, "wanted"), "term").unionByName(holders)

    def searched(table: pa.Table) -> pa.Table:
        lists: list[Postings] = []
        asks: dict[int, tuple[list[int], list[int]]] = {}
        m = names = null = None
        for row in table.select(["term", "df", "top", "firsts", "tops", "places", "widths", "data", "wanted"]).to_batches():
            for term, *parts, items_of in zip(*(c.to_pylist() for c in row.columns)):
                if term is None:
                    m, null, names = np.frombuffer(parts[2], np.int64), np.frombuffer(parts[5], bool), np.frombuffer(parts[6], np.int64)
                    continue
                for want in items_of:
                    places, weights = asks.setdefault(want["number"], ([], []))
                    places.append(len(lists))
                    weights.append(want["weight"])
                lists.append(Postings(*parts))
        out = [(number, *search([lists[i] for i in places], np.array(weights, np.int64), m, k)) for number, (places, weights) in asks.items()]
        docs = np.concatenate([d for _, d, _ in out]) if out else np.empty(0, np.int64)
        return pa.table(
            {
                "number": pa.array(np.repeat([n for n, _, _ in out], [len(d) for _, d, _ in out]).astype(np.int64)),
                "key": pa.array(names[docs], mask=null[docs]),
                "score": pa.array(np.concatenate([s for _, _, s in out]) if out else np.empty(0, np.int64)),
            }
        )

    heaps = met.groupBy("shard", "group").applyInArrow(searched, "number long, key long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = numbered.select("number", F.col("item").alias("__item"))
    return best.join(named, "number").select(F.col("__item").alias(item_key), "rank", F.col("key").alias(key), "score")
