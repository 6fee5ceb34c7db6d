"""Benchmark decontamination by winnowing: minimum k-gram hashes meet in a join, and hits are extended word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.llm.common import ascii_lower_table, hash_words, mix, save, slices, word_spans

# A shared span of SPAN words holds SPAN - GRAM + 1 k-grams, and the least of their hashes is chosen on both sides.
SPAN = 10
GRAM = 5

# Words are runs of a-z, 0-9 and bytes beyond ASCII, after A-Z are lower-cased.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_WORD_BYTES = ascii_lower_table(_SEPARATORS)
_AS_TEXT = np.where(_WORD_BYTES == 0, 0x20, _WORD_BYTES).astype(np.uint8).tobytes()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_AS_TEXT).split()


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, whichever row they belong to."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out = mix(out ^ hashes[j : j + n])
    return out


def fingerprints(texts: pa.Array, short: list[int], span: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, words per row, and the chosen fingerprints as (row, word position, hash).

    Chosen are the rightmost least `gram`-gram of every `span` words and, for each length in `short`, all runs
    of that many words: an item shorter than a span shares no full one.
    """
    window = span - gram + 1
    for first, last, data, offsets in slices(texts):
        codes = _WORD_BYTES[data]
        starts, ends, of_row = word_spans(codes, offsets)
        counts = np.diff(of_row)
        row = np.repeat(np.arange(len(counts)), counts)
        hashes = hash_words(codes, starts, ends)
        grams = _grams(hashes, gram)
        at, chosen = [], []
        n = len(hashes) - span + 1
        if n > 0:
            least, shift = grams[:n].copy(), np.zeros(n, np.int64)
            for j in range(1, window):
                other = grams[j : j + n]
                lower = other <= least
                least = np.where(lower, other, least)
                shift[lower] = j
            picked = np.zeros(len(grams), bool)
            whole = row[:n] == row[span - 1 :]
            picked[(np.arange(n) + shift)[whole]] = True
            at.append(np.flatnonzero(picked))
            chosen.append(grams[at[-1]])
        for k in short:
            runs = ~_grams(hashes, k)
            same = np.flatnonzero(row[: len(runs)] == row[k - 1 : k - 1 + len(runs)]) if len(runs) else np.empty(0, np.int64)
            at.append(same)
            chosen.append(runs[same])
        where = np.concatenate(at) if at else np.empty(0, np.int64)
        value = np.concatenate(chosen) if chosen else np.empty(0, np.uint64)
        yield first, counts, row[where], where - of_row[row[where]], value


def benchmark_windows(items: DataFrame, key: str, text: str, span: int, gram: int) -> DataFrame:
    """(item, hash, length, window): fingerprints of every item, and every window as its words.

    Items of fewer words than a span, but not none, are one window and one fingerprint. A row has a fingerprint,
    of `length` words (0: a k-gram of a longer item), or a window.
    """
    narrow = items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([narrow.schema["item"], *T.StructType.fromDDL("hash long, length int, window string").fields])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for first, _, row, _, value in fingerprints(batch.column(1), [], span, gram):
                rows += [(r + first, h, 0, None) for r, h in zip(row.tolist(), value.view(np.int64).tolist())]
            for r, t in enumerate(batch.column(1)):
                tokens = words(t.as_py())
                if 0 < len(tokens) < span:
                    whole = next(fingerprints(pa.array([b" ".join(tokens).decode()]), [len(tokens)], span, gram))
                    rows.append((r, int(whole[4].view(np.int64)[0]), len(tokens), None))
                rows += [(r, None, None, w) for w in {_window(tokens, i, span) for i in range(max(1, len(tokens) - span + 1))} if w]
            taken = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = [pa.int64(), pa.int32(), pa.string()]
            columns = [pa.array([r[i + 1] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([taken, *columns], names=["item", "hash", "length", "window"])

    return narrow.mapInArrow(chosen, schema)


def _window(tokens: list[bytes], start: int, length: int) -> str:
    return b" ".join(tokens[start : start + length]).decode()


def _document_fingerprints(docs: DataFrame, short: list[int], span: int, gram: int) -> DataFrame:
    """(key, text_hash, at, value): each fingerprint of a row, and one line at -1 with its number of words."""
    schema = T.StructType([docs.schema["key"], *T.StructType.fromDDL("text_hash long, at int, value long").fields])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, row, at, value in fingerprints(batch.column(2), short, span, gram):
                rows = pa.array(np.concatenate([np.arange(len(counts)), row]) + first)
                columns = [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(np.concatenate([np.full(len(counts), -1), at]).astype(np.int32)),
                    pa.array(np.concatenate([counts.astype(np.int64), value.view(np.int64)])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "text_hash", "at", "value"])

    return docs.mapInArrow(chosen, schema)


def _extended(marked: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, text_hash, start, length, window): the windows that each hit of a row can belong to."""
    schema = T.StructType([marked.schema["key"], *T.StructType.fromDDL("text_hash long, start int, length int, window string").fields])

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r, (text, marks) in enumerate(zip(batch.column(2), batch.column(3))):
                tokens, found = words(text.as_py()), set()
                for mark in marks.as_py():
                    at, length = mark["at"], mark["length"]
                    if length:
                        found.add((at, length))
                    else:
                        found |= {(i, span) for i in range(max(0, at + gram - span), min(at, len(tokens) - span) + 1)}
                rows += [(r, start, length, _window(tokens, start, length)) for start, length in found]
                if len(rows) > 50_000 or r + 1 == batch.num_rows:
                    taken = pa.array([x[0] for x in rows], pa.int64())
                    columns = [pa.array([x[i + 1] for x in rows], k) for i, k in enumerate([pa.int32(), pa.int32(), pa.string()])]
                    columns = [batch.column(0).take(taken), batch.column(1).take(taken), *columns]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "text_hash", "start", "length", "window"])
                    rows = []

    return marked.mapInArrow(extended, schema)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, text_hash, n_words, n_hit, items) for every row of `docs`.

    n_hit counts the words inside any occurrence of a window, `span` consecutive words of an item, or all
    words of a shorter one; items are the ids with an occurring window, as sorted text, once each. Fingerprints of
    both tables meet in an equi-join; the windows around each hit are then joined as words, so a hash
    collision shows nowhere. What comes from the benchmark is written first: a join broadcasts it only if it is
    known to be small. Windows that many items share are met once, however many items hold them. Null, empty and
    blank texts have no words; a null item id is named as the empty text; rows with equal keys are told apart by their
    texts, equal rows get equal lines. Empty tables give no row or no hit. Further columns are not read.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    narrow = narrow.select("key", F.xxhash64("text").alias("text_hash"), "text")
    both = save(benchmark_windows(items, item_key, item_text, span, gram), "benchmark")
    prints = save(both.where("hash is not null").select("hash", "length").distinct(), "benchmark-prints")
    # At most span - 1 lengths.
    lengths = both.where("window is not null").select(F.size(F.split("window", " ")).alias("n")).where(F.col("n") < span)
    short = sorted(r[0] for r in lengths.distinct().collect())
    lines = _document_fingerprints(narrow, short, span, gram)
    lines = lines.join(prints, (lines["value"] == prints["hash"]) & (lines["at"] >= 0), "left").where("at < 0 or hash is not null")
    lines = save(lines.drop("hash"), "lines")
    marks = lines.where("at >= 0").groupBy("key", "text_hash").agg(F.collect_set(F.struct("at", "length")).alias("marks"))
    marks = save(marks.select(F.col("key").alias("k"), F.col("text_hash").alias("h"), "marks"), "marks")
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h"))
    named = save(marks.select("k", "h"), "marked")
    texts = narrow.join(named, same, "left_semi").dropDuplicates(["key", "text_hash"])
    around = _extended(texts.join(marks, same).select("key", "text_hash", "text", "marks"), span, gram)
    windows = both.where("window is not null").select("item", "window")
    found = save(around.join(windows.select("window").distinct(), "window"), "found")
    covered = found.select("key", "text_hash", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")).distinct()
    covered = covered.groupBy(F.col("key").alias("k"), F.col("text_hash").alias("h")).agg(F.count("*").alias("n_hit"))
    pairs = found.select("key", "text_hash", "window").distinct().join(windows.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "window"), "window")
    held = pairs.groupBy("key", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = covered.join(held, same).select("k", "h", "n_hit", "items")
    return (
        lines.where("at < 0")
        .join(result, same, "left")
        .select(F.col("key").alias(key), "text_hash", F.col("value").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` in which no window of an item occurs, all columns as they were."""
    dirty = contamination(docs, items, key, text, **how).where("n_hit > 0")
    dirty = save(dirty.select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).distinct(), "dirty")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__hash"))
    return docs.join(dirty, same, "left_anti")
