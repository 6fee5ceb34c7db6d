"""Helpers shared by the operators: written tables in the shared folder, and words of whole Arrow batches in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.sources.scratch import scratch_path

# Bytes of text handled at once inside a task; a longer document is handled alone.
SLICE_BYTES = 1 << 20

# Bytes that separate words in most contracts: space, and tab to carriage return.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])

WORD = r"[^\x20\x09-\x0D]+"


def save(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cut lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(key: str = "doc_id") -> Column:
    """CRC-32 of an id as text; null where the id is null."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def ascii_lower_table(separators: bytes) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    # A zero byte that is no separator would read as one; 0xFF never occurs in UTF-8.
    if 0 not in separators:
        table[0] = 0xFF
    return table


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, one past the last, their bytes and row offsets. Null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    # The batch itself is not copied unless it holds nulls.
    texts = texts if texts.null_count == 0 else texts.fill_null("")
    rows = len(texts)
    if not rows:
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero codes, which never cross a row, and the first word of each row."""
    inside = codes != 0
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(codes))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# Bytes of a word that are hashed together with those of all others; a longer word is hashed alone.
_SHORT = 64


def hash_words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over all words at once, byte by byte, then mixed."""
    length = ends - starts
    h = length.astype(np.uint64)
    order = np.argsort(-np.minimum(length, _SHORT + 1), kind="stable")
    for i in order[: int(np.count_nonzero(length > _SHORT))]:
        h[i] = xxhash.xxh3_64_intdigest(codes[starts[i] : ends[i]].tobytes())
    order = order[int(np.count_nonzero(length > _SHORT)) :]
    at, left, own = starts[order], -length[order], h[order]
    active, step = len(at), 0
    while active:
        own[:active] = (own[:active] + codes[at[:active] + step]) * _ODD
        own[:active] ^= own[:active] >> np.uint64(29)
        step += 1
        active = int(np.searchsorted(left[:active], -step, "left"))
    h[order] = own
    return mix(h)
