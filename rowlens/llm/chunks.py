"""Substring dedup: content-defined chunks, cut by a gear rolling hash and compared by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.llm.common import BLANKS, ascii_lower_table, save, slices, word_spans

# The gear hash of 16 bytes decides a cut: one byte in 32 ends a chunk, whatever comes before or after those 16.
WINDOW = 16
CUT_BITS = 5
# A longer chunk is cut anyway, at multiples of this length from its start.
LONGEST = 1024
# Runs of repeated chunks of fewer words than this are left alone.
LEAST_WORDS = 12

_CODES = ascii_lower_table(BLANKS)
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks: where the top bits of the gear hash are zero, at the end of a row, and in overlong chunks.

    The hash of a position sums the gear numbers of the bytes before it, each shifted by its distance; it is built for
    all positions at once, doubling the window. It counts 16 bytes, so equal text is cut alike 16 bytes after it begins.
    """
    h = _GEAR[data]
    reach = 1
    while reach < WINDOW:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(reach)
        # Nothing is taken over from the row before.
        heads = (offsets[1:-1, None] + np.arange(reach)).ravel()
        heads = heads[heads < len(data)]
        more[heads] = h[heads]
        h, reach = more, reach * 2
    # The bits that all 16 bytes reach and no byte further back would.
    found = np.flatnonzero((h >> np.uint32(WINDOW - CUT_BITS - 1)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    found = np.unique(np.concatenate([found, offsets[1:]]))
    begins = np.append(0, found[:-1])
    long = np.flatnonzero(found - begins > LONGEST)
    extra = [np.arange(begins[i] + LONGEST, found[i], LONGEST) for i in long]
    found = np.unique(np.concatenate([found, *extra])) if extra else found
    return found[found > 0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, then row, start, length, words begun and 64-bit digest of every chunk."""
    for first, _, data, offsets in slices(texts):
        if not len(data):
            continue
        ends = cuts(data, offsets)
        starts = np.append(0, ends[:-1])
        row = np.searchsorted(offsets, starts, "right") - 1
        begun = np.searchsorted(word_spans(_CODES[data], offsets)[0], np.append(starts, len(data)))
        raw = data.tobytes()
        digest = b"".join([xxhash.xxh3_64_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])
        yield first, row, starts - offsets[row], ends - starts, np.diff(begun), np.frombuffer(digest, np.int64)


def _chunked(rows: DataFrame) -> DataFrame:
    """(row, key, at, start, length, words, digest) for every chunk of `rows(row, key, text)`."""
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("at int, start int, length int, words int, digest long").fields])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, row, start, length, words, digest in chunks(batch.column(2)):
                own = pa.array(row + first)
                at = np.arange(len(row)) - np.searchsorted(row, row)
                numbers = [pa.array(x.astype(np.int32)) for x in (at, start, length, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *numbers, pa.array(digest)], names=schema.names)

    return rows.mapInArrow(chunked, schema)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, first_key, start, length, words, copy): every passage of `least_words` words or more that other rows hold too.

    A passage is a run of neighbouring chunks that each occur in several rows; start and length count UTF-8 bytes and
    reach from the first to the last such chunk, so up to a chunk is missing at either end. first_key is the key of the
    first row, in the order read, with a chunk of the passage; copy says that all its chunks occur in an earlier row:
    such a passage can go, as its first occurrence stays. Chunks end where their content says, so an insertion only changes
    the chunks around it. Digests have 64 bits; the tasks combine what they know of a digest before they shuffle it, so a
    chunk on a large share of all rows is one line a task, and the rows that hold it are split by the skew join. Null and
    empty texts have no chunk; rows are told apart by their place, so equal rows and equal keys are rows of their own.
    Further columns are not read; an empty table gives an empty result.
    """
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = save(_chunked(narrow), "chunks")
    held = rows.groupBy("digest").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").select("digest", "first")
    repeated = rows.join(held, "digest").select("row", "key", "at", "start", "length", "words", "first")
    # Neighbours share the difference between their number in the row and their number among its repeated chunks.
    run = F.col("at") - F.row_number().over(Window.partitionBy("row").orderBy("at"))
    runs = repeated.withColumn("run", run).groupBy("row", "run").agg(
        F.first("key").alias("key"),
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("length")).alias("end"),
        F.sum("words").cast("int").alias("words"),
        F.min("first").alias("first"),
        F.max((F.col("first") == F.col("row")).cast("int")).alias("own"),
    )
    runs = save(runs.where(F.col("words") >= least_words), "passages")
    # A first row holds the chunk as well, but perhaps in a run too short to be listed: its key is looked up in all chunks.
    firsts = save(runs.select("first").distinct(), "firsts")
    names = rows.where("at = 0").select(F.col("row").alias("first"), F.col("key").alias("first_key")).join(firsts, "first", "left_semi")
    return runs.join(names, "first").select(F.col("key").alias(key), "first_key", "start", (F.col("end") - F.col("start")).alias("length"), "words", (F.col("own") == 0).alias("copy"))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, text): every row of `docs` without the passages that are copies of an earlier row's.

    Rows are numbered and written first, so rows with equal keys, or none, lose what is a copy in themselves alone; earlier
    is the order in which the written rows are read, and of equal rows one keeps its text. Null and empty texts stay as they are.
    """
    narrow = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(text).cast("string").alias("text"))
    rows = save(narrow, "rows")
    copies = repeats(rows, "__row", "text", least_words).where("copy")
    gone = copies.groupBy(F.col("__row").alias("__of")).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("gone"))
    joined = rows.join(gone, F.col("__row") == F.col("__of"), "left")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, gone in zip(texts, spans):
            raw = t.as_py()
            if raw is not None and gone.is_valid:
                raw, at, parts = raw.encode(), 0, []
                for span in gone.as_py():
                    parts.append(raw[at : span["start"]])
                    at = span["start"] + span["length"]
                # A cut may fall into a character of several bytes: what is left of it goes.
                raw = b"".join([*parts, raw[at:]]).decode(errors="ignore")
            out.append(raw)
        return pa.array(out, pa.string())

    return joined.select(F.col("__key").alias(key), cut("text", "gone").alias("text"))
