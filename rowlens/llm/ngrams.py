"""Language-model scoring: word bigrams in a log-frequency Bloom filter, built and probed part by part where it lies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.llm.common import BLANKS, ascii_lower_table, crc_of_id, hash_words, mix, save, slices, word_spans

# Weight of the unigram probability in every context, in occurrences.
PRIOR = 5.0
# Added to each count by the unigram model.
ADDED = 0.1
# Hashes of a membership probe: about one wrong answer in a million, for 29 bits an entry.
HASHES = 20
# Tokens whose words and bigrams are told apart together before anything is shuffled.
CHUNK_TOKENS = 1 << 21
# Bytes of text for each part of the model, and the fewest parts; their number is a power of two.
PART_BYTES = 1 << 25
LEAST_PARTS = 64

# Bits of the second word's hash that tell apart the bigrams of one first word.
_FOLLOWER_BITS = 48

_CODES = ascii_lower_table(BLANKS)
_END = np.uint64(0xD1B54A32D192ED03)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one end after each row's, and where the rows begin."""
    codes = _CODES[data]
    starts, ends, of_row = word_spans(codes, offsets)
    rows = len(offsets) - 1
    out = np.full(len(starts) + rows, _END)
    out[np.arange(len(starts)) + np.repeat(np.arange(rows), np.diff(of_row))] = hash_words(codes, starts, ends)
    return out, of_row + np.arange(rows + 1)


def level(n: np.ndarray) -> np.ndarray:
    """Quantised count: 0 for none, 1 for once, then two levels for each doubling, rounded down."""
    return np.where(n > 0, 1 + np.floor(2 * np.log2(np.maximum(n, 1)) + 1e-9), 0).astype(np.int64)


def of_level(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for, never more than the true one; 0 for level 0."""
    return np.where(levels > 0, 2.0 ** ((levels - 1) / 2), 0.0)


def _positions(keys: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    first = mix(keys + np.uint64(at * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
    return first, mix(first) | np.uint64(1)


def filter_bits(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The packed bits of one part: each key is entered once for every level up to its own."""
    size = int(np.ceil(levels.sum() * HASHES / np.log(2)))
    bits = np.zeros(max(size, 1), bool)
    for at in range(1, int(levels.max(initial=0)) + 1):
        first, step = _positions(keys[levels >= at], at)
        for i in range(HASHES):
            bits[((first + np.uint64(i) * step) % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def probe(bits: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """The level of each key by membership probes: level after level, hash after hash, with the keys that are left."""
    out, left, at = np.zeros(len(keys), np.int64), np.arange(len(keys) if size else 0), 0
    while len(left):
        at += 1
        first, step = _positions(keys[left], at)
        for _ in range(HASHES):
            bit = (first % np.uint64(size)).astype(np.int64)
            held = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            first, step, left = first[held] + step[held], step[held], left[held]
        out[left] = at
    return out


@dataclass(frozen=True)
class Chunk:
    """The texts of a run of rows as numbers: distinct words by hash, distinct bigrams by first and second word."""

    name: int
    keys: pa.Array
    lengths: np.ndarray  # tokens of each row
    words: np.ndarray  # hashes, ascending
    learnt: np.ndarray  # occurrences of each word in rows to learn from
    followers: np.ndarray  # distinct bigrams that each word begins
    second: np.ndarray  # hashes of the second words, bigrams in order of their first words
    pairs_learnt: np.ndarray
    pairs: np.ndarray  # the bigram that ends at each token; before a row stands an end

    @property
    def seal(self) -> int:
        """Tells whether a chunk made again is the same one."""
        return xxhash.xxh3_64_intdigest(self.second.tobytes(), xxhash.xxh3_64_intdigest(self.words.tobytes()) & 0xFFFF) >> 1


def _chunk(name: int, held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> Chunk:
    keys, stream, lengths, learn = zip(*held)
    stream, lengths, learn = (np.concatenate(x) for x in (stream, lengths, learn))
    learn = np.repeat(learn, lengths)
    words, at = np.unique(stream, return_inverse=True)
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[np.cumsum(lengths) - lengths] = np.searchsorted(words, _END)
    codes, pairs, n = np.unique(before * len(words) + at, return_inverse=True, return_counts=True)
    if not learn.all():
        n = np.bincount(pairs[learn], minlength=len(codes))
    first, second = np.divmod(codes, len(words))
    learnt = np.bincount(at[learn], minlength=len(words))
    return Chunk(name, pa.concat_arrays(keys), lengths, words, learnt, np.bincount(first, minlength=len(words)), words[second], n, pairs)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of `batches(key, text, learn)`; a row is in one chunk, however long."""
    name, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        learn = np.asarray(batch.column(2))
        for start, stop, data, offsets in slices(batch.column(1)):
            stream, begins = tokens(data, offsets)
            held.append((batch.column(0).slice(start, stop - start), stream, np.diff(begins), learn[start:stop]))
            size += len(stream)
            if size > CHUNK_TOKENS:
                yield _chunk(name, held)
                name, held, size = name + 1, [], 0
    if held:
        yield _chunk(name, held)
    # The worker goes on to other tasks.
    pa.default_memory_pool().release_unused()


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def _wide(data: bytes, count: int) -> np.ndarray:
    """Numbers that `_narrow` has packed."""
    return np.frombuffer(data, f"<u{len(data) // count}").astype(np.int64) if count else np.empty(0, np.int64)


_ASKED = "part int, chunk long, seal long, words binary, learnt binary, followers binary, second binary, pairs_learnt binary"
_ANSWERED = "chunk long, part int, seal long, counts binary, kept binary, followers binary, levels binary, tokens long, distinct long"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def asked(rows: DataFrame, parts: int) -> DataFrame:
    """What each chunk has and wants to know of each part: its words, its bigrams, and how often they are to be learnt.

    A word lies in the part that the leading bits of its hash name, its bigrams beside it. What a task sends is already
    combined, some seven bytes a distinct bigram, so a frequent word or bigram costs one entry a chunk.
    """
    bits = parts.bit_length() - 1
    shift = np.uint64(64 - bits)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            cuts = np.searchsorted(c.words, np.arange(parts, dtype=np.uint64) << shift) if bits else np.zeros(1, np.int64)
            cuts = np.append(cuts, len(c.words))
            ends = np.concatenate([[0], np.cumsum(c.followers)])
            # The leading bits of the hashes, as six bytes each.
            second = (c.second >> np.uint64(64 - _FOLLOWER_BITS)).view(np.uint8).reshape(-1, 8)[:, : _FOLLOWER_BITS // 8]
            out: list[list] = [[] for _ in range(6)]
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                i, j = cuts[part], cuts[part + 1]
                p, q = ends[i], ends[j]
                row = (part, c.words[i:j], _narrow(c.learnt[i:j]), _narrow(c.followers[i:j]), np.ascontiguousarray(second[p:q]), _narrow(c.pairs_learnt[p:q]))
                for column, value in zip(out, row):
                    column.append(value if isinstance(value, int) else value.tobytes())
            n = len(out[0])
            columns = [pa.array(out[0], pa.int32()), pa.array([c.name] * n, pa.int64()), pa.array([c.seal] * n, pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]]
            yield pa.RecordBatch.from_arrays(columns, names=_names(_ASKED))

    return rows.mapInArrow(sent, _ASKED)


def _part_answers(table: pa.Table) -> pa.Table:
    """Builds one part of the model from all chunks, and answers each: word counts, what levels keep of them, bigram levels.

    A bigram's level comes from membership probes of the part's filter, which holds every learnt bigram once for every
    level up to its own. One more row, of chunk -1, sums up the part's words.
    """
    chunk, seal = table.column("chunk").to_pylist(), table.column("seal").to_pylist()
    part = table.column("part")[0].as_py()
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
    sizes = [len(x) for x in hashes]
    own, followers = ([_wide(x, n) for x, n in zip(table.column(name).to_pylist(), sizes)] for name in ("learnt", "followers"))
    pairs = [int(f.sum()) for f in followers]
    pairs_learnt = np.concatenate([_wide(x, n) for x, n in zip(table.column("pairs_learnt").to_pylist(), pairs)])
    second = np.zeros((sum(pairs), 8), np.uint8)
    second[:, : _FOLLOWER_BITS // 8] = np.frombuffer(b"".join(table.column("second").to_pylist()), np.uint8).reshape(-1, _FOLLOWER_BITS // 8)

    words, at = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(at, np.concatenate(own), len(words))
    first = np.repeat(at, np.concatenate(followers))
    keys = mix(words[first] + mix(second.view(np.uint64).ravel() + _STEP))
    keys, one, which = np.unique(keys, return_index=True, return_inverse=True)
    true = level(np.bincount(which, pairs_learnt, len(keys)))
    learnt = true > 0
    bits, size = filter_bits(keys[learnt], true[learnt]), int(np.ceil(true.sum() * HASHES / np.log(2)))
    levels = np.minimum(probe(bits, size, keys), 255).astype(np.uint8)[which]
    kept = np.bincount(first[one], of_level(true), len(words))
    cuts, ends = np.cumsum(sizes)[:-1], np.cumsum(pairs)[:-1]
    none = [b""] * 4
    rows = [
        (name, part, s, c.tobytes(), k.tobytes(), f.astype(np.uint32).tobytes(), v.tobytes(), 0, 0)
        for name, s, c, k, f, v in zip(chunk, seal, np.split(counts[at], cuts), np.split(kept[at], cuts), followers, np.split(levels, ends))
    ]
    rows.append((-1, part, 0, *none, int(counts.sum()), int(np.count_nonzero(counts))))
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=_names(_ANSWERED))


def _streams(rows: DataFrame) -> DataFrame:
    """(chunk, seal, keys, lengths, pairs): each chunk's rows as the bigrams that their tokens end, in three or four bytes each."""
    schema = T.StructType([*T.StructType.fromDDL("chunk long, seal long").fields, T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), *T.StructType.fromDDL("lengths binary, pairs binary").fields])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            planes = c.pairs.astype("<u4").view(np.uint8).reshape(-1, 4).T[: 3 if len(c.second) < 1 << 24 else 4]
            keys = pa.ListArray.from_arrays(pa.array([0, len(c.keys)], pa.int32()), c.keys)
            columns = [pa.array([c.name]), pa.array([c.seal]), keys, pa.array([c.lengths.astype(np.int64).tobytes()], pa.binary()), pa.array([planes.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(streamed, schema)


def _scores(stream: pa.Table, answers: pa.Table, total: int, distinct: int) -> pa.Table:
    """The rows of one chunk, scored from what the parts answered."""
    keys = stream.column("keys").combine_chunks()
    lengths = np.frombuffer(stream.column("lengths")[0].as_buffer(), np.int64)
    planes = np.frombuffer(stream.column("pairs")[0].as_buffer(), np.uint8).reshape(-1, int(lengths.sum()))
    pairs = sum(plane.astype(np.int64) << (8 * i) for i, plane in enumerate(planes))
    answers = answers.sort_by("part")
    if set(answers.column("seal").to_pylist()) != set(stream.column("seal").to_pylist()):
        raise RuntimeError("the rows came in another order when they were read again; write them to a table first")
    counts, kept, followers, levels = (np.concatenate([np.frombuffer(x, kind) for x in answers.column(name).to_pylist()]) for name, kind in (("counts", "f8"), ("kept", "f8"), ("followers", "u4"), ("levels", "u1")))
    before = np.repeat(np.arange(len(counts)), followers)[pairs]
    begins = np.cumsum(lengths) - lengths
    # A token is the first word of the next token's bigram; the last one is an end, as what stands before a row.
    word = np.empty_like(before)
    word[:-1] = before[1:]
    word[begins + lengths - 1] = before[begins[0]]
    count, context, kept = counts[word], counts[before], kept[before]
    unigram = (count + ADDED) / (total + ADDED * (distinct + 1))
    # A context that was never seen needs no probe.
    pair = np.where(kept > 0, of_level(levels.astype(np.int64))[pairs], 0.0)
    # What the filter rounds off a context's counts goes to the unigrams, so that all adds up to one.
    smoothed = (pair + (PRIOR + np.maximum(context - kept, 0)) * unigram) / (np.maximum(context, kept) + PRIOR)
    sums = [np.add.reduceat(x, begins) for x in (count > 0, np.log10(unigram), np.log10(np.minimum(smoothed, 1.0)))]
    columns = [keys.flatten(), pa.array(lengths), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
    return pa.table(columns, names=["key", "n_tokens", "n_known", "base_score", "score"])


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: CRC-32 of the key as text can be divided by 10. A null key is not."""
    return F.coalesce(crc_of_id(key) % 10 == 0, F.lit(False))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", learn: Column | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    Learns from the rows where `learn` holds (by default those not held out). base_score is the unigram model with
    0.1 added to every exact count, score the bigram model: quantised bigram counts come from membership probes of
    a Bloom filter of all bigrams, one entry for each level of a bigram's count, and what they round off a context's
    occurrences goes to the unigrams. Null and empty texts have one token, the end; a null `learn` is false. Without rows
    to learn from every token has probability 1. Further columns are not read; an empty table gives an empty result.

    The model grows with the corpus and is never in one place: the distinct words and bigrams of each chunk of text travel
    to the parts that own them, where the part of the filter is built, probed and dropped again; the answers meet
    the chunk's tokens. Parts follow the size of the texts, `part_bytes` each. The texts are read twice, and have to come in the same order:
    from files, as they do, or else the second reading raises an error.
    """
    chosen = F.coalesce(~held_out(key) if learn is None else learn, F.lit(False))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), chosen.alias("learn"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, 1 << (-(-size // part_bytes) - 1).bit_length()) if size else 1
    answers = save(asked(rows, parts).groupBy("part").applyInArrow(_part_answers, _ANSWERED), "answers")
    total, distinct = answers.where("chunk = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    fields = [T.StructField("key", docs.schema[key].dataType), *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields]
    schema = T.StructType(fields)

    def scored(stream: pa.Table, mine: pa.Table) -> pa.Table:
        return _scores(stream, mine, total, distinct)

    known = answers.where("chunk >= 0").groupBy("chunk")
    found = _streams(rows).groupBy("chunk").cogroup(known).applyInArrow(scored, schema)
    return found.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
