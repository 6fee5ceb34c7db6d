"""Token counts of byte-pair vocabularies, by merging the pre-tokens of whole batches rank by rank in ragged arrays."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.llm.common import slices

# Context length above which a document does not fit a training example.
LIMIT = 4096

# Bytes of text whose pre-tokens are merged together; a longer document is handled alone.
BATCH_BYTES = 1 << 23
# A pre-token of more symbols is merged by itself, as each round looks at all its symbols.
LONG = 1 << 14

_NEVER = np.iinfo(np.int32).max
_SPACE = "▁"


@dataclass(frozen=True)
class Merges:
    """What a vocabulary says about pairs of symbols; a symbol is a piece, or a character that occurs in one."""

    symbols: int
    keys: np.ndarray  # left * symbols + right of every pair that joins to a piece, ascending
    ranks: np.ndarray  # the piece's place by score, equal for equal scores; one more entry stands for no pair
    joined: np.ndarray  # the piece
    of_char: np.ndarray  # symbol of a code point, -1 where no piece holds it
    cost: np.ndarray  # tokens that a surviving symbol counts for
    alone: np.ndarray  # bytes that no piece of several characters holds
    splits: bool  # no piece holds a space after another character
    prefix: bool  # a text is read as if a space stood before it


def load_pieces(path: str) -> Merges:
    """The merges of a SentencePiece BPE model with byte fallback that leaves texts as they are but for spaces.

    Other models raise ValueError: their texts would be normalised, or have tokens that no merge makes.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    probe = "a  b\tcﬁ é "
    prefix = model.normalize("a") == _SPACE + "a"
    if model.normalize(probe) != _SPACE * prefix + probe.replace(" ", _SPACE):
        raise ValueError("the model normalises texts")
    if sum(model.is_byte(i) for i in ids) != 256 or len(plain) + 256 + sum(model.is_control(i) or model.is_unknown(i) for i in ids) != len(ids):
        raise ValueError("the model has no byte fallback, or unused pieces")
    # Symbols of the type 4 are cut out before any merge.
    if any(kind == 4 for kind in _piece_types(model.serialized_model_proto())):
        raise ValueError("the model has user-defined symbols")
    return merges_of([model.id_to_piece(i) for i in plain], [model.get_score(i) for i in plain], prefix)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _piece_types(model: bytes) -> list[int]:
    """The type of each piece: field 3 of the messages in field 1; 1, an ordinary piece, where it is not stated."""
    return [dict(_fields(value)).get(3, 1) for number, value in _fields(model) if number == 1]


def merges_of(pieces: list[str], scores: list[float], prefix: bool = True) -> Merges:
    """The pairs that join to each piece: all its cuts into two symbols."""
    names = {p: i for i, p in enumerate(pieces)}
    for p in pieces:
        for c in p:
            names.setdefault(c, len(names))
    _, rank = np.unique(-np.array(scores, np.float64), return_inverse=True)
    total = len(names)
    rows = [(names[p[:cut]] * total + names[p[cut:]], rank[i], i) for i, p in enumerate(pieces) for cut in range(1, len(p)) if p[:cut] in names and p[cut:] in names]
    keys, ranks, joined = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    of_char = np.full(0x110000, -1, np.int32)
    cost = np.ones(total, np.int32)
    for name, i in names.items():
        if len(name) == 1:
            of_char[ord(name)] = i
            cost[i] = 1 if i < len(pieces) else len(name.encode())
    # The code point of a space is read as the mark that stands for it.
    of_char[0x20] = of_char[ord(_SPACE)]
    alone = np.zeros(256, bool)
    alone[:128] = True
    alone[[ord(c) for p in pieces if len(p) > 1 for c in p if ord(c) < 128]] = False
    alone[0x20] = False
    return Merges(
        symbols=total,
        keys=np.ascontiguousarray(keys),
        ranks=np.append(ranks, _NEVER).astype(np.int32),
        joined=np.append(joined, -1).astype(np.int32),
        of_char=of_char,
        cost=np.append(cost, 0).astype(np.int32),
        alone=alone,
        splits=not any(b == _SPACE != a for p in pieces for a, b in zip(p, p[1:])),
        prefix=prefix,
    )


def _pairs(merges: Merges, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Entry of each pair in the merges; -1, which has the rank of no pair, where the two do not join."""
    if not len(merges.keys):
        return np.full(len(left), -1, np.int64)
    key = left.astype(np.int64) * merges.symbols + right
    place = np.searchsorted(merges.keys, key)
    place[place == len(merges.keys)] = 0
    return np.where((merges.keys[place] == key) & (left >= 0) & (right >= 0), place, -1)


def _one_by_one(merges: Merges, symbols: list[int], weight: list[int]) -> int:
    """Tokens of one sequence, its pairs joined in order of rank and place."""
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    pairs = _pairs(merges, np.array(symbols[:-1]), np.array(symbols[1:])) if len(symbols) > 1 else []
    heap = [(int(merges.ranks[p]), i, symbols[i], symbols[i + 1], int(merges.joined[p])) for i, p in enumerate(pairs) if p >= 0]
    heapq.heapify(heap)
    while heap:
        _, i, left, right, joined = heapq.heappop(heap)
        j = after[i]
        # A pair of which a part was joined elsewhere is gone.
        if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
            continue
        symbols[i], symbols[j], weight[i], weight[j] = joined, -2, int(merges.cost[joined]), 0
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(symbols):
                p = int(_pairs(merges, np.array([symbols[a]]), np.array([symbols[b]]))[0])
                if p >= 0:
                    heapq.heappush(heap, (int(merges.ranks[p]), a, symbols[a], symbols[b], int(merges.joined[p])))
    return sum(weight)


def count_merged(merges: Merges, symbols: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each sequence of `lengths` symbols; `weight` is what each symbol counts for while it is not joined.

    A round finds the lowest rank of every sequence and joins all its pairs of that rank, from left to right. That equals joining one
    pair at a time unless a pair that arises has no higher rank; such sequences, and those of more than LONG
    symbols, are finished one pair at a time.
    """
    result = np.zeros(len(lengths), np.int64)
    names = np.flatnonzero(lengths > 0)
    lengths = lengths[names]
    place = None
    while len(names):
        first = np.cumsum(lengths) - lengths
        if place is None:
            place = np.full(len(symbols), -1, np.int64)
            place[:-1] = _pairs(merges, symbols[:-1], symbols[1:])
            place[first[1:] - 1] = -1
        rank = merges.ranks[place]
        lowest = np.minimum.reduceat(rank, first)
        hit = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank != _NEVER))
        # Of neighbouring hits, which overlap, every second one counts from the left.
        run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
        hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
        made = merges.joined[place[hit]]
        owner = np.searchsorted(first, hit, "right") - 1
        stop = first + lengths
        # What stands to the left is already joined where the hit before reaches up to this one.
        left = np.where(hit > first[owner], symbols[hit - 1], -1)
        touching = np.flatnonzero((np.diff(hit, prepend=-9) == 2) & (hit > first[owner]))
        left[touching] = made[touching - 1]
        right = np.where(hit + 2 < stop[owner], symbols[np.minimum(hit + 2, len(symbols) - 1)], -1)
        arising = np.minimum(merges.ranks[_pairs(merges, left, made)], merges.ranks[_pairs(merges, made, right)])
        single = lengths > LONG
        single[owner[arising <= lowest[owner]]] = True
        single &= lowest != _NEVER
        for s in np.flatnonzero(single):
            part = slice(first[s], stop[s])
            result[names[s]] = _one_by_one(merges, symbols[part].tolist(), weight[part].tolist())
        done = lowest == _NEVER
        if done.any():
            result[names[done]] = np.add.reduceat(weight, first)[done]
        over = done | single
        hit, made = hit[~over[owner]], made[~over[owner]]
        symbols[hit], weight[hit] = made, merges.cost[made]
        stays = np.repeat(~over, lengths)
        changed = np.zeros(len(symbols), bool)
        changed[hit] = True
        changed[np.maximum(hit - 1, 0)] = True
        lost = hit + 1
        lengths = (lengths - np.bincount(owner[~over[owner]], minlength=len(lengths)))[~over]
        names = names[~over]
        stays[lost] = False
        # The symbol left of a hit may itself be lost; what it was joined to stands before the hit then.
        changed[np.maximum(lost - 1, 0)] = True
        before_lost = np.flatnonzero(changed & ~stays) - 1
        changed[before_lost[before_lost >= 0]] = True
        symbols, weight, place, changed = symbols[stays], weight[stays], place[stays], changed[stays]
        ends = np.zeros(len(symbols), bool)
        ends[np.cumsum(lengths) - 1] = True
        again = np.flatnonzero(changed & ~ends)
        place[again] = _pairs(merges, symbols[again], symbols[again + 1])
        place[ends] = -1
    return result


def count_tokens(merges: Merges, texts: pa.Array) -> np.ndarray:
    """Tokens of each text. Null and empty texts have none.

    Texts are cut into pre-tokens where no piece could reach across; each distinct one of a batch is merged once.
    """
    counts = np.zeros(len(texts), np.int64)
    for first, last, data, offsets in slices(texts, BATCH_BYTES):
        if merges.prefix:
            filled = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][filled], 0x20)
            offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        if not len(data):
            continue
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        # 0x81 may end the mark that stands for a space.
        space = (data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81) if merges.splits else np.zeros(len(data) - 1, bool)
        begins[1:] |= space | merges.alone[data[1:]] | merges.alone[data[:-1]]
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        tokens = _distinct_tokens(merges, coded.dictionary)[np.asarray(coded.indices)]
        total = np.concatenate([[0], np.cumsum(tokens)])
        counts[first:last] = np.diff(total[np.searchsorted(starts, offsets)])
    return counts


def _distinct_tokens(merges: Merges, words: pa.Array) -> np.ndarray:
    raw = np.frombuffer(words.buffers()[2], np.uint8)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = raw[bounds[0] : bounds[-1]]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    lengths = np.diff(heads[bounds - bounds[0]])
    symbols = merges.of_char[points]
    # A character without a piece falls back to its bytes.
    in_bytes = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    weight = np.where(symbols >= 0, merges.cost[symbols], in_bytes).astype(np.int32)
    return count_merged(merges, symbols, weight, lengths)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, by the vocabulary in the file `path`, which only the driver reads.

    n_bytes counts the whole text as UTF-8; over_limit: more than `limit` tokens. Null and empty texts have 0 of both;
    a null key stays null, repeated rows get a row each, an empty table gives none. Further columns are not read. Nothing
    is shuffled; what tasks receive is the vocabulary's own size.
    """
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([narrow.schema["key"], *T.StructType.fromDDL("n_bytes long, n_tokens long").fields])
    # As large as the vocabulary and a table of code points: 8 MB for 32,000 pieces.
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = shared.value
        for batch in batches:
            size = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(count_tokens(merges, batch.column(1)))], names=["key", "n_bytes", "n_tokens"])

    found = narrow.mapInArrow(counted, schema)
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
