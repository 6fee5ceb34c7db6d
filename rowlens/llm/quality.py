"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import BLANKS, ascii_lower_table, crc_of_id, hash_words, mix, slices, word_spans

# Labelled rows that a model is fitted on at most, chosen by a hash of their key: a bound on the one task that fits it.
SAMPLE = 16_384
BUCKETS = 1024
RANK = 8
# Each statistic also says into which of so many equally filled bins it falls.
BINS = 8

_EPOCHS = 12
_BATCH = 256
_RATE = 0.02
_DECAY = 1e-4

_CODES = ascii_lower_table(BLANKS)
_KIND = np.zeros((6, 256), bool)
_KIND[0, 65:91] = True  # capitals
_KIND[1, 97:123] = True  # small letters
_KIND[2, 48:58] = True  # digits
_KIND[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # signs
_KIND[4, 128:] = True  # beyond ASCII
_KIND[5, 10] = True  # line feeds

STATISTICS = 18


def _distinct(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, values and counts of the distinct pairs, in order of group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(first)
    return g[at], v[at], np.diff(np.append(at, len(g)))


def features(texts: pa.Array, metadata: Sequence[pa.Array]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, hashed words (rows x BUCKETS, unit length) and statistics with metadata."""
    meta = [np.asarray(m.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)) for m in metadata]
    for first, last, data, offsets in slices(texts):
        rows = last - first
        size = np.diff(offsets).astype(float)
        starts, ends, of_row = word_spans(_CODES[data], offsets)
        counts = np.diff(of_row)
        row = np.repeat(np.arange(rows), counts)
        hashes = hash_words(_CODES[data], starts, ends)
        g, v, n = _distinct(row, hashes)
        flat = np.bincount(g * BUCKETS + (v % np.uint64(BUCKETS)).astype(np.int64), np.log1p(n), rows * BUCKETS)
        words = flat.reshape(rows, BUCKETS).astype(np.float32)
        words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-9)

        some, many = np.maximum(size, 1), np.maximum(counts, 1)
        bytes_of = [np.diff(np.append(0, np.cumsum(k[data]))[offsets]) for k in _KIND]
        capitals, small, digits, signs, beyond, breaks = bytes_of
        most = np.zeros(rows)
        np.maximum.at(most, g, n)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        # Words that hold a sign, and lines that occur again in their row: a line's hash is the sum of its words', by position.
        signed = np.append(0, np.cumsum(_KIND[3][data]))
        with_sign = (signed[ends] > signed[starts]) if len(starts) else np.zeros(0, bool)
        line = np.append(0, np.cumsum(_KIND[5][data]))[starts] if len(starts) else starts
        begins = np.append(True, (line[1:] != line[:-1]) | (row[1:] != row[:-1]))[: len(line)]
        edges = np.flatnonzero(begins)
        place = np.arange(len(starts)) - np.repeat(edges, np.diff(np.append(edges, len(starts))))
        lines = np.add.reduceat(mix(hashes + place.astype(np.uint64)), edges) if len(edges) else hashes
        lg, _, ln = _distinct(row[edges], lines)
        n_lines, repeated = np.bincount(row[edges], minlength=rows), np.bincount(lg, ln - 1, rows)
        length = ends - starts
        total = np.bincount(row, length, rows)
        square = np.bincount(row, length.astype(float) ** 2, rows)
        mean = total / many
        stats = [
            np.log1p(size), np.log1p(counts), mean, np.sqrt(np.maximum(square / many - mean**2, 0)),
            capitals / np.maximum(capitals + small, 1), digits / some, signs / some, beyond / some, np.log1p(breaks),
            np.bincount(g, minlength=rows) / many, most / many, np.bincount(row, same, rows) / many,
            np.bincount(row, with_sign, rows) / many, repeated / np.maximum(n_lines, 1), np.log1p(counts / np.maximum(n_lines, 1)),
            np.bincount(g, n == 1, rows) / many, (size == 0).astype(float), np.log1p(size - total),
        ]
        for m in meta:
            given = m[first:last]
            stats += [np.log1p(np.maximum(np.nan_to_num(given), 0)), np.isnan(given).astype(float)]
        yield first, words, np.stack(stats, axis=1)


@dataclass(frozen=True)
class Model:
    """Scale and bin limits of the statistics, then the machine: bias, weights, and RANK factors for each input."""

    mean: np.ndarray
    spread: np.ndarray
    limits: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def inputs(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) / 4
        bins = (stats[:, :, None] >= self.limits[None]).sum(axis=2)
        one = (bins[:, :, None] == np.arange(BINS)).reshape(len(stats), -1)
        return np.concatenate([words, scaled.astype(np.float32), one.astype(np.float32) / 2], axis=1)

    def scores(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        x = self.inputs(words, stats)
        return 1 / (1 + np.exp(-np.clip(machine(x, self.bias, self.weights, self.factors)[0], -30, 30)))


def machine(x: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and x @ factors: all pairwise interactions in linear time, as half of squared sums less summed squares."""
    sums = x @ factors
    return bias + x @ weights + 0.5 * ((sums**2).sum(axis=1) - (x**2) @ (factors**2).sum(axis=1)), sums


def train(words: np.ndarray, stats: np.ndarray, labels: np.ndarray) -> Model:
    """Logistic loss, Adam over shuffled batches from a fixed seed: equal rows in equal order give an equal model."""
    width = stats.shape[1]
    if not len(labels):
        size = BUCKETS + width * (BINS + 1)
        return Model(np.zeros(width), np.ones(width), np.zeros((width, BINS - 1)), 0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    spread = stats.std(axis=0)
    limits = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    empty = Model(stats.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), limits, 0.0, np.empty(0), np.empty(0))
    x, y = empty.inputs(words, stats), labels.astype(np.float32)
    rng = np.random.default_rng(7)
    rate = np.clip(y.mean(), 0.01, 0.99)
    state = [np.array(np.log(rate / (1 - rate)), np.float32), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], RANK)).astype(np.float32)]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    step = 0
    for epoch in range(_EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), _BATCH):
            own = order[i : i + _BATCH]
            xs = x[own]
            out, sums = machine(xs, state[0], state[1], state[2])
            error = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[own]) / len(own)).astype(np.float32)
            squares = (xs**2).T @ error
            slope = [error.sum(), xs.T @ error + _DECAY * state[1], xs.T @ (error[:, None] * sums) - squares[:, None] * state[2] + _DECAY * state[2]]
            step += 1
            for k in range(3):
                first[k] = 0.9 * first[k] + 0.1 * slope[k]
                second[k] = 0.999 * second[k] + 0.001 * slope[k] ** 2
                state[k] = state[k] - _RATE * (1 - epoch / _EPOCHS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return Model(empty.mean, empty.spread, limits, float(state[0]), state[1].astype(np.float32), state[2].astype(np.float32))


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from: CRC-32 of the key as text leaves 1 when divided by 3. A null key is not."""
    return F.coalesce(crc_of_id(key) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", metadata: Sequence[str] = ("n_chars",), label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of `labels(key, label)`, label 0 or 1, from at most `sample` labelled rows that are not held out.

    The keys are chosen before any text is read, so the join broadcasts `sample` rows at most; one task fits the
    model on their features. Rows with another or no label, or no key, teach nothing; a key labelled or present twice
    counts each time. Without rows all scores are 0.5. The model comes to the driver: some 100 KB, whatever the input.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    chosen = chosen.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "label").limit(sample)
    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *(F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metadata)))
    rows = narrow.join(F.broadcast(chosen), "key")
    turn = F.xxhash64("key", "text")
    rows = rows.select(turn.alias("turn"), "label", "text", *(f"m{i}" for i in range(len(metadata))))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, stats in features(batch.column(2), batch.columns[3:]):
                n = len(words)
                packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (words, stats)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), *packed], names=["turn", "label", "words", "stats"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = STATISTICS + 2 * len(metadata)
        words, stats, labels = [np.empty((0, BUCKETS), np.float32)], [np.empty((0, width))], [np.empty(0)]
        for batch in batches:
            words += [np.frombuffer(x.as_buffer(), np.float32).reshape(1, -1) for x in batch.column(2)]
            stats += [np.frombuffer(x.as_buffer(), np.float64).reshape(1, -1) for x in batch.column(3)]
            labels.append(batch.column(1).to_numpy())
        model = train(np.concatenate(words), np.concatenate(stats), np.concatenate(labels))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.__dict__)], pa.binary())], names=["model"])

    described_rows = rows.mapInArrow(described, "turn long, label int, words binary, stats binary")
    gathered = described_rows.repartition(1).sortWithinPartitions("turn", "label")
    found = gathered.mapInArrow(fitted, "model binary").first()
    if found is None:
        return train(np.empty((0, BUCKETS)), np.empty((0, STATISTICS + 2 * len(metadata))), np.empty(0))
    return Model(**pickle.loads(found[0]))


def score(model: Model, text: str = "text", metadata: Sequence[str] = ("n_chars",)) -> Column:
    """The model's probability of label 1 for a row; null and empty texts have one too."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array, *given: pa.Array) -> pa.Array:
        out = [model.scores(words, stats) for _, words, stats in features(texts, given)]
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return scored(F.col(text).cast("string"), *(F.col(m).cast("double") for m in metadata))


def keep_good(docs: DataFrame, model: Model, text: str = "text", metadata: Sequence[str] = ("n_chars",), least: float = 0.5) -> DataFrame:
    """The rows of `docs` that score `least` or more, all columns as they were."""
    return docs.where(score(model, text, metadata) >= least)
