import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlens.llm import ngrams


def words(text):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    return [*(text or "").encode().translate(lower).split(), None]


def check_base(rows, learnt, found):
    counts = Counter(w for t in learnt for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    expected = Counter()
    for _, t in rows:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words(t))
        expected[len(words(t)), sum(counts[w] > 0 for w in words(t)), total, round(base, 6)] += 1
    assert Counter((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected


def corpus():
    rng = np.random.default_rng(4)
    phrases = [" ".join(f"w{i}" for i in rng.integers(0, 300, 6)) for _ in range(40)]
    return [(i, " ".join(phrases[j] for j in rng.integers(0, 40, 8)).title()) for i in range(120)]


def test_counts_scores_and_parts(documents, monkeypatch):
    rows = corpus()
    found = ngrams.score(documents(rows)).collect()
    check_base(rows, [t for i, t in rows if zlib.crc32(str(i).encode()) % 10], found)
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] <= 0 for r in found)
    whole = {r["doc_id"]: r["score"] for r in found}
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", 50)
    for least, size in ((1, 1 << 30), (1, 1000), (1024, 1 << 20)):
        monkeypatch.setattr(ngrams, "LEAST_PARTS", least)
        cut = ngrams.score(documents(rows), part_bytes=size).collect()
        assert {r["doc_id"]: r["score"] for r in cut} == pytest.approx(whole, abs=1e-9)


def _smoothed(rows, learnt):
    """The bigram model in loops, with exact dictionaries instead of a filter."""
    single, double = Counter(), Counter()
    for t in learnt:
        sequence = [None, *words(t)]
        single.update(sequence[1:])
        double.update(zip(sequence, sequence[1:]))
    total, distinct = sum(single.values()), len(single)
    value = {p: 2 ** (math.floor(2 * math.log2(n) + 1e-9) / 2) for p, n in double.items()}
    kept = Counter()
    for (a, _), v in value.items():
        kept[a] += v
    out = {}
    for key, t in rows:
        sequence, score = [None, *words(t)], 0.0
        for a, b in zip(sequence, sequence[1:]):
            unigram = (single[b] + 0.1) / (total + 0.1 * (distinct + 1))
            context = single[a]
            smoothed = (value.get((a, b), 0) + (ngrams.PRIOR + max(context - kept[a], 0)) * unigram) / (max(context, kept[a]) + ngrams.PRIOR)
            score += math.log10(min(smoothed, 1.0))
        out[key] = score
    return out


def test_scores_are_those_of_exact_dictionaries(documents):
    rows = [*corpus(), (1000, "never seen words"), (1001, ""), (1002, None), (1003, "w1 " * 4000)]
    learnt = [t for i, t in rows if i % 3]
    found = {r["doc_id"]: r["score"] for r in ngrams.score(documents(rows), learn=F.col("doc_id") % 3 != 0).collect()}
    assert found == pytest.approx(_smoothed(rows, learnt), abs=1e-6)


def test_probabilities_of_a_context_add_up_to_one(documents):
    """Every word of the vocabulary, and an unknown one for all others, after one context."""
    learnt = "a b a c a b a d b a"
    vocabulary = ["a", "b", "c", "d"]
    rows = [(0, learnt)] + [(10 + i, w) for i, w in enumerate([*vocabulary, "other"])] + [(20, None)]
    found = {r["doc_id"]: r["score"] for r in ngrams.score(documents(rows), learn=F.col("doc_id") == 0).collect()}
    exact = _smoothed(rows, [learnt])
    assert found == pytest.approx(exact, abs=1e-9) and exact[20] < 0


def test_filter_gives_the_level_of_every_entry_and_hardly_others():
    rng = np.random.default_rng(1)
    keys, levels = rng.integers(0, 1 << 52, 5000).astype(np.uint64), rng.integers(1, 6, 5000)
    bits = ngrams.filter_bits(keys, levels)
    size = int(np.ceil(levels.sum() * ngrams.HASHES / np.log(2)))
    found = ngrams.probe(bits, size, keys)
    assert (found >= levels).all() and (found == levels).mean() > 0.999
    assert (ngrams.probe(bits, size, rng.integers(0, 1 << 52, 20_000).astype(np.uint64)) > 0).mean() < 0.001
    assert ngrams.probe(ngrams.filter_bits(keys[:0], levels[:0]), 0, keys).sum() == 0


def test_wrong_answers_are_as_rare_as_designed():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 62, 50_000).astype(np.uint64)
    levels = np.ones(50_000, np.int64)
    size = int(np.ceil(levels.sum() * ngrams.HASHES / np.log(2)))
    wrong = (ngrams.probe(ngrams.filter_bits(keys, levels), size, rng.integers(1 << 62, 1 << 63, 2_000_000).astype(np.uint64)) > 0).sum()
    assert wrong <= 12


def test_a_bigram_seen_once_counts(documents):
    rows = [(1, "alpha beta"), (2, "gamma delta"), (3, "alpha beta"), (4, "alpha delta")]
    found = {r["doc_id"]: r["score"] for r in ngrams.score(documents(rows), learn=F.col("doc_id") < 3).collect()}
    # Word counts are alike: one each, and two ends; contexts too.
    assert found[1] == pytest.approx(found[3]) and found[3] > found[4] + 0.1
    total, prior = 6, ngrams.PRIOR
    word, end = (1.1 / (total + 0.6), 2.1 / (total + 0.6))
    expected = [(1 + prior * word) / (2 + prior), (1 + prior * word) / (1 + prior), (1 + prior * end) / (1 + prior)]
    # The class of ends has one occurrence for each token that is one; what its bigrams do not keep goes to the unigrams.
    assert found[3] == pytest.approx(sum(map(math.log10, expected)))


def test_levels_round_down():
    n = np.arange(1, 5000)
    value = ngrams.of_level(ngrams.level(n))
    assert (value <= n + 1e-6).all() and (value * 2**0.5 > n - 1e-6).all()
    assert ngrams.level(np.array([0])) == 0


def test_awkward_rows(awkward, documents):
    found = ngrams.score(awkward).collect()
    assert len(found) == 10 and {r["n_tokens"] for r in found if r["doc_id"] in (2, 3, 4)} == {1}
    assert ngrams.score(documents([])).count() == 0
    alone = ngrams.score(documents([(1, "a b")]), learn=F.lit(False)).first()
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"]) == (0, 0, 0.0)
