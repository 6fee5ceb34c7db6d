import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rowlens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _expected(docs, items, k=10):
    held = [(key, _terms(text)) for key, text in docs]
    held = [(key, terms) for key, terms in held if terms]
    total = sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        found = []
        for key, terms in held:
            m = 25 + 75 * len(terms) * len(held) // total
            score = 0
            for term in _terms(text):
                tf = terms.count(term)
                df = sum(term in t for _, t in held)
                score += math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(found)[:k], 1)]
    return out


def _rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _words(draw, n, kinds=40):
    return " ".join(f"w{min(int(draw.expovariate(0.15)), kinds)}" for _ in range(n))


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], "item_id long, text string, rank int, key long, number long, shard int")


@pytest.mark.parametrize("sizes", [(1 << 24, 64, 256, 4096, 256), (200, 3, 2, 5, 2)])
def test_random_texts(spark, documents, items, monkeypatch, sizes):
    """Large and small shards, blocks, windows and groups of items give what loops over everything give."""
    for name, value in zip(("SHARD_BYTES", "BLOCK", "FIRST_WINDOW", "WINDOW", "ITEMS"), sizes):
        monkeypatch.setattr(lexical, name, value)
    draw = random.Random(1)
    docs = [(i, _words(draw, draw.randint(0, 40))) for i in draw.sample(range(1000), 120)]
    asked = [(i, _words(draw, draw.randint(1, 12))) for i in range(12)]
    found = lexical.search_all(documents(docs), items(asked))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert _rows(found) == _expected(docs, asked)


def test_blocks_stay_compressed(monkeypatch):
    """Rare terms raise the threshold, and most blocks of a common term are never opened."""
    monkeypatch.setattr(lexical, "WINDOW", 512)
    draw = random.Random(2)
    texts = ["common " * draw.randint(1, 3) + _words(draw, 20) + (" rare rare odd" if i % 100 == 7 else "") for i in range(8000)]
    table = pa.array(texts)
    data, offsets = np.frombuffer(table.buffers()[2], np.uint8), np.frombuffer(table.buffers()[1], np.int32).astype(np.int64)
    holder, *rows = lexical.build_shard(0, pa.array(range(8000)), data, offsets, 8000, sum(len(t.split()) for t in texts)).to_pylist()
    m = np.frombuffer(holder["firsts"], np.int64)

    def lists():
        return {r["term"]: lexical.Postings(*(r[c] for c in ("df", "top", "firsts", "tops", "places", "widths", "data"))) for r in rows}

    asked = [b"rare", b"odd", b"common", b"w0"]
    found, whole, every = lists(), lists(), np.zeros(8000, np.int64)
    weights = {t: math.floor(1000 * math.log(16002 / (2 * found[t].df + 1))) + 1 for t in asked}
    best, score = lexical.search([found[t] for t in asked], np.array([weights[t] for t in asked]), m)
    for t in asked:
        docs, tf = whole[t].between(0, 8000)
        every[docs] += weights[t] * lexical.impact(tf, m[docs])
    order = np.lexsort((np.arange(8000), -every))[:10]
    assert best.tolist() == order.tolist() and score.tolist() == every[order].tolist()
    assert whole[b"common"].ready.all() and found[b"common"].ready.mean() < 0.6 and found[b"w0"].ready.mean() < 0.6


def test_ties_and_repeated_rows(spark, documents, items):
    docs = [(i, "same text here") for i in range(30, 0, -1)] + [(5, "same text here"), (5, "same other"), (99, "nothing shared")]
    asked = [(1, "same text"), (1, "same text"), (2, "here here same")]
    found = _rows(lexical.search_all(documents(docs), items(asked)))
    assert found == sorted(_expected(docs, asked), key=lambda r: r[:2])
    assert [r[2] for r in found if r[0] == 2] == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]


def test_awkward_rows(spark, awkward, items):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    asked = [(1, "ALPHA word1 café"), (2, None), (3, ""), (None, "no key"), (4, "unknownterm"), (5, " ".join(f"word{i}" for i in range(3000)))]
    found = _rows(lexical.search_all(awkward, items(asked)))
    assert found == sorted(_expected(rows, asked), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert {r[0] for r in found} == {1, 5, None}


def test_characters_and_case(spark, documents, items):
    docs = [(1, "Ünïcode ÜNÏCODE naïve"), (2, "under_score a-b c.d 3x3"), (3, "a\x00b\x7fc~d{e}f`g"), (4, "😀 梦 梦梦")]
    asked = [(1, "Ünïcode"), (2, "ünïcode UNDER score 3X3"), (3, "A B C D E F G"), (4, "梦 😀")]
    assert _rows(lexical.search_all(documents(docs), items(asked))) == _expected(docs, asked)


def test_terms_in_every_document_score_nothing(spark, documents, items):
    docs = [(i, "all " + ("few" if i < 3 else "many")) for i in range(2000)]
    asked = [(1, "all"), (2, "all few")]
    found = _rows(lexical.search_all(documents(docs), items(asked)))
    assert [r[2] for r in found] == [0, 1, 2]


def test_empty_tables(spark, documents, items):
    assert lexical.search_all(documents([]), items([(1, "a")])).collect() == []
    assert lexical.search_all(documents([(1, "a")]), items([])).collect() == []
    assert lexical.search_all(documents([(1, None), (2, "...")]), items([(1, "a")])).collect() == []
