import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowlens.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def merges():
    return tokens.load_pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _expected(library, texts):
    return [len(ids) for ids in library.encode([t or "" for t in texts], num_threads=1)]


PARTS = [
    "a", "th", "e", "ing", "ation", "The", " the", " ", "  ", "   ", " " * 17, "\n", "\t", "\r\n", "▁", "▁▁", "é", "é", "ﬁ", "梦", "的是",
    "한국", "в", "ский", "😀", "​", "　", "<s>", "</s>", "<unk>", "<0x0A>", "22", ".", "==" * 9, "ab" * 9, "a" * 33, "\x00", "\x7f",
]


def test_random_texts_agree_with_the_library(merges, library):
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    assert tokens.count_tokens(merges, pa.array(texts)).tolist() == _expected(library, texts)


def test_long_texts_agree_with_the_library(merges, library):
    draw = random.Random(6)
    letters = "".join(draw.choice("etaoinshrdlu") for _ in range(tokens.LONG + 10))
    texts = [letters, letters[:5000], " " * 20_000, "x" * 20_000, "word " * 50_000, "梦" * 9000, None, ""]
    assert tokens.count_tokens(merges, pa.array(texts)).tolist() == _expected(library, texts)


def test_batches_do_not_matter(merges, library, monkeypatch):
    texts = ["one two  three", None, "", " lead", "trail ", "a\nb\tc"] * 7
    monkeypatch.setattr(tokens, "BATCH_BYTES", 16)
    assert tokens.count_tokens(merges, pa.array(texts)).tolist() == _expected(library, texts)


def _by_hand(pieces, text):
    """Joins the best pair of a text, the leftmost of equals, until none is left."""
    parts = list(text)
    while True:
        pairs = [(pieces[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in pieces]
        if not pairs:
            return len(parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_any_vocabulary_is_merged_in_order():
    """Vocabularies with equal ranks, overlapping pairs, and pairs that rank before those they arise from."""
    draw = random.Random(7)
    for _ in range(150):
        names = list(dict.fromkeys(["a", "b", "c", *("".join(draw.choice("abc") for _ in range(draw.randint(2, 4))) for _ in range(12))]))
        scores = [0.0] * 3 + [-float(draw.randint(1, 9)) for _ in names[3:]]
        merges = tokens.merges_of(names, scores, prefix=False)
        texts = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 14))) for _ in range(40)]
        pieces = {n: -s for n, s in zip(names, scores) if len(n) > 1}
        assert tokens.count_tokens(merges, pa.array(texts)).tolist() == [_by_hand(pieces, t) for t in texts]


def test_characters_without_a_piece_count_their_bytes():
    merges = tokens.merges_of(["a", "ab"], [0.0, -1.0], prefix=False)
    # b occurs in a piece but is none; the others occur in none.
    assert tokens.count_tokens(merges, pa.array(["ab", "b", "é", "梦", "😀", "aab"])).tolist() == [1, 1, 2, 3, 4, 2]


def test_awkward_rows(spark, awkward, library):
    found = tokens.token_counts(awkward, PATH)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = awkward.select("doc_id", "text").collect()
    expected = [(r["doc_id"], len((r["text"] or "").encode()), n, n > 4096) for r, n in zip(rows, _expected(library, [r["text"] for r in rows]))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(expected, key=order)
    assert any(e[3] for e in expected)


def test_empty_table(documents):
    assert tokens.token_counts(documents([]), PATH).collect() == []


def test_limit(documents):
    found = tokens.token_counts(documents([(1, "a b c"), (2, "a b c d")]), PATH, limit=3)
    assert [r["over_limit"] for r in found.orderBy("doc_id").collect()] == [False, True]


def test_documents_agree_with_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, PATH).collect()}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert found == dict(zip((r["doc_id"] for r in rows), _expected(library, [r["text"] for r in rows])))
    assert np.sum(list(found.values())) > 0
