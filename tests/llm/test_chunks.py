import random

import pyarrow as pa

from rowlens.llm import chunks


def text(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


def test_chunks_cover_the_text_and_survive_insertions():
    rng = random.Random(2)
    a = text(rng, 2000)
    b = a[:3000] + "inserted" + a[3000:]
    pieces = []
    for t in (a, b):
        _, row, start, length, words, _ = next(chunks.chunks(pa.array([t])))
        assert start[0] == 0 and (start[1:] == (start + length)[:-1]).all() and (start + length)[-1] == len(t) and words.sum() == len(t.split())
        pieces.append({t[s : s + n] for s, n in zip(start, length)})
    assert len(pieces[0] - pieces[1]) <= 3


def test_cuts_do_not_depend_on_other_rows():
    rng = random.Random(3)
    rows = [text(rng, 50), None, "", "é" * 40, "ab " * 2000, text(rng, 3)]
    whole = [(int(r), int(s), int(n)) for _, row, start, length, _, _ in chunks.chunks(pa.array(rows)) for r, s, n in zip(row, start, length)]
    alone = [(i, int(s), int(n)) for i, t in enumerate(rows) if t for _, _, start, length, _, _ in chunks.chunks(pa.array([t])) for s, n in zip(start, length)]
    assert whole == alone


def plain_chunks(t):
    """(start, bytes) of every chunk: the gear hash byte by byte, over the last 16 bytes of the text."""
    raw = t.lower().encode() if t.isascii() else t.encode()
    out, begin = [], 0
    for i in range(len(raw)):
        h = sum(int(chunks._GEAR[raw[i - d]]) << d for d in range(min(chunks.WINDOW, i + 1))) & 0xFFFFFFFF
        end = i == len(raw) - 1 or (h >> (chunks.WINDOW - chunks.CUT_BITS - 1)) & ((1 << chunks.CUT_BITS) - 1) == 0
        if end or i + 1 - begin == chunks.LONGEST:
            out.append((begin, raw[begin : i + 1]))
            begin = i + 1
    return out


def plain_repeats(rows, least):
    """(row, first key, start, length, copy), from the chunks in dictionaries."""
    cut = [plain_chunks(t) if t else [] for _, t in rows]
    holders = {}
    for i, pieces in enumerate(cut):
        for _, piece in pieces:
            holders.setdefault(piece, set()).add(i)
    out = []
    for i, pieces in enumerate(cut):
        run = []
        for start, piece in [*pieces, (None, None)]:
            if piece is not None and len(holders[piece]) > 1:
                run.append((start, piece))
                continue
            if run:
                begin, end = run[0][0], run[-1][0] + len(run[-1][1])
                firsts = [min(holders[p]) for _, p in run]
                text = rows[i][1].encode()
                words = sum(1 for k in range(begin, end) if not chr(text[k]).isspace() and (k == 0 or chr(text[k - 1]).isspace()))
                if words >= least:
                    out.append((rows[i][0], rows[min(firsts)][0], begin, end - begin, words, all(f != i for f in firsts)))
            run = []
    return sorted(out)


def test_repeats_against_plain_chunks(documents):
    """Passages shared by some rows, whole copies, runs without a cut, and a row that repeats itself."""
    rng = random.Random(6)
    shared = [text(rng, n) for n in (15, 30, 60, 120)]
    rows = []
    for i in range(60):
        parts = [text(rng, rng.randint(0, 40)) for _ in range(3)]
        parts[1:1] = rng.sample(shared, rng.randint(0, 2))
        rows.append((100 + i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "ab" * 3000), (203, "x " + "ab" * 3000), (204, f"{shared[3]} {shared[3]}"), (205, None), (206, "")]
    for least in (1, chunks.LEAST_WORDS):
        found = sorted(tuple(r) for r in chunks.repeats(documents(rows).coalesce(1), least_words=least).collect())
        assert found == plain_repeats(rows, least)


def test_shared_passages_are_found_and_others_are_not(documents):
    rng = random.Random(4)
    passage = text(rng, 70)
    rows = [(i, text(rng, 100)) for i in range(20)]
    rows += [(50 + i, f"{text(rng, rng.randint(1, 60))} {passage} {text(rng, 40)}") for i in range(10)]
    found = chunks.repeats(documents(rows)).collect()
    assert {r["doc_id"] for r in found} == set(range(50, 60)) and all(r["words"] <= 70 for r in found)
    texts = dict(rows)
    for r in found:
        assert texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]] in passage.encode()
    assert sum(not r["copy"] for r in found) == 1 and len({r["first_key"] for r in found}) == 1
    left = {r["doc_id"]: r["text"] for r in chunks.remove(documents(rows), "doc_id").collect()}
    assert sum(len(t) for t in left.values()) < sum(len(t) for t in texts.values()) - 9 * len(passage) * 0.6


def test_awkward_rows(awkward, documents):
    found = chunks.repeats(awkward).collect()
    assert {r["doc_id"] for r in found} == {5, 6}
    assert chunks.repeats(documents([])).count() == 0


def test_rows_of_one_key_lose_only_their_own_copies(documents):
    rng = random.Random(5)
    passage, alone = text(rng, 70), text(rng, 100)
    rows = [(1, f"{text(rng, 30)} {passage}"), (7, f"{passage} {text(rng, 30)}"), (7, alone), (None, f"{text(rng, 20)} {passage}"), (7, alone)]
    left = [(r["doc_id"], r["text"]) for r in chunks.remove(documents(rows)).collect()]
    # The unrelated text stays whole in its first row and goes from the second.
    assert rows[0] in left and (7, alone) in left and len(left) == 5
    assert sorted(len(t) for k, t in left if k == 7)[0] < 40
    assert all(len(t) < len(passage) for k, t in left if k is None)


def test_remove_of_awkward_rows(awkward, documents):
    left = chunks.remove(awkward).collect()
    before = awkward.select("doc_id", "text").collect()
    assert len(left) == len(before)
    assert {(r["doc_id"], r["text"]) for r in left if r["doc_id"] not in (5, 6)} == {(r["doc_id"], r["text"]) for r in before if r["doc_id"] not in (5, 6)}
    # Two rows of one long text: one keeps it.
    assert sorted(len(r["text"]) for r in left if r["doc_id"] in (5, 6)) == [0, max(len(r["text"] or "") for r in before)]
    assert chunks.remove(documents([])).count() == 0
