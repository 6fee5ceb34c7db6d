import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlens.llm import negatives
from rowlens.llm.queries import ORACLES

SCHEMA = "vec_id long, embedding array<double>, label int, id long, number int, chunk int, copies int, score string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _mined(spark, rows):
    table = spark.createDataFrame([(*r, 0, 0, 0, 0, "x") for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(table, label, F.col("vec_id") % 100 == 0)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()))


def _expected(rows):
    """All pairs in loops, with whole numbers of any size."""
    held = []
    for n, (name, x, label) in enumerate(rows):
        if name is None or x is None or label is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        scaled = [int(np.floor(256.0 * v)) if abs(256.0 * v) < 1e300 else None for v in x]
        if any(v is None or not -(2**63) <= v < 2**63 for v in scaled):
            continue
        held.append((n, name, scaled, (label + 1) % 10 if name % 7 == 0 else label))
    out = []
    for n, name, x, label in held:
        if name % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), other, k) for m, other, y, k in held if m != n and len(y) == len(x)]
        for top, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted(s for s in scored if s[2] != label and -80 * top <= -100 * s[0] <= -100 * top)[:5]
            out += [(name, positive, rank, s[1], -top, -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("leaf", [1, 2, 5, 32])
@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (16, 16, 16), (33, 64, 70), (40, 0, 40)])
def test_strassen_is_exact(shape, leaf):
    draw = np.random.default_rng(1)
    a = draw.integers(-(2**62), 2**62, shape[:2])
    b = draw.integers(-(2**62), 2**62, shape[1:])
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_strassen_with_sums_beyond_64_bits():
    """The sums between leave 64 bits; the products do not."""
    a = np.array([[2**62, 0, 0, 1], [2**62, 0, 0, 1], [0, 2**62, 1, 0], [0, 2**62, 1, 0]], np.int64)
    b = np.array([[1, 0, 1, 0]] * 4, np.int64)
    assert (negatives.strassen(a, b, 1) == np.array([[int(x) for x in r] for r in a], object) @ b.astype(object)).all()


def test_random_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i), draw.normal(size=6).tolist(), int(draw.integers(0, 3))) for i in range(401)]
    found = _mined(spark, rows)
    assert found == _expected(rows) and len(found) > 20


def test_groups_and_tiles_do_not_matter(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(int(i) * 10, draw.integers(-2, 3, 4).tolist(), int(draw.integers(0, 2))) for i in range(300)]
    rows = [(i, [float(v) for v in x], k) for i, x, k in rows]
    whole = _expected(rows)
    for name, value in (("ANCHORS", 7), ("CANDIDATES", 11), ("TILE", 3)):
        monkeypatch.setattr(negatives, name, value)
    assert _mined(spark, rows) == whole


def test_ties_and_repeated_rows(spark):
    same = [0.5, 0.5]
    rows = [(100, same, 1), (100, same, 1), *((i, same, 1) for i in range(1, 5)), *((i, same, 2) for i in range(11, 14)), (12, same, 2), (12, same, 2)]
    found = _mined(spark, rows)
    assert found == _expected(rows)
    # Both rows of the anchor have the other as a positive, and a negative that occurs three times fills three ranks.
    assert [r[:4] for r in found if r[1] == 100] == [(100, 100, k, n) for k, n in enumerate([11, 12, 12, 12, 13], 1) for _ in range(2)]


def test_ids_with_several_vectors(spark):
    rows = [(200, [1.0, 0.0], 1), (200, [0.9, 0.1], 1), (200, [0.9, 0.1], 2), (3, [1.0, 0.0], 2), (3, [0.95, 0.0], 2), (3, [0.95, 0.0], 1)]
    assert _mined(spark, rows) == _expected(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.5], 0), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (300, [], 1), (303, [], 1), (302, [], 2), (400, [0.5], 2), (401, [0.5], 2), (402, [0.5], 3)]
    bad = [(None, [1.0, 0.5], 2), (5, None, 2), (6, [1.0, 0.5], None), (8, [nan, 1.0], 2), (9, [inf, 1.0], 2), (10, [None, 1.0], 2), (11, [1e300, 1.0], 2), (12, [1e17, 1.0], 2)]
    found = _mined(spark, good + bad + [(None, None, None)])
    assert found == _mined(spark, good) == _expected(good)
    assert {r[0] for r in found} == {0, 300, 400}


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.9, 0.0], 2), (3, [-1.0, 0.0], 2), (100, [0.0, 1.0], 3), (101, [1.0, 0.0], 3), (102, [1.0, 0.0], 4)]
    assert _mined(spark, rows) == _expected(rows)


def test_windows_end_exactly():
    tops = np.array([0, 1, 4, 5, 6, 10, 99, 100, 101, -1, -5, 2**62, -(2**62)])
    for top, low in zip(tops.tolist(), negatives._lowest(tops).tolist()):
        assert 100 * low >= 80 * top > 100 * (low - 1)


def test_empty_table_and_no_anchor(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(1, [1.0], 1), (2, [1.0], 1), (3, [1.0], 2)]) == []


def test_sql_agrees_with_loops():
    draw = np.random.default_rng(4)
    rows = [(int(i), draw.normal(size=4).tolist(), int(draw.integers(0, 3))) for i in range(301)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(ORACLES["op11_strassen"]).fetchall()) == _expected(rows)
