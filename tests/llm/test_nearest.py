import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlens.llm import nearest


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}")


def plain(ids, x, query, k):
    score = x @ x[ids.index(query)]
    order = sorted((-s, i) for s, i in zip(score, ids) if i != query)[:k]
    return [i for _, i in order]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 32)).astype("float32")
    x *= rng.uniform(0.5, 1.5, (900, 1)).astype("float32")
    found = nearest.nearest(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("id") % 20 == 0).collect()
    wide, hits = x.astype(float), 0
    for q in range(0, 900, 20):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        assert np.allclose([r["score"] for r in own], wide[[r["vec_id"] for r in own]] @ wide[q], rtol=0, atol=1e-12)
        hits += len({r["vec_id"] for r in own} & set(plain(list(range(900)), wide, q, 20)))
    assert hits / (45 * 20) >= 0.9


@pytest.mark.parametrize("sigma, longer", [(0.5, 1), (1, 1), (0, 10)])
def test_recall_of_unequal_lengths(spark, sigma, longer):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x *= np.exp(rng.normal(0, sigma, (4000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    x[77] *= longer
    rows = table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "array<double>")
    found = nearest.nearest(rows, F.col("id") % 20 == 0).collect()
    own = {q: {r["vec_id"] for r in found if r["query_id"] == q} for q in range(0, 4000, 20)}
    recalls = [len(own[q] & set(plain(range(4000), x, q, 20))) / 20 for q in own]
    assert np.mean(recalls) >= 0.9 and min(recalls) >= 0.5


def test_crowded_bands_are_few_rows():
    bands = [(i, 1000 * 2**i, 1.25**-i) for i in range(20)]
    whole = nearest.crowded(bands, 64, 20)
    assert 0 in whole and sum(n for b, n, _ in bands if b in whole) <= 20 / nearest.SHARE
    assert nearest.crowded([(0, 100_000, 1.0)], 64, 20) == set() and nearest.crowded([(0, 15, 1.0)], 64, 20) == {0}


def test_few_rows_ties_and_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (20, [-1.0, 0.0])]
    rows += [(40, [0.0, 0.0]), (60, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    found = nearest.nearest(table(spark, rows, "array<double>"), F.col("id") % 20 == 0).collect()
    by_query = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20, 40, 60)}
    assert by_query == {0: [2, 3, 1, 20], 20: [1, 0, 2, 3], 40: [], 60: []}


def test_many_copies_of_one_vector(spark):
    rows = [(i, [0.6, 0.8]) for i in range(3000)] + [(i, [1.0, 0.0]) for i in range(3000, 3050)]
    found = nearest.nearest(table(spark, rows), F.col("id") == 3000).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == list(range(3001, 3021))


def test_empty(spark):
    assert nearest.nearest(table(spark, []), F.col("id") % 20 == 0).count() == 0
