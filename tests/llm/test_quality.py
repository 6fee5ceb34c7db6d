import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rowlens.llm import quality


def labelled(spark, documents):
    rng = np.random.default_rng(6)
    good = [" ".join(f"w{i}" for i in rng.integers(0, 2000, 80)) for _ in range(300)]
    bad = [" ".join([f"w{i}!!" for i in rng.integers(0, 2000, 10)] * 8) for _ in range(100)]
    rows = list(enumerate([*good, *bad]))
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    return documents(rows), labels


def test_linear_time_form_equals_all_pairs():
    rng = np.random.default_rng(0)
    x, w, v = rng.normal(size=(5, 7)), rng.normal(size=7), rng.normal(size=(7, 3))
    pairs = np.array([sum((v[i] @ v[j]) * r[i] * r[j] for i in range(7) for j in range(i + 1, 7)) for r in x])
    assert np.allclose(quality.machine(x, 0.5, w, v)[0], 0.5 + x @ w + pairs)


def test_held_out_accuracy_and_no_leak(spark, documents):
    docs, labels = labelled(spark, documents)
    model = quality.fit(docs, labels)
    scored = docs.select("doc_id", quality.held_out().alias("held_out"), quality.score(model).alias("score"))
    held = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50 and np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in held]) > 0.95
    # Labels of held-out rows change nothing, nor do language, source and key.
    other = quality.fit(docs, labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert other.bias == model.bias and (other.weights == model.weights).all()
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert moved.select(quality.score(model)).collect() == docs.select(quality.score(model)).collect()


def test_awkward_rows(spark, documents, awkward):
    docs, labels = labelled(spark, documents)
    model = quality.fit(docs, labels)
    assert all(0 <= r[0] <= 1 for r in awkward.select(quality.score(model)).collect())
    kept = quality.keep_good(awkward, model)
    assert kept.columns == awkward.columns and kept.count() <= 10
    assert quality.keep_good(documents([]), model).count() == 0


def test_no_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(documents([(1, "a"), (2, None)]), none)
    assert [r[0] for r in documents([(1, "a"), (2, None)]).select(quality.score(model)).collect()] == [0.5, 0.5]


def test_features_of_a_slice_do_not_depend_on_its_neighbours():
    texts = ["One two\ntwo two", None, "", "DREI!! vier 5\nDREI!! vier 5"]
    whole = [(w, s) for _, w, s in quality.features(pa.array(texts), [])]
    alone = [next(quality.features(pa.array([t], pa.string()), [])) for t in texts]
    assert np.allclose(whole[0][0], np.concatenate([w for _, w, _ in alone]))
    assert np.allclose(whole[0][1], np.concatenate([s for _, _, s in alone]))
