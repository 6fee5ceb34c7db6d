import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, or (doc_id, text, source)."""

    def build(rows, schema=DOCS):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta", "en", "a", 22),
        (1, "alpha beta gamma delta", "en", "a", 22),
        (2, None, None, None, None),
        (None, "no key here at all", "en", "a", 18),
        (None, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, " \t\n ", "en", "b", 4),
        (5, long, "en", "b", len(long)),
        (6, long, "de", "b", len(long)),
        (7, "naïve café Ünïcode", "fr", "c", 18),
    ]
    extra = "key long, size long, shard int, hash long, at int, score double, fp string, target int"
    schema = T.StructType([*T.StructType.fromDDL(DOCS).fields, *T.StructType.fromDDL(extra).fields])
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0.5, "x", 0) for r in rows], schema)
