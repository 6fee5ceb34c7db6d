import pytest
from pyspark.sql import functions as F

from rowlens.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32")) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(repeats * sizes[n] for n in full)
        free = [n for n in names if n not in full]
        rate = rest / sum(weight[n] for n in free) if free else 0
        above = {n for n in free if rate * weight[n] > repeats * sizes[n]}
        if not above:
            return {n: repeats * sizes[n] if n in full else rate * weight[n] for n in names}
        full |= above


def corpus(documents, sizes):
    rows, i = [], 0
    for source, lengths in sizes.items():
        for n in lengths:
            rows.append((i, " ".join(["w"] * n), source))
            i += 1
    return documents(rows)


def test_targets_and_takes(documents):
    sizes = {"a": [7] * 100, "b": [1, 2, 3], "c": [11] * 40, None: [5] * 30, "é": [0, 4], "zero": [0]}
    mixed = mixing.mix(corpus(documents, sizes), narrow=True).collect()
    expected = plain_targets({s: sum(n) for s, n in sizes.items()})
    taken = {}
    for r in mixed:
        assert r["target"] == pytest.approx(expected[r["source"]]) and r["source_size"] == sum(sizes[r["source"]])
        assert len(r["takes"]) <= 3 and [t["round"] for t in r["takes"]] == list(range(1, len(r["takes"]) + 1))
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * len(r["takes"])
    for source, words in taken.items():
        assert abs(words - expected[source]) <= max(sizes[source]), source


def test_sources_that_fill_up_alike(documents):
    """Sizes over weights are equal, so the order among the sources decides nothing."""
    sizes = {name: [5 * (1 + i % 3)] for i, name in enumerate("abcdefghi")}
    expected = plain_targets({s: sum(n) for s, n in sizes.items()})
    for r in mixing.mix(corpus(documents, sizes), narrow=True).collect():
        assert r["target"] == pytest.approx(expected[r["source"]])


def test_blocks_do_not_change_what_is_taken(documents):
    docs = corpus(documents, {"a": range(1, 200), "b": range(1, 50), "c": [3] * 77})
    few, many = (mixing.mix(docs, narrow=True, blocks=b).select("doc_id", F.size("takes")).collect() for b in (3, 4096))
    assert sorted(few) == sorted(many)


def test_shards_hold_equal_numbers_of_blocks_and_every_unit_once(spark):
    quotas = spark.createDataFrame([(s, u) for s, n in (("a", 50), ("b", 9), (None, 5)) for u in range(1, n + 1)], "source string, unit int")
    dealt = mixing.split(quotas, 8).collect()
    assert sorted((str(r["source"]), r["unit"]) for r in dealt) == sorted((str(r["source"]), r["unit"]) for r in quotas.collect())
    counts = [sum(r["shard"] == s for r in dealt) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 64
    shards = [[r["shard"] for r in sorted(dealt, key=lambda r: r["unit"]) if r["source"] == "a"]]
    # A source's units go to the shards in runs: the counts are drawn, the permuted units follow in order.
    assert all(x == sorted(x) for x in shards)


def test_expanded_mix_repeats_rows_and_reruns_agree(documents):
    docs = corpus(documents, {"a": [5] * 40, "b": [5] * 4})
    mixed = mixing.mix(docs)
    rows = mixing.expand(mixed, docs.columns)
    assert rows.columns == docs.columns and rows.count() == mixed.agg(F.sum(F.size("takes"))).first()[0]
    again = mixing.expand(mixing.mix(docs), docs.columns)
    assert rows.groupBy("doc_id").count().exceptAll(again.groupBy("doc_id").count()).count() == 0


def test_awkward_rows(awkward, documents):
    mixed = mixing.mix(awkward).collect()
    assert len(mixed) == 10 and {r["size"] for r in mixed if r["text"] is None} == {0}
    assert mixing.mix(documents([])).count() == 0


def test_takes_lie_in_the_shards_of_the_tree(documents):
    docs = corpus(documents, {"a": [5] * 300, "b": [5] * 20, None: [2] * 9})
    mixed = mixing.mix(docs, blocks=32)
    rows = docs.select("source", mixing.size_in_words().alias("size"), mixing.place().alias("place"))
    aims, takes = mixing.plan(rows, blocks=32)
    blocks = {(r["source"], r["block"]): {t["round"]: t["shard"] for t in r["takes"]} for r in takes.collect()}
    of_source = {r["source"]: r["blocks"] for r in aims.collect()}
    units = sorted(t for own in blocks.values() for t in own.values())
    counts = [units.count(s) for s in range(mixing.SHARDS)]
    assert max(counts) - min(counts) <= 1
    for r in mixed.collect():
        own = blocks.get((r["source"], ((r["__place"] >> 28) * of_source[r["source"]]) >> 32), {})
        assert all(own[t["round"]] == t["shard"] for t in r["takes"])


def test_many_sources_have_trees_of_their_own(spark):
    n = 100_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    mixed = mixing.mix(docs, narrow=True)
    found = mixed.agg(F.count("*"), F.sum("source_size"), F.sum("target"), F.min(F.size("takes")), F.max(F.size("takes"))).first()
    assert found[:2] == (n, 3 * n) and found[2] == pytest.approx(3 * n) and found[3] >= 0 and found[4] <= 3
    shards = [r["n"] for r in mixed.select(F.explode("takes").alias("t")).groupBy("t.shard").agg(F.count("*").alias("n")).collect()]
    # Each of the 25 trees deals its units to 16 shards, at most one apart.
    groups = -(-n // mixing.BLOCKS)
    quotas = docs.select("source", F.lit(1).alias("unit"))
    dealt = [r["n"] for r in mixing.split(quotas, 16, groups=groups).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sum(dealt) == n and max(dealt) - min(dealt) <= groups and len(shards) == 16
