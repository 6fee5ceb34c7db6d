import os
import re
from collections import Counter

import duckdb
import pytest
import xxhash

import corpus_pipeline
from rowlens.llm import quality, queries
from tests.compare import connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    cursor = connect(SF_DIR).execute(queries.ORACLES[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == sorted(df.columns)
    expected = sorted(str([rounded(x) for x in r]) for r in cursor.fetchall())
    assert sorted(str([rounded(r[c]) for c in order]) for r in df.collect()) == expected


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.save(stage(spark, before, SF_DIR), "stage")
        held[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        if name in ("quality classifier", "simhash near-dedup", "benchmark decontamination"):
            assert 0 < docs.count() <= before.count()
            assert docs.exceptAll(before).count() == 0
    assert held["sharding"].count() == held["mixing sources"].count()
    again = corpus_pipeline.run(spark, SF_DIR)
    assert again.select("doc_id", "shard", "slot").exceptAll(docs.select("doc_id", "shard", "slot")).count() == 0


LOWER = {c: c + 32 for c in range(65, 91)}


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def _one_of_each(rows):
    """Ids that stay: the smallest of each group of fingerprints within three bits, closed over links."""
    ids = sorted(r["doc_id"] for r in rows)
    prints = {r["doc_id"]: _fingerprint(r["text"]) for r in rows}
    root = dict(zip(ids, ids))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [i for i in ids if top(i) == i]


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _windows(words, lengths):
    return {tuple(words[i : i + n]) for n in lengths for i in range(len(words) - n + 1)}


def _clean(rows, items):
    """Ids of texts that hold no ten words in a row of an item, nor all words of a shorter one."""
    bad = set()
    for item in items:
        words = _words(item["text"])
        bad |= _windows(words, [min(10, len(words))]) if words else set()
    lengths = {len(w) for w in bad}
    return [r["doc_id"] for r in rows if not _windows(_words(r["text"]), lengths) & bad]


def test_stages_agree_with_plain_versions(spark):
    names = ["quality", "near", "clean", "mixed", "sharded"]
    held = {"documents": spark.read.parquet(f"{SF_DIR}/documents.parquet")}
    docs = held["documents"]
    for name, (_, stage) in zip(names, corpus_pipeline.STAGES):
        docs = held[name] = corpus_pipeline.save(stage(spark, docs, SF_DIR), name)
    rows = {name: df.collect() for name, df in held.items()}
    ids = {name: sorted(r["doc_id"] for r in found) for name, found in rows.items()}

    model = quality.fit(held["documents"], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scored = held["documents"].select("doc_id", quality.score(model).alias("score")).collect()
    assert ids["quality"] == sorted(r["doc_id"] for r in scored if r["score"] >= 0.5)
    assert ids["near"] == _one_of_each(rows["quality"])
    assert ids["clean"] == sorted(_clean(rows["near"], spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()))

    con = duckdb.connect()
    con.register("documents", held["clean"].toArrow())
    cursor = con.execute(queries.ORACLES["op4_mixing"])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    expected = {r[at["doc_id"]]: r[at["taken"]] // r[at["size"]] for r in cursor.fetchall() if r[at["size"]]}
    taken = Counter(ids["mixed"])
    assert {i: taken[i] for i in expected} == expected

    shards = Counter(r["shard"] for r in rows["sharded"])
    assert Counter(ids["sharded"]) == taken and set(shards) <= set(range(40))
    assert max(shards.values()) - min(shards[s] for s in range(40)) <= 1
    for shard in shards:
        slots = sorted(r["slot"] for r in rows["sharded"] if r["shard"] == shard)
        assert slots == list(range(slots[0], slots[0] + len(slots)))


def test_pipeline_of_awkward_and_empty_tables(spark, awkward, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, and no rows at all."""
    for name, docs in (("awkward", awkward.select("doc_id", "text", "lang", "source", "n_chars")), ("empty", awkward.select("doc_id", "text", "lang", "source", "n_chars").where("false"))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (5, 1, 0), (3, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in found} <= {1, 2, 3, 4, 7, None}
