import pytest
from pyspark.sql import functions as F

from rowlens.llm import hilbert


@pytest.mark.parametrize("dims, bits", [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_and_steps_to_a_neighbour(spark, dims, bits):
    cells = [F.expr(f"int(shiftright(id, {bits * d}) % {1 << bits})") for d in range(dims)]
    rows = spark.range(1 << (dims * bits)).select(hilbert.curve_index(cells, bits).alias("h"), *[c.alias(f"c{i}") for i, c in enumerate(cells)]).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(1 << (dims * bits)))
    assert all(sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1 for a, b in zip(rows, rows[1:]))


def check(rows, shards):
    counts = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for s in range(shards):
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in rows)


@pytest.mark.parametrize("n", [0, 1, 7, 103])
def test_equal_cuts_along_the_curve(documents, n):
    rows = hilbert.shard(documents([(i, "x" * (i % 9), f"src{i % 5}") for i in range(n)]), shards=8).collect()
    check(rows, 8)


def test_one_cell_for_all_rows(documents):
    check(hilbert.shard(documents([(1, "same")] * 50), shards=8).collect(), 8)


def test_bins_hold_about_equal_numbers_of_rows(spark):
    df = spark.range(1000).select(F.expr("id * id").alias("x"), F.expr("concat('k', lpad(string(id), 4, '0'))").alias("s"))
    binned = df.select(*[b.alias(str(i)) for i, b in enumerate(hilbert.bins(df, ["x", "s"], 3))]).collect()
    for i in (0, 1):
        counts = [sum(r[i] == b for r in binned) for b in range(8)]
        assert sum(counts) == 1000 and max(counts) <= 160
    assert [r[0] for r in binned] == sorted(r[0] for r in binned) and [r[1] for r in binned] == sorted(r[1] for r in binned)


@pytest.mark.parametrize("values", [["wikipedia-de", "wikipedia-en", "wikipedia-fr"], ["cc-main-2023", "cc-main-2024"], ["books", *(f"src{i}" for i in range(20))]])
def test_text_is_told_apart_by_whole_values(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None] for _ in range(5)], "s string")
    found = {(r["s"], r["bin"]) for r in df.select("s", hilbert.bins(df, ["s"])[0].alias("bin")).collect()}
    bin_of = dict(found)
    assert len(found) == len(bin_of) == len(set(bin_of.values())) and bin_of.pop(None) == 0
    assert sorted(bin_of, key=bin_of.get) == sorted(values)


@pytest.mark.parametrize(
    "expr",
    [
        "IF(id = 0, timestamp'9999-12-31', timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id))",
        "IF(id = 0, date'9999-12-31', date_add(date'2024-01-01', int(id)))",
        "IF(id = 0, double('inf'), IF(id = 1, -1e300, id / 1e9))",
        "IF(id = 0, 9223372036854775807, 9007199254740993 + id)",
        "CAST(IF(id = 0, 1e30, id) AS DECIMAL(38, 2))",
    ],
)
def test_far_values_take_no_bins_from_the_others(spark, expr):
    df = spark.range(640).select(F.expr(expr).alias("x"))
    binned = df.select("x", hilbert.bins(df, ["x"])[0].alias("b")).orderBy("x").collect()
    assert [r["b"] for r in binned] == [i // 10 for i in range(640)]


def test_missing_numbers_are_the_least(spark):
    df = spark.range(64).selectExpr("CASE WHEN id < 16 THEN NULL WHEN id < 32 THEN double('nan') ELSE double(id) END AS x")
    binned = [r["b"] for r in df.select(hilbert.bins(df, ["x"])[0].alias("b")).collect()]
    assert sorted(binned) == [0] * 32 + list(range(32, 64))


def plain_point(index, dims, bits):
    """The cell at a place of the curve, by transposing the place's Gray code and undoing the excess turns."""
    x = [0] * dims
    for i in range(bits * dims):
        if index >> (bits * dims - 1 - i) & 1:
            x[i % dims] |= 1 << (bits - 1 - i // dims)
    t = x[-1] >> 1
    for i in range(dims - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= t
    q = 2
    while q < 1 << bits:
        for i in range(dims - 1, -1, -1):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q <<= 1
    return tuple(x)


def test_two_dimensions_are_the_plain_curve(spark):
    """In two dimensions there is one Hilbert curve but for mirrors: cells of one block of a quarter are visited together, in its shape."""
    bits = 4
    cells = [F.expr("int(id % 16)"), F.expr("int(id DIV 16)")]
    rows = spark.range(256).select(hilbert.curve_index(cells, bits).alias("h"), *[c.alias(str(i)) for i, c in enumerate(cells)]).collect()
    ours = {(r[1], r[2]): r["h"] for r in rows}
    plain = {plain_point(h, 2, bits): h for h in range(256)}
    mirrors = [lambda a, b: (a, b), lambda a, b: (b, a), lambda a, b: (15 - a, b), lambda a, b: (a, 15 - b), lambda a, b: (15 - a, 15 - b), lambda a, b: (15 - b, a), lambda a, b: (b, 15 - a), lambda a, b: (15 - b, 15 - a)]
    assert any(all(ours[m(*c)] == h for c, h in plain.items()) for m in mirrors)


def test_shards_against_plain_bins_and_cuts(spark, documents):
    """Bins from sorted columns, the operator's curve over them, and runs of the rows in order of (index, key)."""
    rows = [(i, "x" * (i * 37 % 101), f"src{i * i % 7}") for i in range(200)]
    df = documents(rows).withColumn("n_chars", F.length("text")).withColumn("lang", F.expr("IF(doc_id % 3 = 0, NULL, string(doc_id % 2))"))
    found = {r["doc_id"]: r for r in hilbert.shard(df, shards=7).collect()}
    plain = []
    for name in hilbert.DIMENSIONS:
        values = [(r["doc_id"], r[name]) for r in df.collect()]
        order = sorted((v for _, v in values), key=lambda v: (v is not None, v if v is not None else 0))
        first = {}
        for i, v in enumerate(order):
            first.setdefault(v, i * 64 // len(order))
        plain.append({k: 0 if v is None else first[v] for k, v in values})
    cells = spark.createDataFrame([(k, *(p[k] for p in plain)) for k in plain[0]], "k long, a int, b int, c int")
    index = {r["k"]: r["h"] for r in cells.select("k", hilbert.curve_index([F.col(c) for c in "abc"]).alias("h")).collect()}
    for at, k in enumerate(sorted(index, key=lambda k: (index[k], k))):
        shard = at * 7 // len(rows)
        assert (found[k]["curve"], found[k]["shard"], found[k]["slot"]) == (index[k], shard, at - -(-shard * len(rows) // 7))


def test_awkward_rows(awkward):
    sharded = hilbert.shard(awkward, shards=4)
    assert len(sharded.columns) == len(set(sharded.columns))
    check(sharded.collect(), 4)
