"""The queries of this package, and the SQL they must agree with where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.llm import chunks, hilbert, lexical, lines, mixing, nearest, negatives, ngrams, quality, simhash, surrogates, tokens, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), F.col("component").alias("component_id"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out().alias("held_out"), quality.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), narrow=True)
    taken = F.col("size") * F.size("takes")
    shards = F.array_join(F.transform("takes", lambda t: t["shard"].cast("string")), ",")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 16).cast("long").alias("size")
    sharded = hilbert.shard(docs, columns=["doc_id", size, F.crc32(text.cast("binary")).alias("text_crc32")])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Anybody can read this key: it serves for test tables.
    return surrogates.replace(_table(spark, sf_dir, "documents"), "rowlens")


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.repeats(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("first_key", "first_doc_id")


def op8_bloom_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngrams.score(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", ngrams.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(_table(spark, sf_dir, "pages"))


def op11_strassen(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op12_rank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The folder of public vocabularies is an installed package.
    import public_tokenizers

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_all(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_cross_polytope": op3_cross_polytope,
    "op4_mixing": op4_mixing,
    "op5_hilbert": op5_hilbert,
    "op6_surrogates": op6_surrogates,
    "op7_chunks": op7_chunks,
    "op8_bloom_ngrams": op8_bloom_ngrams,
    "op9_winnowing": op9_winnowing,
    "op10_boilerplate": op10_boilerplate,
    "op11_strassen": op11_strassen,
    "op12_rank_merge": op12_rank_merge,
    "op13_maxscore": op13_maxscore,
}

# Lower-cased words, and windows of ten of them; an item of fewer words is one window.
_OP9 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT n FROM bw),
     dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
     hit AS (SELECT r, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
     pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
     items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
               FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN items USING (r)
"""


def _levels(shards: int) -> str:
    """The tree's tables: t<level> tells which units go to the left, n<level> the node of every unit."""
    tables = []
    for level in range(shards.bit_length() - 1):
        tables.append(f"""
     t{level} AS (SELECT source, unit, tree, node, row_number() OVER (PARTITION BY tree, node ORDER BY md5(concat_ws('|', 'mix', {level}, node, coalesce(source, chr(0)), unit))) * 2
                     <= count(*) OVER (PARTITION BY tree, node) AS lefts FROM n{level}),
     n{level + 1} AS (SELECT source, unit, tree, 2 * node + (row_number() OVER (PARTITION BY tree, node, source ORDER BY unit)
                     > sum(lefts::INT) OVER (PARTITION BY tree, node, source))::INT AS node FROM t{level}),""")
    return "".join(tables)


# Targets by filling the sources in order of size over weight; then whole rounds, and of the last the places of the
# permutation whose middle lies within what is left. A block of each round is a unit, and the tree deals units to shards.
_OP4 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS place
           FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
     w AS (SELECT source, source_size, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
     f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS rate,
                  row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS turn
           FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     r AS (SELECT coalesce(arg_min(rate, turn) FILTER (cap >= rate * weight), 0) AS rate FROM f),
     t AS (SELECT source, source_size, least(cap::DOUBLE, r.rate * weight) AS target FROM f, r),
     p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS rounds,
                  greatest(ceil(source_size * {mixing.BLOCKS} / greatest((sum(source_size) OVER ())::BIGINT, 1))::BIGINT, 1) AS blocks,
                  ('0x' || substr(md5(coalesce(source, chr(0))), 1, 8))::BIGINT % greatest(1, ceil(count(*) OVER () / {mixing.BLOCKS})::BIGINT) AS tree
           FROM t),
     e AS (SELECT d.*, source_size, target, rounds, tree, target - rounds * source_size AS rest, ((place >> 28) * blocks) >> 32 AS block
           FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
     g AS (SELECT source, place, words, sum(words) OVER (PARTITION BY source ORDER BY place) - words AS before
           FROM (SELECT source, place, sum(size) AS words FROM d GROUP BY ALL)),
     b AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY block) AS after
           FROM (SELECT source, block, rounds, rest, tree, sum(size) AS words FROM e GROUP BY ALL)),
     u AS (SELECT source, block, tree, round, row_number() OVER (PARTITION BY source ORDER BY round, block) AS unit
           FROM (SELECT *, unnest(range(1, rounds + 2)) AS round FROM b)
           WHERE round <= rounds OR (rounds < 3 AND after - words <= rest AND (words > 0 OR after <= rest))),
     n0 AS (SELECT source, unit, tree, 0 AS node FROM u),{_levels(mixing.SHARDS)}
     k AS (SELECT u.source, block, list(node ORDER BY round) AS shards
           FROM u JOIN n{mixing.SHARDS.bit_length() - 1} AS n ON u.source IS NOT DISTINCT FROM n.source AND u.unit = n.unit GROUP BY u.source, block),
     m AS (SELECT e.*, rounds + CASE WHEN rounds < 3 AND before + words / 2 <= rest THEN 1 ELSE 0 END AS times
           FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source AND e.place = g.place)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (size * times)::BIGINT AS taken,
       coalesce(array_to_string(shards[1:times], ','), '') AS shards
FROM m LEFT JOIN k ON m.source IS NOT DISTINCT FROM k.source AND m.block = k.block
"""

_OP10 = rf"""
WITH s AS (SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(coalesce(url, ''), '{lines.HOST}', 1)), '') AS host,
                  list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '{lines.BREAKS}'),
                              lambda x: trim(regexp_replace(regexp_replace(x, '{lines.TAGS}', '', 'g'), '[ \t\n\f\r]+', ' ', 'g'))), lambda x: x <> '') AS w
           FROM pages),
     t AS (SELECT host, count(*) AS pages FROM s WHERE host IS NOT NULL GROUP BY host),
     n AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(w)) AS line FROM s WHERE host IS NOT NULL) GROUP BY ALL),
     f AS (SELECT host, list(line) AS frequent FROM n JOIN t USING (host) WHERE n >= 2 AND n / pages > 0.3 GROUP BY host),
     k AS (SELECT page_id, s.host AS host, w, list_filter(w, lambda x: NOT coalesce(list_contains(frequent, x), false)) AS kept
           FROM s LEFT JOIN f ON s.host = f.host)
SELECT page_id, host, len(w)::BIGINT AS n_lines, (len(w) - len(kept))::BIGINT AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""

# Scaled vectors, the scores of each anchor with every other row, its first positives, and their windows.
_OP11 = """
WITH r AS (SELECT vec_id::BIGINT AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x, row_number() OVER () AS r
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
     v AS (SELECT id, label, r, list_transform(x, lambda y: y::BIGINT) AS x FROM r WHERE len(list_filter(x, lambda y: y < -9223372036854775808 OR y >= 9223372036854775808)) = 0),
     s AS (SELECT a.id AS a, a.r AS ar, b.id AS b, b.r AS br, a.label = b.label AS same,
                  coalesce(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])), 0)::BIGINT AS score
           FROM v AS a JOIN v AS b ON a.id % 100 = 0 AND a.r <> b.r AND len(a.x) = len(b.x)),
     p AS (SELECT a, ar, b AS p, br AS pr, score AS top FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, b, br) <= 5),
     n AS (SELECT p.a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY p.ar, pr ORDER BY score DESC, s.b, s.br)::INT AS rank,
                  s.b AS negative_id, top AS positive_score, score AS negative_score
           FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * top::HUGEINT <= 100 * score::HUGEINT AND score <= top)
SELECT * FROM n WHERE rank <= 5
"""

# Terms of documents and items; scores over the terms that an item shares with a document.
_OP13 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, row_number() OVER () AS i,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
     a AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
     q AS (SELECT item_id, i, term, count(*) AS n FROM (SELECT item_id, i, unnest(w) AS term FROM b) GROUP BY ALL),
     t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
     f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
           FROM (SELECT term, count(*) AS df FROM t GROUP BY term), a),
     m AS (SELECT doc_id, r, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM d, a WHERE len(w) > 0),
     s AS (SELECT item_id, i, doc_id, r, sum(n * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES = {"op10_boilerplate": _OP10, "op11_strassen": _OP11, "op13_maxscore": _OP13, "op4_mixing": _OP4, "op9_winnowing": _OP9}
