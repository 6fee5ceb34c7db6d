"""The SQL each registered query must agree with, on the same tables.

These are written from the definitions and share no code with the operators: quartiles by row
number, moments by their formulas, frequencies by grouping.
"""

from __future__ import annotations

from rowlens.registry.tables import (
    BANDS,
    EMPTYISH,
    GAPS,
    GAPS_CATEGORICAL,
    GAPS_NUMERIC,
    HALF_FULL,
    MIXED_CELL,
    MIXED_FILE,
    SEVERITIES,
    SPIKES,
    TABLES,
    TEXT_CELLS,
    WARNINGS,
    select,
)

PLACES = 4
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

GAPS_SQL = select(GAPS, "events")
KEYED_GAPS_SQL = select([("event_id", "event_id"), *GAPS], "events")
GAP_COLUMNS = [name for name, _ in GAPS]

CUSTOMER_NUMERIC, CUSTOMER_OTHERS = ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]
CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

LINEITEM_DOUBLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_NUMERIC = ["l_linenumber", *LINEITEM_DOUBLES]
LINEITEM_ALL = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]


def half(x: str, places: int = PLACES) -> str:
    """Round half away from zero."""
    scale = f"1e{places}"
    size = f"(floor(abs({x}) * {scale} + 0.5) / {scale})"
    return f"(CASE WHEN ({x}) < 0 AND {size} > 0 THEN -{size} ELSE {size} END)"


def rounded(sql: str, doubles: list[str], others: list[str], places: int = PLACES) -> str:
    columns = [f'"{c}"' for c in others] + [f'{half(quote(c), places)} AS "{c}"' for c in doubles]
    return f"SELECT {', '.join(columns)} FROM ({sql})"


def quote(name: str) -> str:
    return f'"{name}"'


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def with_tables(ctes: dict[str, str], body: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + " " + body


def numbers(source: str, columns: list[str], fill: bool = False) -> dict[str, str]:
    """CTEs src, cells, valid, basic, ranked, quart, moments and num: one row of figures per column."""
    value = "coalesce(CAST({c} AS DOUBLE), 0)" if fill else "CAST({c} AS DOUBLE)"
    cells = [
        f"SELECT '{c}' AS \"column\", {i} AS position, {value.format(c=c)} AS x, {c} IS NULL AS missing FROM src"
        for i, c in enumerate(columns)
    ]
    return {
        "src": source,
        "cells": union(cells),
        "valid": "SELECT * FROM cells WHERE x IS NOT NULL AND isfinite(x)",
        "basic": 'SELECT "column", count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi '
        "FROM valid GROUP BY 1",
        "ranked": 'SELECT v."column", x, n, row_number() OVER (PARTITION BY v."column" ORDER BY x) - 1 AS pos '
        'FROM valid v JOIN basic b ON v."column" = b."column"',
        "quart": 'SELECT "column", max(x) FILTER (WHERE pos = floor(n * 0.25)) AS q25, '
        "max(x) FILTER (WHERE pos = floor(n * 0.75)) AS q75, "
        "(max(x) FILTER (WHERE pos = floor((n - 1) / 2.0)) + max(x) FILTER (WHERE pos = floor(n / 2.0))) / 2 "
        'AS median FROM ranked GROUP BY "column"',
        "moments": 'SELECT v."column", '
        "CASE WHEN max(std) > 0 THEN avg(power((x - mean) / nullif(std, 0), 3)) ELSE 0.0 END AS skewness, "
        "CASE WHEN max(std) > 0 THEN avg(power((x - mean) / nullif(std, 0), 4)) - 3 ELSE 0.0 END AS kurtosis "
        'FROM valid v JOIN basic b ON v."column" = b."column" GROUP BY 1',
        "gone": 'SELECT "column", min(position) AS position, count(*) FILTER (WHERE missing) AS null_count, '
        "count(*) AS rows FROM cells GROUP BY 1",
        "num": 'SELECT g."column", g.position, n, mean, median, std, lo AS min, hi AS max, q25, q75, skewness, '
        'kurtosis, null_count FROM gone g LEFT JOIN basic b ON b."column" = g."column" '
        'LEFT JOIN quart q ON q."column" = g."column" LEFT JOIN moments m ON m."column" = g."column"',
    }


FIGURES = ["mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"]


def numeric_profile(source: str, columns: list[str], fill: bool = False) -> str:
    return with_tables(numbers(source, columns, fill), rounded("SELECT * FROM num", FIGURES, ["column", "null_count"]))


def frequencies(source: str, columns: list[str], prefix: str = "") -> dict[str, str]:
    """CTEs of value counts, per-column totals and ranked values."""
    texts = [
        f"SELECT '{c}' AS \"column\", {i} AS position, nullif(CAST({c} AS VARCHAR), '') AS value FROM {prefix}src"
        for i, c in enumerate(columns)
    ]
    p = prefix
    return {
        f"{p}src": source,
        f"{p}texts": union(texts),
        f"{p}counts": f'SELECT "column", value, count(*) AS c FROM {p}texts GROUP BY 1, 2',
        f"{p}totals": f'SELECT "column", sum(c) AS rows, coalesce(sum(c) FILTER (WHERE value IS NOT NULL), 0) AS n '
        f"FROM {p}counts GROUP BY 1",
        f"{p}cat": f'SELECT k."column", count(value) AS unique_count, '
        "CAST(coalesce(sum(c) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS null_count, "
        "abs(coalesce(-sum((c / n) * log2(c / n)) FILTER (WHERE value IS NOT NULL), 0)) AS entropy "
        f'FROM {p}counts k JOIN {p}totals t ON k."column" = t."column" GROUP BY 1',
        f"{p}top": f'SELECT k."column", CAST(row_number() OVER (PARTITION BY k."column" ORDER BY c DESC, value) '
        "AS INTEGER) AS rank, value, c AS count, " + half("CAST(c AS DOUBLE) / rows * 100", 2) + " AS pct "
        f'FROM {p}counts k JOIN {p}totals t ON k."column" = t."column" WHERE value IS NOT NULL',
    }


def top_values(source: str, columns: list[str]) -> str:
    return with_tables(
        frequencies(source, columns), 'SELECT "column", rank, value, count, pct FROM top WHERE rank <= 20'
    )


def categorical(source: str, columns: list[str], figures: str) -> str:
    shown = {"entropy": half("entropy") + " AS entropy"}
    listed = ", ".join(shown.get(f, quote(f)) for f in figures.split())
    return with_tables(frequencies(source, columns), f"SELECT {listed} FROM cat")


def missing_ctes(columns: list[str]) -> dict[str, str]:
    """CTE miss over src: missing cells per column and their share."""
    rows = [
        f"SELECT '{c}' AS \"column\", {i} AS position, "
        f"count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = '') AS count, count(*) AS rows FROM src"
        for i, c in enumerate(columns)
    ]
    return {
        "allmiss": union(rows),
        "miss": 'SELECT "column", position, count, ' + half("CAST(count AS DOUBLE) / rows * 100", 2) + " AS pct FROM allmiss "
        "WHERE count > 0",
    }


def histogram(source: str, columns: list[str]) -> str:
    ctes = numbers(source, columns)
    keep = {k: ctes[k] for k in ("src", "cells", "valid", "basic")}
    keep["limits"] = 'SELECT "column", n, lo, hi, (hi - lo) / 20 AS width FROM basic'
    keep["binned"] = (
        'SELECT v."column", CASE WHEN width = 0 THEN 0 '
        "ELSE CAST(least(floor((x - lo) / nullif(width, 0)), 19) AS INTEGER) END AS bin, count(*) AS count "
        'FROM valid v JOIN limits l ON v."column" = l."column" GROUP BY 1, 2'
    )
    keep["bins"] = (
        'SELECT l.*, CAST(b.range AS INTEGER) AS bin FROM limits l, range(20) b WHERE width > 0 OR b.range = 0'
    )
    start, stop = "(lo + f.bin * width)", "(lo + (f.bin + 1) * width)"
    body = (
        f'SELECT f."column", f.bin, CASE WHEN width = 0 THEN lo ELSE {half(start)} END AS range_start, '
        f"CASE WHEN width = 0 THEN hi ELSE {half(stop)} END AS range_end, coalesce(count, 0) AS count, "
        "CASE WHEN width = 0 THEN regexp_replace(CAST(lo AS VARCHAR), '\\.0$', '') "
        f"ELSE printf('%.2f–%.2f', {half(start, 2)}, {half(stop, 2)}) END AS label "
        'FROM bins f LEFT JOIN binned b ON b."column" = f."column" AND b.bin = f.bin'
    )
    return with_tables(keep, body)


def correlation_ctes(columns: list[str], source: str = "src") -> dict[str, str]:
    """CTE corr: one row per pair i < j, over the rows where both cells are valid."""
    pairs = [
        f"SELECT {i} AS i, {j} AS j, '{a}' AS col1, '{b}' AS col2, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y "
        f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i < j
    ]
    return {
        "paired": union(pairs),
        "corr": "SELECT i, j, col1, col2, coalesce(CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 "
        "THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 0.0) AS r FROM paired GROUP BY 1, 2, 3, 4",
    }


STRENGTH = (
    "CASE WHEN abs(r) >= 0.8 THEN 'Very Strong' WHEN abs(r) >= 0.6 THEN 'Strong' "
    "WHEN abs(r) >= 0.4 THEN 'Moderate' WHEN abs(r) >= 0.2 THEN 'Weak' ELSE 'Negligible' END"
)


def correlation_pairs(source: str, columns: list[str]) -> str:
    return with_tables(
        {"src": source, **correlation_ctes(columns)},
        f"SELECT col1, col2, {half('r')} AS value, {STRENGTH} AS strength FROM corr",
    )


def correlation_report(source: str, columns: list[str]) -> str:
    return with_tables(
        {"src": source, **correlation_ctes(columns)},
        "SELECT col1, col2, value, CASE WHEN abs(value) >= 0.7 THEN 'Strong' WHEN abs(value) >= 0.4 THEN 'Moderate' "
        "ELSE 'Weak' END AS strength, CASE WHEN value > 0 THEN 'Positive' ELSE 'Negative' END AS direction "
        f"FROM (SELECT *, {half('r')} AS value FROM corr) ORDER BY abs(value) DESC, col1, col2",
    )


def correlation_matrix(source: str, columns: list[str]) -> str:
    same = [
        f"SELECT '{c}' AS row_col, '{c}' AS col_col, CASE WHEN min({c}) < max({c}) THEN 1.0::DOUBLE "
        f"ELSE 0.0::DOUBLE END AS value FROM src"
        for c in columns
    ]
    body = union(
        [
            f"SELECT col1 AS row_col, col2 AS col_col, {half('r')} AS value FROM corr",
            f"SELECT col2, col1, {half('r')} FROM corr",
            *same,
        ]
    )
    return with_tables({"src": source, **correlation_ctes(columns)}, body)


def outlier_ctes() -> dict[str, str]:
    """CTE outl: the fences of num and the values beyond them."""
    return {
        "fenced": 'SELECT "column", position, q25 - 1.5 * (q75 - q25) AS lower, q75 + 1.5 * (q75 - q25) AS upper FROM num',
        "outl": 'SELECT f."column", f.position, lower, upper, count(*) FILTER (WHERE x < lower OR x > upper) AS count, '
        'count(*) AS n FROM fenced f JOIN valid v ON v."column" = f."column" GROUP BY ALL',
        "outliers": "SELECT \"column\", position, 'IQR' AS method, count, "
        + half("CAST(count AS DOUBLE) / n * 100", 2)
        + " AS pct, "
        + half("lower")
        + " AS lower_bound, "
        + half("upper")
        + " AS upper_bound FROM outl",
    }


OUTLIER_COLUMNS = '"column", method, count, pct, lower_bound, upper_bound'
OUTLIER_SEVERITY = (
    f"SELECT {OUTLIER_COLUMNS}, CASE WHEN pct > 10 THEN 'High' WHEN pct > 3 THEN 'Moderate' ELSE 'Low' END "
    "AS severity FROM outliers"
)


def outliers(tail: str, source: str = GAPS_SQL, columns: list[str] = GAPS_NUMERIC) -> str:
    return with_tables({**numbers(source, columns), **outlier_ctes()}, tail)


def outlier_total() -> str:
    fences = {
        f"f{i}": f"SELECT lower, upper FROM fenced WHERE \"column\" = '{c}'" for i, c in enumerate(GAPS_NUMERIC)
    }
    flags = [
        f"coalesce({c} < (SELECT lower FROM f{i}) OR {c} > (SELECT upper FROM f{i}), false)"
        for i, c in enumerate(GAPS_NUMERIC)
    ]
    total = " + ".join(f"CAST({flag} AS INTEGER)" for flag in flags)
    body = (
        f"SELECT CAST(sum({total}) AS BIGINT) AS total_outlier_values, "
        f"count(*) FILTER (WHERE {' OR '.join(flags)}) AS total_outlier_rows FROM src"
    )
    return with_tables({**numbers(GAPS_SQL, GAPS_NUMERIC), **outlier_ctes(), **fences}, body)


def duplicates(columns: str, source: str) -> str:
    return (
        f"SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows, CAST(sum(c) AS BIGINT) AS rows "
        f"FROM (SELECT {columns}, count(*) AS c FROM ({source}) GROUP BY {columns})"
    )


def json_text(c: str) -> str:
    """Length of a text cell as JSON."""
    short = "length(translate(" + c + ", chr(34) || chr(92) || chr(8) || chr(9) || chr(10) || chr(12) || chr(13), ''))"
    controls = f"length(regexp_replace({c}, '[^\\x00-\\x07\\x0B\\x0E-\\x1F]', '', 'g'))"
    wide = f"length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
    return f"coalesce(2 + 2 * length({c}) - {short} + 5 * {controls} + {wide}, 4)"


def json_int(c: str) -> str:
    return f"coalesce(length(CAST({c} AS VARCHAR)), 4)"


def json_double(c: str) -> str:
    return f"coalesce(length(regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')), 4)"


def memory(table: str, lengths: dict[str, str]) -> str:
    names = sum(len(c) + 3 for c in lengths) + len(lengths) + 1
    row = " + ".join([str(names), *lengths.values()])
    return (
        "SELECT json_chars, floor(json_chars * 200.0::DOUBLE / 1048576 + 0.5) / 100 AS memory_mb FROM "
        f"(SELECT CAST(sum({row} + 1) + 1 AS BIGINT) AS json_chars FROM {table})"
    )


def systematic_sample(columns: str, table: str, order: str) -> str:
    return (
        f"WITH numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS total "
        f"FROM {table}), size AS (SELECT max(total) AS total FROM numbered), "
        "wanted AS (SELECT CAST(floor(i.range * (total / 50000.0::DOUBLE)) AS BIGINT) AS pos "
        "FROM size, range(50000) i WHERE total > 50000) "
        f"SELECT {columns} FROM numbered WHERE total <= 50000 OR pos IN (SELECT pos FROM wanted)"
    )


def column_report(name: str, spread: str, item: str) -> str:
    """A column's distribution, and its first ten values by event_id."""
    text = f"nullif(regexp_replace(CAST({name} AS VARCHAR), '\\.0$', ''), '')"
    firsts = f"SELECT {text} AS item, min(event_id) AS first FROM ({KEYED_GAPS_SQL}) WHERE {text} IS NOT NULL GROUP BY 1"
    return (
        f"SELECT 'distribution' AS part, CAST({item} AS VARCHAR) AS item, CAST(count AS BIGINT) AS count FROM ({spread}) UNION ALL "
        f"SELECT 'sample', item, NULL FROM (SELECT * FROM ({firsts}) ORDER BY first LIMIT 10)"
    )


def infer_types() -> str:
    texts = [name for name, _ in TEXT_CELLS if name not in ("event_id", "active")]
    rows = ["SELECT 0 AS position, 'event_id' AS \"column\", 'numeric' AS semantic_type"]
    for position, (name, _) in enumerate(TEXT_CELLS):
        if name in texts:
            present = f"count(*) FILTER (WHERE {name} <> '')"
            words = f"count(*) FILTER (WHERE {name} IN ('true', 'false'))"
            found = f"count(*) FILTER (WHERE regexp_full_match({name}, '{NUMBER}'))"
            rows.append(
                f"SELECT {position}, '{name}', CASE WHEN {present} = 0 THEN 'categorical' "
                f"WHEN {words} / {present} > 0.9 THEN 'boolean' "
                f"WHEN {found} / {present} > 0.8 THEN 'numeric' ELSE 'categorical' END FROM first"
            )
    rows.append(f"SELECT {len(TEXT_CELLS) - 1}, 'active', 'boolean'")
    return with_tables(
        {"first": select(TEXT_CELLS, "events")}, union(rows)
    )


def dataset_detail() -> str:
    types = ["numeric"] + ["numeric" if c in GAPS_NUMERIC else "categorical" for c in GAP_COLUMNS]
    types[1 + GAP_COLUMNS.index("flag")] = "boolean"
    names = ["event_id", *GAP_COLUMNS]
    rows = [
        f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS semantic_type, "
        f"count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = '') AS null_count FROM src"
        for i, (c, t) in enumerate(zip(names, types))
    ]
    return with_tables({"src": KEYED_GAPS_SQL}, union(rows))


def filtered(condition: str, source: str = KEYED_GAPS_SQL) -> str:
    return f"SELECT * FROM ({source}) WHERE {condition}"


def grouped(figure: str, name: str) -> str:
    return f"SELECT kind, count(*) AS count, {half(figure)} AS {name} FROM ({GAPS_SQL}) GROUP BY kind"


CATALOG_COLUMNS = {
    "region": "r_regionkey,r_name",
    "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": ",".join([*LINEITEM_ALL, "l_returnflag", "l_linestatus", "l_shipdate"]),
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "pages": "page_id,url,html",
    "benchmark": "item_id,text",
    "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text",
}


def catalog() -> str:
    rows = [
        f"SELECT '{t}' AS id, count(*) AS row_count, {len(CATALOG_COLUMNS[t].split(','))} AS column_count, "
        f"'parquet' AS file_type, '{CATALOG_COLUMNS[t]}' AS columns, '2024-01-01 {i:02d}:00:00' AS uploaded_at FROM {t}"
        for i, t in enumerate(TABLES)
    ]
    return union(rows)


def catalog_store(sizes: dict[str, str]) -> str:
    rows = [
        f"SELECT c.id, c.id AS name, c.id || '.parquet' AS original_name, c.row_count, c.column_count, c.file_type, c.columns, "
        f"(SELECT memory_mb FROM ({size})) AS memory_size_mb FROM ({catalog()}) c WHERE c.id = '{t}'"
        for t, size in sizes.items()
    ]
    return union(rows)


def first_values(table: str, name: str, order: str) -> str:
    """The first ten values of a text column in row order."""
    return (
        f"SELECT '{name}' AS \"column\", value FROM (SELECT nullif({name}, '') AS value, row_number() OVER (ORDER BY {order}) AS n FROM {table}) "
        "WHERE value IS NOT NULL GROUP BY value ORDER BY min(n) LIMIT 10"
    )


GAPS_LENGTHS = {
    "kind": json_text("kind"),
    "tag": json_text("tag"),
    "amount": json_double("amount"),
    "mostly_null": json_double("mostly_null"),
    "constant": json_double("constant"),
    "flag": json_int("flag"),
    "near_constant": json_text("near_constant"),
}
GAPS_MEMORY = memory(f"({GAPS_SQL})", GAPS_LENGTHS)

KEYED_GAPS_MEMORY = memory(f"({KEYED_GAPS_SQL})", {"event_id": json_int("event_id"), **GAPS_LENGTHS})

# Quality rules over the derived table


def quality_ctes(source: str = GAPS_SQL, numeric: list[str] = GAPS_NUMERIC, categorical: list[str] = GAPS_CATEGORICAL, columns: list[str] = GAP_COLUMNS) -> dict[str, str]:
    """CTEs of all profile figures of a table, and one row of table-wide facts."""
    position = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(columns))
    return {
        **numbers(source, numeric),
        **{k: v for k, v in frequencies(source, categorical, "c").items()},
        **missing_ctes(columns),
        "dups": duplicates(", ".join(columns), source),
        "facts": f"SELECT rows, {len(columns)} AS cols, duplicate_rows AS dup, "
        "(SELECT coalesce(sum(count), 0) FROM miss) AS nulls FROM dups",
        "n": f'SELECT *, CASE "column" {position} END AS p FROM num WHERE mean IS NOT NULL',
        "c": f'SELECT k.*, t.pct AS top_pct, CASE k."column" {position} END AS p FROM ccat k '
        'LEFT JOIN ctop t ON t."column" = k."column" AND t.rank = 1',
    }


def rule(section: str, code: str, source: str, severity: str = "CAST(NULL AS VARCHAR)", order="p", least=1):
    listed = f"string_agg(\"column\", ',' ORDER BY {order})"
    return (
        f"SELECT '{section}' AS section, '{code}' AS rule, {severity} AS severity, CAST(count(*) AS DOUBLE) AS value, "
        f"{listed} AS affected_columns FROM {source} HAVING count(*) >= {least}"
    )


def fact(section: str, code: str, value: str, when: str = "true", severity: str = "CAST(NULL AS VARCHAR)") -> str:
    return (
        f"SELECT '{section}' AS section, '{code}' AS rule, {severity} AS severity, CAST({value} AS DOUBLE) AS value, "
        f"'' AS affected_columns FROM facts WHERE {when}"
    )


SKEWED = "n WHERE abs(skewness) > 1"
NULL_PCT = "(CAST(nulls AS DOUBLE) / (rows * cols) * 100)"


def rules(parts: list[str], ctes: dict[str, str] | None = None) -> str:
    return with_tables(
        ctes or quality_ctes(),
        rounded(f"SELECT * FROM ({union(parts)})", ["value"], ["section", "rule", "severity", "affected_columns"]),
    )


ISSUES = [
    rule("issue", "high_null_columns", "miss WHERE pct > 10", order="position"),
    fact("issue", "duplicate_rows", "dup", "dup > 0"),
    fact("issue", "duplicate_pct", half("CAST(dup AS DOUBLE) / rows * 100", 1), "dup > 0"),
    rule("issue", "id_like_columns", "c WHERE unique_count > 0.9 * (SELECT rows FROM facts)"),
]
FINDINGS = [
    fact("finding", "rows", "rows"),
    fact("finding", "columns", "cols"),
    fact("finding", "numeric_columns", "(SELECT count(*) FROM n)"),
    fact("finding", "categorical_columns", "(SELECT count(*) FROM c)"),
    rule("finding", "skewed_columns", SKEWED),
    rule("finding", "constant_columns", "n WHERE std = 0"),
    rule("finding", "mostly_null_columns", "miss WHERE pct > 50", order="position"),
    "SELECT * FROM (SELECT 'finding' AS section, 'widest_range' AS rule, CAST(NULL AS VARCHAR) AS severity, "
    'max - min AS value, "column" AS affected_columns FROM n ORDER BY max - min DESC, p LIMIT 1)',
]
INSIGHTS = [
    rule("insight", "skewed_distributions", SKEWED, "'warning'"),
    rule(
        "insight",
        "missing_value_patterns",
        "miss WHERE pct > 10",
        "CASE WHEN max(pct) > 40 THEN 'critical' ELSE 'warning' END",
        order="position",
    ),
    fact(
        "insight",
        "duplicate_rows_detected",
        "dup",
        "dup > rows * 0.01",
        "CASE WHEN dup > rows * 0.05 THEN 'critical' ELSE 'warning' END",
    ),
    rule("insight", "low_variance_columns", "n WHERE std < (max - min) * 0.01 AND max <> min", "'info'"),
    "SELECT section, rule, severity, value * (value - 1) / 2 AS value, affected_columns FROM ("
    + rule("insight", "multivariate_relationships", "n", "'info'", least=2)
    + ")",
]
RECOMMENDATIONS = [
    fact("recommendation", "address_missing_values", "(SELECT count(*) FROM miss)", f"{NULL_PCT} > 5"),
    fact("recommendation", "missing_rate_acceptable", "(SELECT count(*) FROM miss)", f"{NULL_PCT} <= 5"),
    rule("recommendation", "transform_skewed", SKEWED),
    fact("recommendation", "distributions_symmetric", "0", f"NOT EXISTS (SELECT 1 FROM {SKEWED})"),
    fact("recommendation", "remove_duplicates", "dup", "dup > 0"),
    fact("recommendation", "no_duplicates", "0", "dup = 0"),
    fact("recommendation", "check_multicollinearity", "(SELECT count(*) FROM n)", "(SELECT count(*) FROM n) > 1"),
    fact("recommendation", "single_numeric_column", "(SELECT count(*) FROM n)", "(SELECT count(*) FROM n) <= 1"),
    rule("recommendation", "encode_high_cardinality", "c WHERE unique_count > 100"),
    fact(
        "recommendation", "cardinality_manageable", "0", "NOT EXISTS (SELECT 1 FROM c WHERE unique_count > 100)"
    ),
    fact("recommendation", "validate_types", "cols"),
]
TAILS, DOMINANT = "n WHERE abs(kurtosis) > 5", "c WHERE top_pct > 90"
UNUSUAL = [
    rule("unusual", "heavy_tails", TAILS),
    rule("unusual", "near_constant_categories", DOMINANT),
    fact(
        "unusual", "none", "0", f"NOT EXISTS (SELECT 1 FROM {TAILS}) AND NOT EXISTS (SELECT 1 FROM {DOMINANT})"
    ),
]

SCORE = f"greatest(0, least(100, CAST(floor(100 - 2 * {NULL_PCT} - 20.0::DOUBLE * dup / rows + 0.5) AS BIGINT)))"


def quality_score(ctes: dict[str, str] | None = None) -> str:
    return with_tables(
        ctes or quality_ctes(),
        f"SELECT rows, CAST(cols AS BIGINT) AS cols, CAST(nulls AS BIGINT) AS null_count, {half(NULL_PCT)} AS null_pct, "
        f"dup AS duplicate_rows, CAST({SCORE} AS BIGINT) AS score, CASE WHEN {SCORE} >= 80 THEN 'well-suited' "
        f"WHEN {SCORE} >= 60 THEN 'adequately suited' ELSE 'marginally suited' END AS fitness FROM facts",
    )


CUSTOMER_CTES = quality_ctes("SELECT * FROM customer", CUSTOMER_NUMERIC, CUSTOMER_OTHERS, CUSTOMER_COLUMNS)
SPIKES_CTES = quality_ctes(select(SPIKES, "lineitem"), ["quantity", "spike"], ["line", "returned"], [name for name, _ in SPIKES])
HALF_FULL_CTES = quality_ctes(select(HALF_FULL, "events"), ["amount", "event_id"], ["kind"], [name for name, _ in HALF_FULL])
EMPTYISH_CTES = quality_ctes(select(EMPTYISH, "events"), ["amount", "one"], ["kind"], [name for name, _ in EMPTYISH])
WARNINGS_CTES = quality_ctes(select(WARNINGS, "events"), ["amount"], ["label"], [name for name, _ in WARNINGS])
ALL_RULES = ISSUES + FINDINGS + INSIGHTS + RECOMMENDATIONS + UNUSUAL


def report_numeric() -> str:
    shown = [f"{half(f, 3)} AS {quote(f)}" for f in FIGURES]
    return with_tables(
        numbers(GAPS_SQL, GAPS_NUMERIC), f'SELECT "column", {", ".join(shown)}, null_count FROM num'
    )


def report_categorical() -> str:
    return with_tables(
        frequencies(GAPS_SQL, GAPS_CATEGORICAL),
        f'SELECT c."column", unique_count, null_count, {half(half("entropy"), 3)} AS entropy, '
        f"a.value AS top_value, {half('a.pct', 1)} AS top_pct, "
        f"b.value AS second_value, {half('b.pct', 1)} AS second_pct "
        'FROM cat c LEFT JOIN top a ON a."column" = c."column" AND a.rank = 1 '
        'LEFT JOIN top b ON b."column" = c."column" AND b.rank = 2',
    )


def report_overview() -> str:
    figures = {
        "rows": "rows",
        "cols": "cols",
        "numeric_columns": "(SELECT count(*) FROM num)",
        "categorical_columns": "(SELECT count(*) FROM ccat)",
        "duplicate_rows": "dup",
        "missing_columns": "(SELECT count(*) FROM miss)",
        "memory_mb": f"(SELECT memory_mb FROM ({GAPS_MEMORY}))",
    }
    return with_tables(
        quality_ctes(),
        union([f"SELECT '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM facts" for m, v in figures.items()]),
    )


def report_column_directory() -> str:
    return with_tables(
        {**numbers(GAPS_SQL, GAPS_NUMERIC), **frequencies(GAPS_SQL, GAPS_CATEGORICAL, "c")},
        "SELECT \"column\", 'Numeric' AS type, null_count, CAST(NULL AS BIGINT) AS unique_count FROM num "
        "UNION ALL SELECT \"column\", 'Categorical', null_count, unique_count FROM ccat",
    )


def export_bundle() -> str:
    def part(name: str, item: str, source: str, *figures: tuple[str, str]) -> str:
        return union([f"SELECT '{name}' AS part, {item} AS item, '{f}' AS figure, CAST({v} AS DOUBLE) AS value FROM {source}" for f, v in figures])

    def plain(*names: str) -> list[tuple[str, str]]:
        return [(n, quote(n)) for n in names]

    snapshot = union(ISSUES + FINDINGS + INSIGHTS + RECOMMENDATIONS + UNUSUAL)
    bins = histogram(GAPS_SQL, GAPS_NUMERIC)
    listed = union(
        [
            part("meta", "'events/events/parquet/2024-01-01'", "facts", ("row_count", "rows"), ("column_count", "cols")),
            part("overview", "'table'", "facts", ("rows", "rows"), ("cols", "cols"), ("duplicate_rows", "dup"), ("missing_cells", "nulls"), ("memory_mb", f"(SELECT memory_mb FROM ({GAPS_MEMORY}))")),
            part("numeric", '"column"', "num", *plain(*FIGURES, "null_count")),
            part("histogram", "\"column\" || '/' || bin", f"({bins})", *plain("count")),
            part("categorical", '"column"', "ccat", *plain("unique_count", "null_count", "entropy")),
            part("top_values", "\"column\" || '/' || rank || '/' || value", "(SELECT * FROM ctop WHERE rank <= 20)", *plain("count", "pct")),
            part("missing", '"column"', "miss", *plain("count", "pct")),
            part("quality_score", "'table'", "facts", ("score", SCORE), ("null_pct", NULL_PCT)),
            part("snapshot", "section || '/' || rule || '/' || coalesce(severity, '') || '/' || affected_columns", f"({snapshot})", *plain("value")),
            part("correlation", "col1 || '/' || col2", "corr", ("value", "r")),
            part("outliers", '"column"', "outliers", *plain("count", "pct", "lower_bound", "upper_bound")),
        ]
    )
    return with_tables(
        {**quality_ctes(), **outlier_ctes(), **correlation_ctes(GAPS_NUMERIC)},
        rounded(listed, ["value"], ["part", "item", "figure"]),
    )


def metrics(source: str, numeric: list[str], categories: list[str], extra: dict[str, str]) -> str:
    """A profile in long form."""
    table_wide = [f"SELECT CAST(NULL AS VARCHAR) AS \"column\", '{m}' AS metric, CAST({v} AS DOUBLE) AS value" for m, v in extra.items()]
    per_column = [f"SELECT \"column\", '{f}' AS metric, CAST({f} AS DOUBLE) AS value FROM num" for f in [*FIGURES, "null_count"]]
    per_category = [
        f"SELECT \"column\", '{f}' AS metric, CAST({f} AS DOUBLE) AS value FROM ccat"
        for f in ("unique_count", "null_count", "entropy")
    ]
    return with_tables(
        {**numbers(source, numeric), **frequencies(source, categories, "c")},
        rounded(union(table_wide + per_column + per_category), ["value"], ["column", "metric"]),
    )


ORDERS_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDERS_OTHERS = ["o_orderstatus", "o_orderdate", "o_orderpriority"]
LINEITEM_OTHERS = ["l_returnflag", "l_linestatus", "l_shipdate"]
SAMPLE_SQL = systematic_sample(
    ", ".join([*LINEITEM_ALL, *LINEITEM_OTHERS]),
    "lineitem",
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate",
)

ORDERS_MEMORY = memory(
    "orders",
    {
        "o_orderkey": json_int("o_orderkey"),
        "o_custkey": json_int("o_custkey"),
        "o_orderstatus": json_text("o_orderstatus"),
        "o_totalprice": json_double("o_totalprice"),
        "o_orderdate": "26",
        "o_orderpriority": json_text("o_orderpriority"),
    },
)
DOCUMENTS_MEMORY = memory(
    "documents",
    {
        "doc_id": json_int("doc_id"),
        "text": json_text("text"),
        "lang": json_text("lang"),
        "source": json_text("source"),
        "n_chars": json_int("n_chars"),
    },
)
LINEITEM_MEMORY = memory(
    "lineitem",
    {
        **{c: json_int(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")},
        **{c: json_double(c) for c in LINEITEM_DOUBLES},
        **{c: json_text(c) for c in ("l_returnflag", "l_linestatus")},
        "l_shipdate": "26",
    },
)

FULL_QUERY = (
    f"SELECT kind, count(*) AS count, {half('avg(amount)')} AS mean_amount FROM ({KEYED_GAPS_SQL}) "
    "WHERE amount >= 5 AND coalesce(NOT contains(lower(tag), 'sign'), true) AND kind IS DISTINCT FROM 'view' "
    "GROUP BY kind"
)
GAP_ORDER = ", ".join(f"{c} ASC NULLS LAST" for c in ["event_id", *[g for g in GAP_COLUMNS if g != "amount"]])

ORACLES: dict[str, str] = {
    "scan_csv": "SELECT event_id, "
    + ", ".join("nullif(tag, '') AS tag" if c == "tag" else c for c in GAP_COLUMNS)
    + ", props FROM ("
    + select([("event_id", "event_id"), *GAPS, ("props", "props")], "events")
    + ")",
    "scan_csv_mixed": select([(n, "CAST(event_id + 0.5 AS DOUBLE)" if n == "half" else sql) for n, sql in MIXED_FILE], "events"),
    "ingest_roundtrip": KEYED_GAPS_SQL,
    "export_bundle": export_bundle(),
    "report_overview": report_overview(),
    "report_numeric": report_numeric(),
    "report_categorical": report_categorical(),
    "report_missing": with_tables(
        {"src": GAPS_SQL, **missing_ctes(GAP_COLUMNS)}, f'SELECT "column", count, {half("pct", 1)} AS pct FROM miss'
    ),
    "report_column_directory": report_column_directory(),
    "infer_types": infer_types(),
    "coerce_numeric": f"SELECT event_id, cell, CASE WHEN regexp_full_match(cell, '{NUMBER}') "
    f"THEN try_cast(cell AS DOUBLE) END AS number FROM (SELECT event_id, {MIXED_CELL} AS cell FROM events)",
    "systematic_sample": SAMPLE_SQL,
    "project_numeric": f"SELECT {', '.join(LINEITEM_ALL)} FROM lineitem",
    "preview": "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50",
    "dataset_detail": dataset_detail(),
    "dataset_size": f"SELECT (SELECT count(*) FROM events) AS rows, CAST({len(GAP_COLUMNS) + 1} AS BIGINT) AS cols, memory_mb FROM ({KEYED_GAPS_MEMORY})",
    "dataset_preview": "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50",
    "filter_eq": filtered("kind = 'click'"),
    "filter_eq_number": filtered("l_linenumber = 3", "SELECT * FROM lineitem"),
    "filter_neq": filtered("kind IS DISTINCT FROM 'click'"),
    "filter_gt": filtered("amount > 50"),
    "filter_gte": filtered("amount >= 49.5"),
    "filter_lt": filtered("amount < 10"),
    "filter_lt_date": filtered("o_orderdate < TIMESTAMP '1996-07-01'", "SELECT * FROM orders"),
    "filter_lte": filtered("amount <= 10"),
    "filter_contains": filtered("contains(lower(kind), 'cli')"),
    "filter_not_contains": filtered("kind IS NULL OR NOT contains(lower(kind), 'i')"),
    "filter_is_null": filtered("tag IS NULL OR tag = ''"),
    "filter_not_null": filtered("tag <> ''"),
    "filter_conjunction": filtered("amount > 10 AND tag <> '' AND kind IS DISTINCT FROM 'view' AND flag"),
    "null_counts": with_tables(
        {"src": GAPS_SQL, **missing_ctes(GAP_COLUMNS)}, 'SELECT "column", count AS null_count FROM allmiss'
    ),
    "missing_values": with_tables(
        {"src": GAPS_SQL, **missing_ctes(GAP_COLUMNS)}, 'SELECT "column", count, pct FROM miss'
    ),
    "shape": "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS cols FROM lineitem",
    "group_count": "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1",
    "group_count_null": f"SELECT kind, count(*) AS count FROM ({GAPS_SQL}) GROUP BY kind",
    "group_sum": grouped("coalesce(sum(amount), 0)", "sum_amount"),
    "group_mean": grouped("avg(amount)", "mean_amount"),
    "group_min": grouped("min(amount)", "min_amount"),
    "group_max": grouped("max(amount)", "max_amount"),
    "numeric_profile": numeric_profile("SELECT * FROM lineitem", LINEITEM_ALL),
    "numeric_profile_gaps": numeric_profile(GAPS_SQL, GAPS_NUMERIC),
    "numeric_profile_zero": numeric_profile(GAPS_SQL, GAPS_NUMERIC, fill=True),
    "quartiles": with_tables(
        numbers("SELECT * FROM orders", ORDERS_NUMERIC),
        rounded("SELECT * FROM num", ["q25", "median", "q75"], ["column"]),
    ),
    "histogram": histogram("SELECT * FROM lineitem", LINEITEM_DOUBLES),
    "histogram_gaps": histogram(GAPS_SQL, GAPS_NUMERIC),
    "top_values": top_values("SELECT * FROM part", ["p_name", "p_brand", "p_type"]),
    "unique_count": categorical(
        "SELECT * FROM customer", CATALOG_COLUMNS["customer"].split(","), "column unique_count"
    ),
    "entropy": categorical("SELECT * FROM part", ["p_name", "p_brand", "p_type"], "column entropy"),
    "categorical_profile": categorical(GAPS_SQL, GAPS_CATEGORICAL, "column unique_count null_count entropy"),
    "categorical_profile_orders": categorical(
        "SELECT * FROM orders", ["o_orderstatus", "o_orderpriority"], "column unique_count null_count entropy"
    ),
    "correlation_pairs": correlation_pairs("SELECT * FROM lineitem", LINEITEM_NUMERIC),
    "strong_pairs": "SELECT count(*) AS pairs, count(*) FILTER (WHERE abs(value) >= 0.7) AS strong_pairs "
    f"FROM ({correlation_pairs('SELECT * FROM lineitem', LINEITEM_NUMERIC)})",
    "correlation_bands": correlation_pairs(select(BANDS, "lineitem"), [name for name, _ in BANDS]),
    "correlation_pairs_all": correlation_pairs("SELECT * FROM lineitem", LINEITEM_ALL),
    "correlation_pairs_gaps": correlation_pairs(GAPS_SQL, GAPS_NUMERIC),
    "correlation_matrix": correlation_matrix(GAPS_SQL, GAPS_NUMERIC),
    "correlation_report": correlation_report("SELECT * FROM lineitem", LINEITEM_NUMERIC),
    "correlation_report_bands": correlation_report(select(BANDS, "lineitem"), [name for name, _ in BANDS]),
    "outliers": outliers(f"SELECT {OUTLIER_COLUMNS} FROM outliers"),
    "report_outliers": outliers(OUTLIER_SEVERITY),
    "outlier_severity": outliers(OUTLIER_SEVERITY),
    "outlier_severity_bands": outliers(OUTLIER_SEVERITY, select(SEVERITIES, "events"), [name for name, _ in SEVERITIES]),
    "outlier_total": outlier_total(),
    "duplicate_rows": duplicates("text, lang", "SELECT * FROM documents"),
    "duplicate_rows_gaps": duplicates(", ".join(GAP_COLUMNS), GAPS_SQL),
    "memory_estimate": DOCUMENTS_MEMORY,
    "memory_estimate_orders": ORDERS_MEMORY,
    "column_numeric": with_tables(
        {**numbers(GAPS_SQL, ["amount"]), **frequencies(GAPS_SQL, ["amount"], "c")},
        rounded(
            'SELECT g."column", \'numeric\' AS dtype, g.null_count, '
            + half("CAST(g.null_count AS DOUBLE) / g.rows * 100", 2)
            + ' AS null_pct, c.unique_count, num.* EXCLUDE ("column", null_count) FROM gone g '
            'JOIN num ON num."column" = g."column" JOIN ccat c ON c."column" = g."column"',
            ["null_pct", *FIGURES],
            ["column", "dtype", "null_count", "unique_count"],
        ),
    ),
    "column_categorical": with_tables(
        frequencies(GAPS_SQL, ["tag"]),
        "SELECT t.*, " + half("entropy") + " AS entropy, 'categorical' AS dtype, null_count, "
        + half("CAST(null_count AS DOUBLE) / rows * 100", 2)
        + ' AS null_pct, unique_count FROM top t JOIN cat c ON c."column" = t."column" '
        'JOIN totals s ON s."column" = t."column" WHERE rank <= 20',
    ),
    "column_report_numeric": column_report("amount", histogram(GAPS_SQL, ["amount"]), "bin"),
    "column_report_categorical": column_report("tag", top_values(GAPS_SQL, ["tag"]), "value"),
    "sample_values": "SELECT 'value' AS \"column\", value FROM (SELECT regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') "
    "AS value, min(event_id) AS first FROM events WHERE value IS NOT NULL GROUP BY 1 ORDER BY first LIMIT 10)",
    "sample_values_few": first_values("orders", "o_orderpriority", "o_orderdate, o_orderkey"),
    "sample_values_text": first_values("documents", "text", "n_chars, doc_id"),
    "full_eda": metrics(
        "SELECT * FROM orders",
        ORDERS_NUMERIC,
        ORDERS_OTHERS,
        {
            "rows": "(SELECT count(*) FROM orders)",
            "memory_mb": f"(SELECT memory_mb FROM ({ORDERS_MEMORY}))",
            "was_sampled": "0",
            "sample_size": "(SELECT count(*) FROM orders)",
            "cols": "6",
            "numeric_columns": "3",
            "categorical_columns": "3",
            "duplicate_rows": "(SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders))",
        },
    ),
    "full_eda_histogram": histogram("SELECT * FROM orders", ORDERS_NUMERIC),
    "full_eda_top_values": top_values("SELECT * FROM orders", ORDERS_OTHERS),
    "eda_sampled": metrics(
        SAMPLE_SQL,
        LINEITEM_ALL,
        LINEITEM_OTHERS,
        {
            "rows": "(SELECT count(*) FROM lineitem)",
            "memory_mb": f"(SELECT memory_mb FROM ({LINEITEM_MEMORY}))",
            "was_sampled": "CASE WHEN (SELECT count(*) FROM lineitem) > 50000 THEN 1 ELSE 0 END",
            "sample_size": "least((SELECT count(*) FROM lineitem), 50000)",
            "cols": "11",
            "numeric_columns": "8",
            "categorical_columns": "3",
            "duplicate_rows": "(SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))",
        },
    ),
    "rules_customer": rules(ALL_RULES, CUSTOMER_CTES),
    "rules_spikes": rules(ALL_RULES, SPIKES_CTES),
    "rules_emptyish": rules(ALL_RULES, EMPTYISH_CTES),
    "rules_warnings": rules(ALL_RULES, WARNINGS_CTES),
    "quality_score_customer": quality_score(CUSTOMER_CTES),
    "quality_score_half_full": quality_score(HALF_FULL_CTES),
    "quality_score_emptyish": quality_score(EMPTYISH_CTES),
    "query_sort": f"SELECT * FROM ({KEYED_GAPS_SQL}) ORDER BY amount DESC NULLS LAST, {GAP_ORDER}",
    "query_limit": f"SELECT *, count(*) OVER () AS total_count FROM ({KEYED_GAPS_SQL}) ORDER BY event_id LIMIT 500",
    "query_full": f"SELECT *, count(*) OVER () AS total_count FROM ({FULL_QUERY})",
    "catalog_list": catalog(),
    "catalog_recent": f"SELECT * FROM ({catalog()}) ORDER BY uploaded_at DESC LIMIT 5",
    "catalog_summary": "SELECT count(*) AS total_datasets, CAST(sum(row_count) AS BIGINT) AS total_rows, "
    "CAST(sum(column_count) AS BIGINT) AS total_columns, max(uploaded_at) AS last_uploaded_at "
    f"FROM ({catalog()})",
    "catalog_store": catalog_store({"orders": ORDERS_MEMORY, "lineitem": LINEITEM_MEMORY, "documents": DOCUMENTS_MEMORY}),
    "quality_score": quality_score(),
    "issues": rules(ISSUES),
    "findings": rules(FINDINGS),
    "insights": rules(INSIGHTS),
    "recommendations": rules(RECOMMENDATIONS),
    "unusual": rules(UNUSUAL),
}
