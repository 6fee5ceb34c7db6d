"""Tables the queries run on: the given ones, and two derived from all rows of ``events``.

The derivations are SQL expressions that Spark and the checking engine both understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

# Events with nulls, blanks, a constant, a boolean and repeated rows.
GAPS = [
    ("kind", "nullif(event_type, 'error')"),
    ("tag", "CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END"),
    ("amount", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"),
    ("mostly_null", "CASE WHEN event_id % 3 = 0 THEN value END"),
    ("constant", "CAST(3.0 AS DOUBLE)"),
    ("flag", "event_id % 2 = 0"),
    ("near_constant", "CASE WHEN event_id % 20 = 0 THEN 'b' ELSE 'a' END"),
]
GAPS_NUMERIC = ["amount", "mostly_null", "constant"]
GAPS_CATEGORICAL = ["kind", "tag", "flag", "near_constant"]

# Events as raw text cells, on both sides of the limits of type inference.
TEXT_CELLS = [
    ("event_id", "event_id"),
    ("number_all", "CAST(value AS VARCHAR(40))"),
    ("number_80", "CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR(40)) END"),
    ("number_90", "CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR(40)) END"),
    ("trap", "concat(CAST(value AS VARCHAR(40)), 'd')"),
    ("words_90", "CASE WHEN event_id % 10 = 0 THEN 'maybe' WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END"),
    ("words_95", "CASE WHEN event_id % 20 = 0 THEN 'maybe' WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END"),
    ("blank", "CASE WHEN event_id % 2 = 0 THEN '' END"),
    ("kind", "event_type"),
    ("active", "event_id % 2 = 0"),
]

# Events as a file whose cells only later rows show to be text, with ids beyond 2**53 and quoted line breaks.
MIXED_FILE = [
    ("id", "event_id + 9007199254740993"),
    ("mixed", "CASE WHEN event_id < 4000 THEN CAST(event_id AS VARCHAR(40)) ELSE concat('t', CAST(event_id AS VARCHAR(40))) END"),
    ("half", "event_id + 0.5"),
    ("note", "concat(event_type, chr(10), 'second line')"),
]

# Tables on which the remaining rules fire: a unique text and a far value, in a row that all sizes have; missing shares of the lower bands.
SPIKES = [
    ("line", "concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))"),
    ("returned", "l_returnflag"),
    ("quantity", "l_quantity"),
    ("spike", "CASE WHEN l_orderkey = 8 AND l_linenumber = 2 THEN CAST(1000000 AS DOUBLE) ELSE l_tax END"),
]
HALF_FULL = [
    ("event_id", "event_id"),
    ("amount", "CASE WHEN event_id % 10 < 4 THEN NULL ELSE value END"),
    ("kind", "CASE WHEN event_id % 20 = 0 THEN '' ELSE event_type END"),
]
EMPTYISH = [
    ("amount", "CASE WHEN event_id % 5 = 0 THEN floor(value / 50) END"),
    ("one", "CAST(1 AS DOUBLE)"),
    ("kind", "CASE WHEN event_id % 7 = 0 THEN event_type END"),
]

# One column of numbers, a fifth of the texts missing, and a row in 25 that repeats another.
WARNINGS = [
    ("amount", "CASE WHEN event_id % 25 = 0 THEN CAST(1 AS DOUBLE) ELSE value + event_id END"),
    ("label", "CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(event_type, CAST(event_id AS VARCHAR(20))) END"),
]
# An eighth, a twentieth and none of the numbers lie far from the others.
SEVERITIES = [
    ("far_often", "CASE WHEN event_id % 8 = 0 THEN CAST(100000 AS DOUBLE) ELSE CAST(event_id % 10 AS DOUBLE) END"),
    ("far_seldom", "CASE WHEN event_id % 20 = 0 THEN CAST(-100000 AS DOUBLE) ELSE CAST(event_id % 10 AS DOUBLE) END"),
    ("far_never", "CAST(event_id % 10 AS DOUBLE)"),
]

# Columns that correlate with the first by about 0.9, 0.6, 0.4 and 0.2, and one against it.
BANDS = [
    ("base", "l_quantity"),
    ("very_strong", "l_quantity + l_discount * 220"),
    ("strong", "l_quantity + l_discount * 600"),
    ("moderate", "l_quantity + l_discount * 1030"),
    ("weak", "l_quantity + l_discount * 2200"),
    ("against", "l_tax * 100 - l_quantity"),
]

# One raw cell per event: plain, padded, signed and exponent numbers, and text that only looks like one.
MIXED_CELL = (
    "CASE event_id % 10 "
    "WHEN 0 THEN CAST(value AS VARCHAR(40)) "
    "WHEN 1 THEN concat('  ', CAST(value AS VARCHAR(40)), ' ') "
    "WHEN 2 THEN concat('+', CAST(value AS VARCHAR(40))) "
    "WHEN 3 THEN concat(CAST(value AS VARCHAR(40)), 'e2') "
    "WHEN 4 THEN concat(CAST(value AS VARCHAR(40)), 'd') "
    "WHEN 5 THEN 'inf' "
    "WHEN 6 THEN '1,000' "
    "WHEN 7 THEN '' "
    "WHEN 8 THEN concat('.', CAST(user_id AS VARCHAR(20))) "
    "ELSE NULL END"
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def select(columns: list[tuple[str, str]], table: str) -> str:
    """The derivation as SQL text."""
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns) + f" FROM {table}"


def derive(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    # Text is plain STRING on the Spark side.
    plain = [(name, sql.replace("VARCHAR(40)", "STRING").replace("VARCHAR(20)", "STRING")) for name, sql in columns]
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in plain])
