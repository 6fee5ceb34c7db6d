"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions.cells import NUMBER_PATTERN, column
from rowlens.operators.passes import aggregate_each
from rowlens.operators.schema import DATE_TIME_PATTERN, check_scalar_columns, judged_type, shares

FORMATS = ("csv", "parquet")
SINKS = ("csv", "json", "parquet")
MALFORMED = "_malformed"

# The spellings of a boolean cell.
_TRUE, _FALSE = ("true", "TRUE"), ("false", "FALSE")
# Columns whose cells are judged in one scan.
_BATCH = 32

_WHOLE = r"^\s*[+-]?\d+\s*$"


def scan_csv(
    spark: SparkSession,
    path: str,
    typed: bool = True,
    multi_line: bool = False,
    malformed: str = "raise",
) -> DataFrame:
    """A CSV file or folder with a header row; blank lines are skipped, empty cells are null.

    With ``typed``, a text column becomes numeric, boolean or a timestamp if all its present cells fit: whole
    numbers as long or, beyond that, decimal, others as double; else it stays text as it is, and operators convert its
    cells where they use them. One scan of all rows decides that, and counts rows that do not have the header's cells:
    ``malformed`` is raise (an error with their number) or keep (cells that are there, the rest null, and the
    whole line in ``_malformed``). Without ``typed`` a malformed row fails when it is read. ``multi_line`` reads
    quoted line breaks, at the price that a file can no longer be split between tasks; else they are malformed rows.
    """
    if malformed not in ("raise", "keep"):
        raise ValueError("malformed must be raise or keep")
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    names = spark.read.csv(path, **options).columns
    cells = T.StructType([T.StructField(c, T.StringType()) for c in names])
    if not typed and malformed == "raise":
        return _blank_to_null(spark.read.csv(path, schema=cells, mode="FAILFAST", **options), names)
    # Rows are only compared with the header where no column is pruned.
    reader = spark.read.option("columnPruning", False).option("columnNameOfCorruptRecord", MALFORMED)
    whole = reader.csv(path, schema=cells.add(MALFORMED, T.StringType()), mode="PERMISSIVE", **options)
    raw = _blank_to_null(whole, [*names, MALFORMED])
    kept = raw if malformed == "keep" else _blank_to_null(spark.read.csv(path, schema=T.StructType(cells.fields[:-1]), **options), names)
    if not typed:
        return kept
    torn = [F.count_if(column(MALFORMED).isNotNull()).alias("malformed")]
    figures = [shares(raw, c, _TRUE + _FALSE) + _fits(raw, c) + torn for c in names]
    # Every batch parses all lines again, but one aggregate of very many columns is not compiled any more.
    counts = dict(zip(names, aggregate_each(raw, figures, _BATCH)))
    if malformed == "raise" and (n := max((c["malformed"] for c in counts.values()), default=0)):
        raise ValueError(f"{n} rows of {path} do not have the cells of the header; pass malformed='keep' to keep them, or multi_line=True for quoted line breaks")
    return convert_types(kept, {c: _fitting_type(counts[c]) for c in names})


def _blank_to_null(raw: DataFrame, names: list[str]) -> DataFrame:
    """Quoted empty cells are null too."""
    return raw.select(*[F.nullif(column(c), F.lit("")).alias(c) for c in names])


def _fits(df: DataFrame, name: str) -> list[Column]:
    """Counts of cells that are whole numbers, of those that fit a long or a decimal, and of those a double rounds."""
    cell = column(name)
    whole = cell.rlike(_WHOLE)
    return [
        F.count_if(whole).alias("whole"),
        F.count_if(whole & cell.try_cast("long").isNotNull()).alias("longs"),
        F.count_if(whole & cell.try_cast("decimal(38,0)").isNotNull()).alias("decimals"),
        F.count_if(whole & (F.abs(cell.try_cast("double")) > F.lit(float(2**53)))).alias("rounded"),
        F.count_if(cell.rlike(NUMBER_PATTERN) & (F.abs(cell.try_cast("double")) < F.lit(float("inf")))).alias("doubles"),
        F.count_if(cell.rlike(DATE_TIME_PATTERN) & cell.try_cast("timestamp").isNotNull()).alias("times"),
    ]


def _fitting_type(counts: Row) -> str:
    """Spark type that holds every present cell of a text column without loss."""
    present, kind = counts["present"], judged_type(counts)
    if kind == "boolean" and counts["words"] == present:
        return "boolean"
    if kind == "date" and counts["times"] == present:
        return "timestamp"
    if kind == "numeric":
        if counts["whole"] == present:
            return next((t for t, n in (("bigint", "longs"), ("decimal(38,0)", "decimals")) if counts[n] == present), "string")
        if counts["doubles"] == present and not counts["rounded"]:
            return "double"
    return "string"


def convert_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as the Spark types named for them; columns without a name stay."""
    out = []
    for name in df.columns:
        cell, kind = column(name), types.get(name, "string")
        if kind == "boolean":
            cell = F.when(cell.isin(*_TRUE), True).when(cell.isin(*_FALSE), False)
        elif kind != "string":
            cell = cell.try_cast(kind)
        out.append(cell.alias(name))
    return df.select(*out)


def scan(spark: SparkSession, path: str, file_type: str, **options) -> DataFrame:
    if file_type == "csv":
        return scan_csv(spark, path, **options)
    if file_type == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type {file_type!r}; use one of {FORMATS}")


def ingest(df: DataFrame, path: str) -> DataFrame:
    """Store a table as Parquet and read it back, so that later work scans columns, not text."""
    check_scalar_columns(df)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_table(df: DataFrame, path: str, file_type: str = "parquet") -> None:
    """Write a result table; every task writes its own part."""
    if file_type not in SINKS:
        raise ValueError(f"unsupported file type {file_type!r}; use one of {SINKS}")
    writer = df.write.mode("errorifexists")
    if file_type == "csv":
        writer.csv(path, header=True, escape='"')
    elif file_type == "json":
        writer.json(path, ignoreNullFields=False)
    else:
        writer.parquet(path)
