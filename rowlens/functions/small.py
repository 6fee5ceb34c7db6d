"""Small results: rows of per-column scalars, at most a few per column of the profiled table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """A local relation of the rows, so that plans built on it need no job of their own."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*[tuple(r) for r in rows])) if rows else [()] * len(struct.fields)
    arrow = to_arrow_schema(struct)
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.table(arrays, schema=arrow), schema=struct)


def pinned(df: DataFrame) -> DataFrame:
    """The same rows, computed once. Only for results that hold a few rows per profiled column."""
    return small_table(df.sparkSession, df.collect(), df.schema)
