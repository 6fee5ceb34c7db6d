"""What a dataset's page shows first: its columns with their types and missing cells, its size, and its first rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.functions.small import small_table
from rowlens.operators import schema, table
from rowlens.operators.passes import one_scan


@dataclass(frozen=True)
class Detail:
    columns: DataFrame  # position, column, spark_type, semantic_type, null_count
    size: DataFrame  # one row: rows, cols, memory_mb
    preview: DataFrame


def dataset_detail(df: DataFrame, order_by: list[str] | None = None, k: int = table.PREVIEW_ROWS) -> Detail:
    """Types, missing cells and size from one scan of all rows, and a preview of ``k`` rows in the stated order.

    The preview is not computed before it is asked for; without an order it reads no more than it shows.
    """
    kinds = schema.declared_types(df)
    states = {"rows": table.rows_state(), "size": table.json_state(df)}
    for c, kind in kinds.items():
        states["missing", c] = table.missing_state(df, c)
        if kind is None:
            states["shares", c] = schema.shares(df, c)
    found = one_scan(df, states)
    rows = [
        (i, f.name, f.dataType.simpleString(), kinds[f.name] or schema.judged_type(found["shares", f.name]), found["missing", f.name]["missing"])
        for i, f in enumerate(df.schema.fields)
    ]
    spark = df.sparkSession
    facts = small_table(spark, [(found["rows"]["rows"], len(df.columns), found["size"]["json_chars"])], "rows long, cols long, json_chars long")
    return Detail(
        columns=small_table(spark, rows, f"{schema.TYPES_SCHEMA}, null_count long"),
        size=facts.select("rows", "cols", table.megabytes(F.col("json_chars")).alias("memory_mb")),
        preview=table.preview(df, order_by, k),
    )
