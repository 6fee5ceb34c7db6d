"""The dataset catalog: one row per stored table.

A store is a folder: ``data/<id>/<attempt>`` holds the tables, ``catalog/<id>/<attempt>`` a manifest of one row for each.
Both are written once, to a folder of their own, and never changed. A manifest is written after its table is complete,
so whatever fails before leaves nothing that is read; and as no two registrations write to one folder, none can take
away what another is writing. Where a registration was made twice, the catalog shows its first manifest.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from rowlens.functions.small import small_table
from rowlens.operators import table
from rowlens.operators.passes import one_scan
from rowlens.sources.tables import ingest

RECENT = 5

CATALOG_SCHEMA = (
    "id string, name string, original_name string, row_count long, column_count int, "
    "file_size_bytes long, file_type string, storage_path string, columns array<string>, "
    "uploaded_at timestamp, memory_size_mb double"
)
_MISSING_PATH = "PATH_NOT_FOUND"


def plain_name(original_name: str) -> str:
    """The file name without its extension."""
    stem, dot, extension = original_name.rpartition(".")
    return stem if dot and extension and "/" not in extension else original_name


def file_type_of(original_name: str) -> str:
    return original_name.rpartition(".")[2].lower()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files below a path; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes")).first()["bytes"]


def register(
    df: DataFrame,
    root: str,
    original_name: str,
    name: str | None = None,
    source_path: str | None = None,
    dataset_id: str | None = None,
) -> DataFrame:
    """Store a table below ``root``, add its catalog row, and return the stored table.

    The file size is that of ``source_path`` where given, else that of the stored table. A caller that may have to repeat a
    registration names it by a ``dataset_id``: once it is complete, further calls with this id return the table
    stored first and add nothing; an id that already stands for another file name or other columns is an error.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    identifier = dataset_id or str(uuid.uuid4())
    if "/" in identifier or identifier.startswith(("_", ".")):
        raise ValueError(f"dataset id {identifier!r} is no folder name that Spark reads")
    known = _entry(spark, root, identifier)
    if known is None:
        attempt = uuid.uuid4().hex
        path = f"{root}/data/{identifier}/{attempt}"
        stored = ingest(df, path)
        facts = one_scan(stored, {"rows": table.rows_state(), "size": table.json_state(stored)})
        row = (
            identifier,
            name or plain_name(original_name),
            original_name,
            facts["rows"]["rows"],
            len(stored.columns),
            stored_bytes(spark, source_path or path),
            file_type_of(original_name),
            path,
            stored.columns,
            dt.datetime.now(dt.timezone.utc),
            table.size_in_mb(facts["size"]["json_chars"]),
        )
        entry = small_table(spark, [row], CATALOG_SCHEMA)
        entry.coalesce(1).write.mode("errorifexists").parquet(f"{root}/catalog/{identifier}/{attempt}")
        # Of two registrations at the same time both return the table that the catalog shows.
        known = _entry(spark, root, identifier)
    if (known["original_name"], known["columns"]) != (original_name, df.columns):
        raise ValueError(f"dataset id {identifier!r} stands for {known['original_name']!r} with columns {known['columns']}")
    return spark.read.parquet(known["storage_path"])


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """The manifests below a folder; folders of writes that were not completed are not read."""
    reader = spark.read.schema(CATALOG_SCHEMA).option("recursiveFileLookup", True)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != _MISSING_PATH:
            raise
        return small_table(spark, [], CATALOG_SCHEMA)


def _firsts(manifests: DataFrame) -> DataFrame:
    """The first manifest of each dataset."""
    order = Window.partitionBy("id").orderBy("uploaded_at", "storage_path")
    return manifests.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def _entry(spark: SparkSession, root: str, identifier: str) -> Row | None:
    """The catalog row of one dataset; only its own folder is listed."""
    return _firsts(_manifests(spark, f"{root}/catalog/{identifier}")).first()


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per registered dataset; none where nothing was registered."""
    return _firsts(_manifests(spark, f"{root.rstrip('/')}/catalog"))


def open_dataset(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """The stored table of a registered dataset."""
    known = _entry(spark, root.rstrip("/"), dataset_id)
    if known is None:
        raise KeyError(dataset_id)
    return spark.read.parquet(known["storage_path"])


def catalog_list(catalog: DataFrame) -> DataFrame:
    """All datasets, newest first."""
    return catalog.orderBy(F.col("uploaded_at").desc(), "id")


def catalog_recent(catalog: DataFrame, k: int = RECENT) -> DataFrame:
    return catalog_list(catalog).limit(k)


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """One row: number of datasets, their rows and columns, and the last upload."""
    zero = F.lit(0).cast("long")
    return catalog.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.coalesce(F.sum("row_count"), zero).alias("total_rows"),
        F.coalesce(F.sum(F.col("column_count").cast("long")), zero).alias("total_columns"),
        F.max("uploaded_at").alias("last_uploaded_at"),
    )


def catalog_of(tables: dict[str, DataFrame], uploaded_at: dict[str, dt.datetime]) -> DataFrame:
    """Catalog rows of tables already at hand; their rows are counted by Spark, in one job."""
    rows = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("id"),
            F.lit(name).alias("name"),
            F.lit(f"{name}.parquet").alias("original_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.lit("parquet").alias("file_type"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
            F.lit(uploaded_at[name].isoformat(sep=" ")).cast("timestamp_ntz").alias("uploaded_at"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows
