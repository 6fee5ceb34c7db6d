"""The full profile of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.functions.small import pinned, small_table
from rowlens.operators import categorical, numeric, sampling, schema, table
from rowlens.operators.passes import one_scan, written

OVERVIEW_SCHEMA = (
    "rows long, cols long, numeric_columns long, categorical_columns long, duplicate_rows long, "
    "missing_cells long, missing_columns long, memory_mb double, was_sampled boolean, sample_size long"
)


@dataclass(frozen=True)
class Profile:
    """Result tables of one profile: rows of scalars per column, held as local relations.

    The scans, shuffles and sorts are done when this exists; whatever reads it costs no new pass.
    """

    types: dict[str, str]
    overview: DataFrame  # one row
    columns: DataFrame  # position, column, spark_type, semantic_type
    numeric: DataFrame
    histogram: DataFrame
    categorical: DataFrame
    top_values: DataFrame
    missing: DataFrame
    quartiles: dict[str, numeric.Quartiles]

    @property
    def spark(self):
        return self.overview.sparkSession


def full_profile(
    df: DataFrame,
    order_by: list[str] | None = None,
    null_policy: str = "skip",
    sample_threshold: int | None = None,
) -> Profile:
    """Profile every column, in five scans at most, and a sixth where a frequent value is longer than its key.

    The first scan counts rows, missing cells and the shares that tell the types of text columns, measures the numbers and sizes the
    table. The second groups all that needs a key: buckets, bins and powers of numbers, values of categories, whole
    rows. The others narrow the quartiles.

    All rows are used unless ``sample_threshold`` is given: then the columns of a larger table are profiled on a
    systematic sample of that size in the order of ``order_by``. Types, row and missing counts, duplicates and size stay those
    of the whole table.
    """
    first = one_scan(df, _first_states(df, null_policy))
    types = schema.declared_types(df)
    for c, kind in types.items():
        if kind is None:
            types[c] = schema.judged_type(first["shares", c])
    numbers = schema.numeric_columns(df, types)
    categories = schema.categorical_columns(df, types)
    rows = first["rows"]["rows"]
    missing = [(c, first["missing", c]["missing"]) for c in df.columns]
    counts = dict(missing)

    sampled = sample_threshold is not None and rows > sample_threshold
    if sampled and not order_by:
        raise ValueError("a sample needs order_by")
    # A sample is small by its definition, and read by every pass below.
    source = sampling.systematic_sample(df, order_by, sample_threshold).persist() if sampled else df
    source_rows = sample_threshold if sampled else rows
    measures = numeric.measure(source, numbers, null_policy) if sampled else [numeric.Measure(c, *first["extent", c]) for c in numbers]

    entries = numeric.number_keys(source, measures, null_policy) + categorical.value_keys(source, categories, len(numbers))
    # Duplicates are those of the whole table, which a sample does not show.
    keys, duplicates = written(source, entries + ([] if sampled else table.row_keys(source)), numeric.scales(measures))
    figures, histogram, quartiles = numeric.from_keys(source, keys, measures, null_policy)
    found, top = categorical.from_keys(source, keys, categories, source_rows, start=len(numbers))
    if sampled:
        source.unpersist()
        duplicates = table.repeated_rows(df)

    spark = df.sparkSession
    # Missing cells are counted on the whole table, also where the figures are those of a sample.
    profile = [(*row[:-1], counts[row["column"]]) for row in figures.collect()]
    overview = (
        rows,
        len(df.columns),
        len(numbers),
        len(categories),
        duplicates,
        sum(counts.values()),
        sum(n > 0 for n in counts.values()),
        None,
        sampled,
        source_rows,
    )
    size = table.megabytes(F.lit(first["size"]["json_chars"]).cast("long"))
    return Profile(
        types=types,
        overview=pinned(small_table(spark, [overview], OVERVIEW_SCHEMA).withColumn("memory_mb", size)),
        columns=small_table(
            spark,
            [(i, f.name, f.dataType.simpleString(), types[f.name]) for i, f in enumerate(df.schema.fields)],
            schema.TYPES_SCHEMA,
        ),
        numeric=small_table(spark, profile, numeric.PROFILE_SCHEMA),
        histogram=pinned(histogram),
        categorical=_with_missing(spark, found, categories, counts),
        top_values=top,
        missing=table.missing_table(df, rows, missing),
        quartiles=quartiles,
    )


def _first_states(df: DataFrame, null_policy: str) -> dict:
    """What the operators want to know of all rows before any of them can group: a state under each operator's name."""
    states = {"rows": table.rows_state(), "size": table.json_state(df)}
    for c, kind in schema.declared_types(df).items():
        states["missing", c] = table.missing_state(df, c)
        if kind is None:
            states["shares", c] = schema.shares(df, c)
        # Text may turn out to be numbers.
        if kind in (None, "numeric"):
            states["extent", c] = numeric.extent(df, c, null_policy)
    return states


def _with_missing(spark, found: DataFrame, categories: list[str], counts: dict[str, int]) -> DataFrame:
    """The categorical profile with the whole table's missing counts, and a row for every column."""
    known = {r["column"]: r for r in found.collect()}
    rows = []
    for c in categories:
        r = known.get(c)
        rows.append((c, r["unique_count"] if r else 0, counts[c], r["entropy"] if r else 0.0))
    return small_table(spark, rows, categorical.PROFILE_SCHEMA)


def profile_metrics(profile: Profile) -> DataFrame:
    """The profile in long form: (column, metric, value), table-wide metrics under a null column."""
    overview = profile.overview.select(
        F.lit(None).cast("string").alias("column"),
        F.expr(
            "stack(8, 'rows', double(rows), 'cols', double(cols), "
            "'memory_mb', memory_mb, 'was_sampled', double(int(was_sampled)), 'sample_size', double(sample_size), "
            "'numeric_columns', double(numeric_columns), "
            "'categorical_columns', double(categorical_columns), "
            "'duplicate_rows', double(duplicate_rows)) as (metric, value)"
        ),
    )
    figures = [f for f in profile.numeric.columns if f != "column"]
    numbers = _long(profile.numeric, figures)
    categories = _long(profile.categorical, ["unique_count", "null_count", "entropy"])
    missing = _long(profile.missing.withColumnRenamed("pct", "missing_pct"), ["missing_pct"])
    return overview.unionByName(numbers).unionByName(categories).unionByName(missing)


def _long(df: DataFrame, figures: list[str]) -> DataFrame:
    doubles = df.select("column", *[F.col(f).cast("double").alias(f) for f in figures])
    return doubles.unpivot(["column"], figures, "metric", "value")
