"""The registered queries. Each takes (spark, sf_dir) and works on whole tables.

Floating-point results are rounded, halves away from zero, on both sides of the check: sums taken in
another order differ in their last bits.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.functions.cells import number, round_half
from rowlens.operators import categorical, correlation, numeric, outliers, sampling, schema, table
from rowlens.operators import query as builder
from rowlens.operators.query import Filter
from rowlens.plans import column as column_report
from rowlens.plans import detail, eda, quality, report
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
    derive,
    load,
)
from rowlens.sources import catalog, tables
from rowlens.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

PLACES = 4
LINEITEM_DOUBLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_NUMERIC = ["l_linenumber", *LINEITEM_DOUBLES]
ORDERS_CATEGORICAL = ["o_orderstatus", "o_orderpriority"]
# Tables that are registered in a store.
STORED = ["orders", "lineitem", "documents"]


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(load(spark, sf_dir, "events"), GAPS)


def keyed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(load(spark, sf_dir, "events"), [("event_id", "event_id"), *GAPS])


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """All double columns rounded."""
    return df.select(
        *[round_half(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _on(table_name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(load(spark, sf_dir, table_name))


def _on_gaps(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(gaps(spark, sf_dir))


def _on_keyed_gaps(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(keyed_gaps(spark, sf_dir))


def _profiled(result: Callable[[eda.Profile], DataFrame]) -> Query:
    def run(spark, sf_dir):
        return result(eda.full_profile(gaps(spark, sf_dir)))

    return run


def _filtered(*filters: Filter) -> Query:
    return _on_keyed_gaps(lambda df: builder.apply_filters(df, list(filters)))


def _rules(rules: Callable[[eda.Profile], DataFrame]) -> Query:
    def flat(profile):
        named = F.array_join("affected_columns", ",").alias("affected_columns")
        return rounded(rules(profile).select("section", "rule", "severity", "value", named))

    return _profiled(flat)


def _every_rule(df: DataFrame) -> DataFrame:
    profile = eda.full_profile(df)
    parts = [f(profile) for f in (quality.issues, quality.findings, quality.insights, quality.recommendations, quality.unusual)]
    found = reduce(DataFrame.unionByName, parts)
    named = F.array_join("affected_columns", ",").alias("affected_columns")
    return rounded(found.select("section", "rule", "severity", "value", named))


# Sources and sinks


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events_csv")
    props = ("props", "props")
    source = derive(load(spark, sf_dir, "events"), [("event_id", "event_id"), *GAPS, props])
    tables.write_table(source, path, "csv")
    return tables.scan_csv(spark, path)


def scan_csv_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers first and text later in one column, ids that a double would round, and quoted line breaks."""
    path = scratch_path(spark, "mixed_csv")
    tables.write_table(derive(load(spark, sf_dir, "events"), MIXED_FILE), path, "csv")
    return tables.scan_csv(spark, path, multi_line=True)


def ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ingest(keyed_gaps(spark, sf_dir), scratch_path(spark, "ingested"))


def export_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the bundle as JSON, read it back, and list every part's figures in long form."""
    df = gaps(spark, sf_dir)
    path = scratch_path(spark, "bundle")
    entry = catalog.catalog_of({"events": df}, {"events": FIRST_UPLOAD}).first()
    tables.write_table(report.bundle(df, "events", eda.full_profile(df), entry=entry, exported_at=FIRST_UPLOAD), path, "json")
    stored = spark.read.json(path)

    def part(name: str, item: str, *figures: str) -> DataFrame:
        rows = stored.select(F.explode(name).alias("r"))
        listed = ", ".join(f"'{f}', double(r.{f})" for f in figures)
        named = F.expr(f"stack({len(figures)}, {listed}) as (figure, value)")
        return rows.select(F.lit(name).alias("part"), F.expr(item).alias("item"), named)

    figures = ["mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"]
    parts = [
        part("meta", "concat_ws('/', r.dataset_id, r.dataset_name, r.file_type, left(r.exported_at, 10))", "row_count", "column_count"),
        part("overview", "'table'", "rows", "cols", "duplicate_rows", "missing_cells", "memory_mb"),
        part("numeric", "r.column", *figures, "null_count"),
        part("histogram", "concat(r.column, '/', r.bin)", "count"),
        part("categorical", "r.column", "unique_count", "null_count", "entropy"),
        part("top_values", "concat(r.column, '/', r.rank, '/', r.value)", "count", "pct"),
        part("missing", "r.column", "count", "pct"),
        part("quality_score", "'table'", "score", "null_pct"),
        part("snapshot", "concat(r.section, '/', r.rule, '/', coalesce(r.severity, ''), '/', array_join(r.affected_columns, ','))", "value"),
        part("correlation", "concat(r.col1, '/', r.col2)", "value"),
        part("outliers", "r.column", "count", "pct", "lower_bound", "upper_bound"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


# Uploads at one-hour steps, in table order.
FIRST_UPLOAD = dt.datetime(2024, 1, 1)
UPLOADED_AT = {name: FIRST_UPLOAD + dt.timedelta(hours=i) for i, name in enumerate(TABLES)}


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_of({t: load(spark, sf_dir, t) for t in TABLES}, UPLOADED_AT)


def _shown(entries: DataFrame) -> DataFrame:
    return entries.select(
        "id",
        "row_count",
        "column_count",
        "file_type",
        F.array_join("columns", ",").alias("columns"),
        F.col("uploaded_at").cast("string").alias("uploaded_at"),
    )


def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = catalog.catalog_summary(_catalog(spark, sf_dir))
    return summary.withColumn("last_uploaded_at", F.col("last_uploaded_at").cast("string"))


def catalog_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables, each registered twice under one id, and what the store then shows of them."""
    root = scratch_path(spark, "store")
    for name in STORED:
        for _ in range(2):
            catalog.register(load(spark, sf_dir, name), root, f"{name}.parquet", dataset_id=name)
    known = catalog.read_catalog(spark, root).withColumn("columns", F.array_join("columns", ","))
    return known.select("id", "name", "original_name", "row_count", "column_count", "file_type", "columns", "memory_size_mb")


# Schema, coercion, sampling


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = derive(load(spark, sf_dir, "events"), TEXT_CELLS)
    return schema.infer_types(cells).select("position", "column", "semantic_type")


def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = derive(load(spark, sf_dir, "events"), [("event_id", "event_id"), ("cell", MIXED_CELL)])
    return cells.select("event_id", "cell", number(cells, "cell").alias("number"))


def dataset_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.dataset_detail(keyed_gaps(spark, sf_dir)).columns.drop("spark_type")


# Profiles


def _column_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gaps(spark, sf_dir)
    stats, _ = column_report.numeric_column(df, "amount")
    overview = column_report.column_overview(df, "amount")
    return rounded(overview.join(F.broadcast(stats.drop("null_count")), "column"))


def _column_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gaps(spark, sf_dir)
    profile, top = column_report.categorical_column(df, "tag")
    overview = column_report.column_overview(df, "tag")
    shared = profile.select("column", "entropy").join(F.broadcast(overview), "column")
    return top.join(F.broadcast(shared), "column")


def _column_report(name: str) -> Callable[[DataFrame], DataFrame]:
    """Distribution and samples of a column's report in long form."""

    def run(df):
        found = column_report.column_report(df, name, ["event_id"])
        item = F.col("bin").cast("string") if "bin" in found.distribution.columns else F.col("value")
        spread = found.distribution.select(F.lit("distribution").alias("part"), item.alias("item"), F.col("count").cast("long").alias("count"))
        return spread.unionByName(found.samples.select(F.lit("sample").alias("part"), F.col("value").alias("item"), F.lit(None).cast("long").alias("count")))

    return _on_keyed_gaps(run)


def _report_correlation(df: DataFrame) -> DataFrame:
    pairs = correlation.correlation_pairs(df, LINEITEM_NUMERIC)
    return correlation.report_table(pairs)


def _sorted(df: DataFrame) -> DataFrame:
    return builder.run_query(df, sort_by="amount", sort_dir="desc").rows


def _limited(df: DataFrame) -> DataFrame:
    rows, total = builder.run_query(df, sort_by="event_id", limit=500).fetch()
    return rows.withColumn("total_count", F.lit(total).cast("long"))


def _full_query(df: DataFrame) -> DataFrame:
    filters = [Filter("amount", "gte", "5"), Filter("tag", "not_contains", "SIGN"), Filter("kind", "neq", "view")]
    result = builder.run_query(df, filters, "kind", "mean", "amount", sort_by="mean_amount", sort_dir="desc")
    return rounded(result.rows.withColumn("total_count", F.lit(result.total_count()).cast("long")))


def _grouped(aggregation: str) -> Query:
    def run(df):
        return rounded(builder.aggregate(df, "kind", aggregation, "amount"))

    return _on_gaps(run)


def full_eda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of orders in long form."""
    return rounded(eda.profile_metrics(eda.full_profile(load(spark, sf_dir, "orders"))))


def eda_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of lineitem, its columns on a systematic sample of the default size."""
    df = load(spark, sf_dir, "lineitem")
    profile = eda.full_profile(df, ["l_orderkey", "l_linenumber"], sample_threshold=sampling.SAMPLE_ROWS)
    return rounded(eda.profile_metrics(profile))


QUERIES: dict[str, Query] = {
    "scan_csv": scan_csv,
    "scan_csv_mixed": scan_csv_mixed,
    "ingest_roundtrip": ingest_roundtrip,
    "export_bundle": export_bundle,
    "report_overview": _profiled(report.overview),
    "report_numeric": _profiled(report.numeric_table),
    "report_categorical": _profiled(report.categorical_table),
    "report_missing": _profiled(report.missing_report),
    "report_column_directory": _profiled(report.column_directory),
    "infer_types": infer_types,
    "coerce_numeric": coerce_numeric,
    "systematic_sample": _on(
        "lineitem", lambda df: sampling.systematic_sample(df, ["l_orderkey", "l_linenumber"])
    ),
    "project_numeric": _on("lineitem", schema.project_numeric),
    "preview": _on("orders", lambda df: table.preview(df, ["o_orderdate", "o_orderkey"])),
    "dataset_detail": dataset_detail,
    "dataset_size": _on_keyed_gaps(lambda df: detail.dataset_detail(df).size),
    "dataset_preview": _on("orders", lambda df: detail.dataset_detail(df, ["o_orderdate", "o_orderkey"]).preview),
    "filter_eq": _filtered(Filter("kind", "eq", "click")),
    "filter_eq_number": _on("lineitem", lambda df: builder.apply_filters(df, [Filter("l_linenumber", "eq", "3")])),
    "filter_neq": _filtered(Filter("kind", "neq", "click")),
    "filter_gt": _filtered(Filter("amount", "gt", "50")),
    "filter_gte": _filtered(Filter("amount", "gte", "49.5")),
    "filter_lt": _filtered(Filter("amount", "lt", "10")),
    "filter_lt_date": _on("orders", lambda df: builder.apply_filters(df, [Filter("o_orderdate", "lt", "1996-07-01")])),
    "filter_lte": _filtered(Filter("amount", "lte", "1e1")),
    "filter_contains": _filtered(Filter("kind", "contains", "CLI")),
    "filter_not_contains": _filtered(Filter("kind", "not_contains", "I")),
    "filter_is_null": _filtered(Filter("tag", "is_null")),
    "filter_not_null": _filtered(Filter("tag", "not_null")),
    "filter_conjunction": _filtered(
        Filter("amount", "gt", "10"), Filter("tag", "not_null"), Filter("kind", "neq", "view"), Filter("flag", "eq", "true")
    ),
    "null_counts": _on_gaps(table.null_counts),
    "missing_values": _on_gaps(table.missing_values),
    "shape": _on("lineitem", table.shape),
    "group_count": _on("orders", lambda df: builder.aggregate(df, "o_orderpriority", "count")),
    "group_count_null": _on_gaps(lambda df: builder.aggregate(df, "kind")),
    "group_sum": _grouped("sum"),
    "group_mean": _grouped("mean"),
    "group_min": _grouped("min"),
    "group_max": _grouped("max"),
    "numeric_profile": _on("lineitem", lambda df: rounded(numeric.numeric_profile(df))),
    "numeric_profile_gaps": _on_gaps(lambda df: rounded(numeric.numeric_profile(df, GAPS_NUMERIC))),
    "numeric_profile_zero": _on_gaps(
        lambda df: rounded(numeric.numeric_profile(df, GAPS_NUMERIC, null_policy="zero"))
    ),
    "quartiles": _on("orders", lambda df: rounded(numeric.quartiles(df))),
    "histogram": _on("lineitem", lambda df: numeric.histogram(df, LINEITEM_DOUBLES)),
    "histogram_gaps": _on_gaps(lambda df: numeric.histogram(df, GAPS_NUMERIC)),
    "top_values": _on("part", lambda df: categorical.top_values(df, ["p_name", "p_brand", "p_type"])),
    "unique_count": _on("customer", categorical.unique_count),
    "entropy": _on("part", lambda df: categorical.entropy(df, ["p_name", "p_brand", "p_type"])),
    "categorical_profile": _on_gaps(lambda df: categorical.categorical_profile(df, GAPS_CATEGORICAL)),
    "categorical_profile_orders": _on(
        "orders", lambda df: categorical.categorical_profile(df, ORDERS_CATEGORICAL)
    ),
    "correlation_pairs": _on("lineitem", lambda df: correlation.correlation_pairs(df, LINEITEM_NUMERIC)),
    "correlation_bands": _on("lineitem", lambda df: correlation.correlation_pairs(derive(df, BANDS))),
    "correlation_pairs_all": _on("lineitem", lambda df: correlation.correlation_pairs(df)),
    "correlation_pairs_gaps": _on_gaps(lambda df: correlation.correlation_pairs(df, GAPS_NUMERIC)),
    "correlation_matrix": _on_gaps(lambda df: correlation.correlation_matrix(df, GAPS_NUMERIC)),
    "correlation_report_bands": _on("lineitem", lambda df: correlation.report_table(correlation.correlation_pairs(derive(df, BANDS)))),
    "correlation_report": _on("lineitem", _report_correlation),
    "outliers": _on_gaps(lambda df: outliers.outliers(df, GAPS_NUMERIC)),
    "report_outliers": _on_gaps(lambda df: report.outlier_table(eda.full_profile(df), df)),
    "strong_pairs": _on("lineitem", lambda df: correlation.strong_count(correlation.correlation_pairs(df, LINEITEM_NUMERIC))),
    "outlier_severity": _on_gaps(lambda df: outliers.with_severity(outliers.outliers(df, GAPS_NUMERIC))),
    "outlier_severity_bands": _on("events", lambda df: outliers.with_severity(outliers.outliers(derive(df, SEVERITIES)))),
    "outlier_total": _on_gaps(lambda df: outliers.outlier_total(df, GAPS_NUMERIC)),
    "duplicate_rows": _on("documents", lambda df: table.duplicate_rows(df.select("text", "lang"))),
    "duplicate_rows_gaps": _on_gaps(table.duplicate_rows),
    "memory_estimate": _on("documents", table.memory_estimate),
    "memory_estimate_orders": _on("orders", table.memory_estimate),
    "column_numeric": _column_numeric,
    "column_categorical": _column_categorical,
    "column_report_numeric": _column_report("amount"),
    "column_report_categorical": _column_report("tag"),
    "sample_values": _on("events", lambda df: categorical.sample_values(df, "value", ["event_id"])),
    "sample_values_few": _on("orders", lambda df: categorical.sample_values(df, "o_orderpriority", ["o_orderdate", "o_orderkey"])),
    "sample_values_text": _on("documents", lambda df: categorical.sample_values(df, "text", ["n_chars", "doc_id"])),
    "full_eda": full_eda,
    "full_eda_histogram": _on("orders", lambda df: eda.full_profile(df).histogram),
    "full_eda_top_values": _on("orders", lambda df: eda.full_profile(df).top_values),
    "eda_sampled": eda_sampled,
    "query_sort": _on_keyed_gaps(_sorted),
    "query_limit": _on_keyed_gaps(_limited),
    "query_full": _on_keyed_gaps(_full_query),
    "catalog_list": lambda spark, sf_dir: _shown(catalog.catalog_list(_catalog(spark, sf_dir))),
    "catalog_recent": lambda spark, sf_dir: _shown(catalog.catalog_recent(_catalog(spark, sf_dir))),
    "catalog_summary": catalog_summary,
    "catalog_store": catalog_store,
    "quality_score": _on_gaps(lambda df: rounded(quality.table_score(df))),
    "quality_score_customer": _on("customer", lambda df: rounded(quality.table_score(df))),
    "quality_score_half_full": _on("events", lambda df: rounded(quality.table_score(derive(df, HALF_FULL)))),
    "quality_score_emptyish": _on("events", lambda df: rounded(quality.table_score(derive(df, EMPTYISH)))),
    "rules_customer": _on("customer", _every_rule),
    "rules_spikes": _on("lineitem", lambda df: _every_rule(derive(df, SPIKES))),
    "rules_warnings": _on("events", lambda df: _every_rule(derive(df, WARNINGS))),
    "rules_emptyish": _on("events", lambda df: _every_rule(derive(df, EMPTYISH))),
    "issues": _rules(quality.issues),
    "findings": _rules(quality.findings),
    "insights": _rules(quality.insights),
    "recommendations": _rules(quality.recommendations),
    "unusual": _rules(quality.unusual),
}
