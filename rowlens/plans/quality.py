"""Quality score and rules. They read a profile, so they cost no pass over the table.

Each rule gives rows (section, rule, severity, value, affected_columns): a stable rule code, the
number that fired it, and the columns it names, in table order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions.cells import round_half
from rowlens.functions.labels import fitness
from rowlens.functions.small import pinned, small_table
from rowlens.operators import table
from rowlens.plans.eda import Profile

# Fixed values of the rules; shares of columns in percent, of rows as fractions.
SCORE_NULL_WEIGHT = 2.0
SCORE_DUPLICATE_WEIGHT = 20.0
HIGH_NULL_PCT = 10
CRITICAL_NULL_PCT = 40
MOSTLY_NULL_PCT = 50
MISSING_RATE_PCT = 5
ID_LIKE_SHARE = 0.9
SKEWED = 1
HEAVY_TAILED = 5
LOW_VARIANCE_SHARE = 0.01
DUPLICATE_WARNING_SHARE = 0.01
DUPLICATE_CRITICAL_SHARE = 0.05
HIGH_CARDINALITY = 100
DOMINANT_PCT = 90


def quality_score(profile: Profile) -> DataFrame:
    """One row: rows, cols, null_count, null_pct, duplicate_rows, score, fitness.

    The score of a table without rows is null.
    """
    return _scored(profile.overview)


def table_score(df: DataFrame) -> DataFrame:
    """The quality score of a table that is not profiled: only rows, missing cells and duplicates are counted."""
    rows, missing = table.count_missing(df)
    duplicates = table.duplicate_rows(df).first()["duplicate_rows"]
    facts = [(rows, len(df.columns), duplicates, sum(n for _, n in missing))]
    return _scored(small_table(df.sparkSession, facts, "rows long, cols long, duplicate_rows long, missing_cells long"))


def _scored(overview: DataFrame) -> DataFrame:
    facts = overview.withColumnRenamed("missing_cells", "null_count")
    null_pct = F.try_divide(F.col("null_count").cast("double"), (F.col("rows") * F.col("cols")).cast("double")) * 100
    duplicate_share = F.try_divide(F.col("duplicate_rows").cast("double"), F.col("rows").cast("double"))
    raw = F.lit(100.0) - null_pct * SCORE_NULL_WEIGHT - duplicate_share * SCORE_DUPLICATE_WEIGHT
    whole = F.floor(raw + F.lit(0.5)).cast("long")
    score = F.when(raw.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), whole)))
    return facts.select(
        "rows", "cols", "null_count", null_pct.alias("null_pct"), "duplicate_rows", score.alias("score")
    ).withColumn("fitness", fitness(F.col("score")))


class _Facts:
    """Per-column figures beside the column's position, as local relations, and the overview row."""

    def __init__(self, profile: Profile):
        positions = F.broadcast(profile.columns.select("column", "position"))
        first = profile.top_values.where(F.col("rank") == 1).select("column", F.col("pct").alias("top_pct"))
        numbers = profile.numeric.where(F.col("mean").isNotNull()).join(positions, "column")
        categories = profile.categorical.join(positions, "column").join(F.broadcast(first), "column", "left")
        self.numbers = pinned(numbers.withColumn("range", F.col("max") - F.col("min")))
        self.categories = pinned(categories)
        self.missing = pinned(profile.missing.join(positions, "column"))
        self.dominant = self.categories.where(F.col("top_pct") > DOMINANT_PCT)
        self.high_null = self.missing.where(F.col("pct") > HIGH_NULL_PCT)
        self.skewed = self.numbers.where(F.abs("skewness") > SKEWED)
        self.overview = profile.overview
        self.row = profile.overview.first()


def _rule(section: str, rule: str, found: DataFrame, severity: Column | None = None):
    """One row if the rule found columns: how many, and which."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda c: c["column"])
    label = F.lit(None).cast("string") if severity is None else severity
    return (
        found.agg(
            F.count(F.lit(1)).cast("double").alias("value"),
            listed.alias("affected_columns"),
            label.alias("severity"),
        )
        .where(F.col("value") > 0)
        .select(F.lit(section).alias("section"), F.lit(rule).alias("rule"), "severity", "value", "affected_columns")
    )


def _fact(facts: _Facts, section: str, rule: str, value: Column, when: Column | None = None, severity=None):
    """One row about the whole table, if its condition holds."""
    rows = facts.overview if when is None else facts.overview.where(when)
    return rows.select(
        F.lit(section).alias("section"),
        F.lit(rule).alias("rule"),
        (F.lit(None) if severity is None else severity).cast("string").alias("severity"),
        value.cast("double").alias("value"),
        F.array().cast("array<string>").alias("affected_columns"),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def issues(profile: Profile, facts: _Facts | None = None) -> DataFrame:
    f = facts or _Facts(profile)
    id_like = f.categories.where(F.col("unique_count") > F.lit(f.row["rows"] * ID_LIKE_SHARE))
    share = round_half(F.try_divide(F.col("duplicate_rows").cast("double"), F.col("rows").cast("double")) * 100, 1)
    some = F.col("duplicate_rows") > 0
    return _all(
        [
            _rule("issue", "high_null_columns", f.high_null),
            _fact(f, "issue", "duplicate_rows", F.col("duplicate_rows"), some),
            _fact(f, "issue", "duplicate_pct", share, some),
            _rule("issue", "id_like_columns", id_like),
        ]
    )


def findings(profile: Profile, facts: _Facts | None = None) -> DataFrame:
    f = facts or _Facts(profile)
    numbers = f.numbers.agg(F.count(F.lit(1)).alias("n"))
    # One row: the column with the largest range, the first of them in table order.
    widest = f.numbers.orderBy(F.col("range").desc(), "position").limit(1)
    return _all(
        [
            _fact(f, "finding", "rows", F.col("rows")),
            _fact(f, "finding", "columns", F.col("cols")),
            numbers.select(
                F.lit("finding").alias("section"),
                F.lit("numeric_columns").alias("rule"),
                F.lit(None).cast("string").alias("severity"),
                F.col("n").cast("double").alias("value"),
                F.array().cast("array<string>").alias("affected_columns"),
            ),
            _fact(f, "finding", "categorical_columns", F.col("categorical_columns")),
            _rule("finding", "skewed_columns", f.skewed),
            _rule("finding", "constant_columns", f.numbers.where(F.col("std") == 0)),
            _rule("finding", "mostly_null_columns", f.missing.where(F.col("pct") > MOSTLY_NULL_PCT)),
            widest.select(
                F.lit("finding").alias("section"),
                F.lit("widest_range").alias("rule"),
                F.lit(None).cast("string").alias("severity"),
                F.col("range").alias("value"),
                F.array("column").alias("affected_columns"),
            ),
        ]
    )


def insights(profile: Profile, facts: _Facts | None = None) -> DataFrame:
    f = facts or _Facts(profile)
    worst = F.when(F.max("pct") > CRITICAL_NULL_PCT, "critical").otherwise("warning")
    share = F.col("duplicate_rows").cast("double"), F.col("rows").cast("double")
    many = share[0] > share[1] * DUPLICATE_WARNING_SHARE
    serious = F.when(share[0] > share[1] * DUPLICATE_CRITICAL_SHARE, "critical").otherwise("warning")
    flat = f.numbers.where(
        (F.col("std") < F.col("range") * LOW_VARIANCE_SHARE) & (F.col("max") != F.col("min"))
    )
    pairs = _rule("insight", "multivariate_relationships", f.numbers, F.lit("info")).where(F.col("value") >= 2)
    return _all(
        [
            _rule("insight", "skewed_distributions", f.skewed, F.lit("warning")),
            _rule("insight", "missing_value_patterns", f.high_null, worst),
            _fact(f, "insight", "duplicate_rows_detected", F.col("duplicate_rows"), many, serious),
            _rule("insight", "low_variance_columns", flat, F.lit("info")),
            pairs.withColumn("value", F.col("value") * (F.col("value") - 1) / 2),
        ]
    )


def recommendations(profile: Profile, facts: _Facts | None = None) -> DataFrame:
    """One row per condition, with the branch taken, and the fixed reminder to check types."""
    f = facts or _Facts(profile)
    skewed, numbers = f.skewed.count(), f.numbers.count()
    wide = f.categories.where(F.col("unique_count") > HIGH_CARDINALITY)
    cells = f.row["rows"] * f.row["cols"]
    null_pct = f.row["missing_cells"] / cells * 100 if cells else 0.0
    duplicates = f.row["duplicate_rows"]
    missing = "address_missing_values" if null_pct > MISSING_RATE_PCT else "missing_rate_acceptable"
    rows = [
        (missing, f.row["missing_columns"]),
        None if skewed else ("distributions_symmetric", 0),
        ("remove_duplicates" if duplicates > 0 else "no_duplicates", duplicates),
        ("check_multicollinearity" if numbers > 1 else "single_numeric_column", numbers),
        None if wide.count() else ("cardinality_manageable", 0),
        ("validate_types", f.row["cols"]),
    ]
    fixed = [_fact(f, "recommendation", r[0], F.lit(float(r[1]))) for r in rows if r is not None]
    found = [
        _rule("recommendation", "transform_skewed", f.skewed),
        _rule("recommendation", "encode_high_cardinality", wide),
    ]
    return _all(fixed + found)


def unusual(profile: Profile, facts: _Facts | None = None) -> DataFrame:
    f = facts or _Facts(profile)
    tails = _rule("unusual", "heavy_tails", f.numbers.where(F.abs("kurtosis") > HEAVY_TAILED))
    constant = _rule("unusual", "near_constant_categories", f.dominant)
    found = tails.unionByName(constant)
    # One row that says how many of the two rules fired, kept where none did.
    none = found.agg(F.count(F.lit(1)).alias("fired")).where(F.col("fired") == 0)
    return found.unionByName(
        none.select(
            F.lit("unusual").alias("section"),
            F.lit("none").alias("rule"),
            F.lit(None).cast("string").alias("severity"),
            F.lit(0.0).alias("value"),
            F.array().cast("array<string>").alias("affected_columns"),
        )
    )


def snapshot(profile: Profile) -> DataFrame:
    """All rules in one table."""
    facts = _Facts(profile)
    return _all([rules(profile, facts) for rules in (issues, findings, insights, recommendations, unusual)])
