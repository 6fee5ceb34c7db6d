"""Labels put on correlations, outlier shares and quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (lower limit, label), highest first.
STRENGTH_LEVELS = [(0.8, "Very Strong"), (0.6, "Strong"), (0.4, "Moderate"), (0.2, "Weak")]
REPORT_LEVELS = [(0.7, "Strong"), (0.4, "Moderate")]
FITNESS_LEVELS = [(80, "well-suited"), (60, "adequately suited")]
SEVERITY_LEVELS = [(10.0, "High"), (3.0, "Moderate")]


def _banded(x: Column, levels, fallback: str, reached) -> Column:
    label = F.lit(None).cast("string")
    for number, (limit, name) in enumerate(levels):
        hit = reached(x, F.lit(limit))
        label = F.when(hit, name) if number == 0 else label.when(hit, name)
    return label.otherwise(fallback)


def _at_least(x, limit):
    return x >= limit


def _above(x, limit):
    return x > limit


def strength(r: Column) -> Column:
    return _banded(F.abs(r), STRENGTH_LEVELS, "Negligible", _at_least)


def report_strength(r: Column) -> Column:
    return _banded(F.abs(r), REPORT_LEVELS, "Weak", _at_least)


def direction(r: Column) -> Column:
    return F.when(r > 0, "Positive").otherwise("Negative")


def outlier_severity(pct: Column) -> Column:
    return _banded(pct, SEVERITY_LEVELS, "Low", _above)


def fitness(score: Column) -> Column:
    return F.when(score.isNotNull(), _banded(score, FITNESS_LEVELS, "marginally suited", _at_least))
