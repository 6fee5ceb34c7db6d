"""Every rule, severity, strength and band occurs in what some registered query has to give."""

import os

import pytest

from rowlens.registry.oracles import ORACLES
from tests.compare import connect

SF_DIR = os.environ.get("TEST_LABELS_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")

RULES = {
    "issue": "high_null_columns duplicate_rows duplicate_pct id_like_columns",
    "finding": "rows columns numeric_columns categorical_columns skewed_columns constant_columns mostly_null_columns widest_range",
    "insight": "skewed_distributions missing_value_patterns duplicate_rows_detected low_variance_columns multivariate_relationships",
    "recommendation": "address_missing_values missing_rate_acceptable transform_skewed distributions_symmetric remove_duplicates no_duplicates "
    "check_multicollinearity single_numeric_column encode_high_cardinality cardinality_manageable validate_types",
    "unusual": "heavy_tails near_constant_categories none",
}


@pytest.fixture(scope="module")
def given():
    con = connect(SF_DIR)

    def run(names, columns):
        rows = set()
        for name in names:
            rows |= set(con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall())
        return rows

    return run


def test_rules_and_their_severities(given):
    names = ["issues", "findings", "insights", "recommendations", "unusual", *(n for n in ORACLES if n.startswith("rules_"))]
    found = given(names, "section, rule, severity")
    assert {(s, r) for s, r, _ in found} == {(s, r) for s, listed in RULES.items() for r in listed.split()}
    for rule in ("missing_value_patterns", "duplicate_rows_detected"):
        assert {v for _, r, v in found if r == rule} == {"warning", "critical"}


def test_bands(given):
    assert given(["outlier_severity", "outlier_severity_bands"], "severity") == {("High",), ("Moderate",), ("Low",)}
    assert given(["correlation_report", "correlation_report_bands"], "strength") == {("Strong",), ("Moderate",), ("Weak",)}
    assert given(["correlation_report_bands"], "direction") == {("Positive",), ("Negative",)}
    assert {v for v, in given(["correlation_bands", "correlation_pairs"], "strength")} == {"Very Strong", "Strong", "Moderate", "Weak", "Negligible"}
    scores = [n for n in ORACLES if n.startswith("quality_score")]
    assert given(scores, "fitness") == {("well-suited",), ("adequately suited",), ("marginally suited",)}
