"""Compositions of operators: the full profile, the column report, quality rules, exports."""
