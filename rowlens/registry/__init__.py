"""Registered queries over the benchmark tables, and the SQL each one must agree with."""
