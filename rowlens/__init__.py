"""Table profiling and data-quality checks as Spark jobs."""
