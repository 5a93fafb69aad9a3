"""gridloom: grid, time-series and retrieval analytics as plain Spark jobs."""
