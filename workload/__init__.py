"""Test workload: fixture views over the given tables, the queries, and their reference SQL."""
