"""Registered queries: each is (spark, sf_dir) -> DataFrame, most with a DuckDB twin."""
