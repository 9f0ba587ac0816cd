"""Whole pipelines and the queries that the entry point registers."""
