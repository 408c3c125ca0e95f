"""Composite pipelines and the queries that apply operators to the test tables."""
