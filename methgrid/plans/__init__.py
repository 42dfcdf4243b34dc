"""Pipelines, and the queries of the driver's contract."""
