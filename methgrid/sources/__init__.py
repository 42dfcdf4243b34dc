"""Readers of sequencing and interval files as DataFrames, and writers."""
