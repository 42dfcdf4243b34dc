"""Summaries of alignment logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A log line's mark, and the place of its value among the words.
METRICS = [
    ("bases", "Total bases of uniquely mapped", 9),
    ("mappability", "Mappability", 4),
    ("mcg", "mCG", 3),
    ("mchg", "mCHG", 3),
    ("mchh", "mCHH", 3),
]
FILE = ("Read filename", 4)


def word(line: Column, place: int) -> Column:
    return F.get(F.split(F.trim(line), r"\s+"), F.lit(place))


def parse_log(lines: DataFrame, by: list[str]) -> DataFrame:
    """One row for each log (``by``, lines in ``value``): the file and every metric as text."""
    line = F.col("value")
    marked = lambda mark: line.rlike(mark + r"\b")
    values = [F.max(F.when(marked(mark), word(line, place))).alias(name) for name, mark, place in METRICS]
    return lines.groupBy(*by).agg(F.max(F.when(marked(FILE[0]), word(line, FILE[1]))).alias("read_file"), *values)


def summarize_logs(noadap: DataFrame, trimmed: DataFrame, conversion: DataFrame | None = None) -> DataFrame:
    """One row: each metric of the run without and with trimmed adapters; the columns of ``conversion``, one row, are appended."""
    side = lambda df, label: parse_log(df, []).select(*[F.col(name).alias(f"{name}_{label}") for name, _, _ in METRICS])
    both = side(noadap, "noadap").crossJoin(side(trimmed, "trimmed"))  # a row each
    both = both.select(*[f"{name}_{label}" for name, _, _ in METRICS for label in ("noadap", "trimmed")])
    return both if conversion is None else both.crossJoin(conversion.limit(1))
