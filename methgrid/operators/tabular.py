"""Arithmetic on columns of tab-separated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjust_columns(lines: DataFrame, columns: list[int], adjusts: list[int], header: Column | None = None, value: str = "value") -> DataFrame:
    """Lines with a whole number added to each given 0-based column. Header lines, and columns that a line doesn't have, stay as they are."""
    if len(columns) != len(adjusts):
        raise ValueError("as many columns as adjustments are needed")

    def adjusted(cell: Column, at: Column) -> Column:
        out = cell
        for c, a in zip(columns, adjusts):
            out = F.when(at == c, (cell.cast("long") + a).cast("string")).otherwise(out)
        return out

    line = F.array_join(F.transform(F.split(F.col(value), "\t"), adjusted), "\t")
    return lines.withColumn(value, line if header is None else F.when(header, F.col(value)).otherwise(line))
