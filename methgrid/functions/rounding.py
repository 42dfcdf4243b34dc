"""Fractions as fixed text. ``format_number`` rounds the exact binary value half to even, as C's printf does; ``round`` and ``format_string`` don't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction_text(value: Column, digits: int = 2) -> Column:
    """A number from 0 to 1 with a fixed count of decimals."""
    return F.format_number(value, digits)


def stored_methylated(perc: Column, total: Column) -> Column:
    """The count that a two-decimal share and a total stand for: lossy above 100 calls."""
    return F.floor(perc.cast("double") * total.cast("double") + F.lit(0.5)).cast("long")


def share(methylated: Column, total: Column) -> Column:
    """methylated / total; null without calls."""
    return F.when(total > 0, methylated / total)
