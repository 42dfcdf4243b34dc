"""Methylation inside a sequence motif."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methgrid.functions.iupac import motif_pattern, offsets_of
from methgrid.functions.rounding import share

#: Fixed value: the pyrosequencing motif of the LINE-1 repeat.
LINE1 = "TTYGTGGTGYGTYGTTTTTTAAKTYGGTT"


def motif_hits(reads: DataFrame, motif: str = LINE1) -> DataFrame:
    """Reads whose sequence holds the motif, with the leftmost match as ``hit``."""
    pattern = f"({motif_pattern(motif)})"
    return reads.filter(F.col("seq").rlike(pattern)).withColumn("hit", F.regexp_extract("seq", pattern, 1))


def motif_counts(reads: DataFrame, motif: str = LINE1, by: list[str] | None = None) -> DataFrame:
    """For each ``Y`` of the motif how many hits have C there (``meth_i``) and C or T (``total_i``); one pass, no row for each site."""
    aggregates: list[Column] = []
    for i, at in enumerate(offsets_of(motif, "Y"), 1):
        base = F.substring("hit", at + 1, 1)
        aggregates += [F.count_if(base == "C").alias(f"meth_{i}"), F.count_if(base.isin("C", "T")).alias(f"total_{i}")]
    return motif_hits(reads, motif).groupBy(*(by or [])).agg(*aggregates)


def motif_summary(reads: DataFrame, motif: str = LINE1, by: list[str] | None = None) -> DataFrame:
    """``avg_total`` (the mean of the sites' shares), ``avg_i``, then ``meth_i`` and ``total_i``; null where nothing was counted."""
    n = len(offsets_of(motif, "Y"))
    df = motif_counts(reads, motif, by)
    averages = [share(F.col(f"meth_{i}"), F.col(f"total_{i}")) for i in range(1, n + 1)]
    total = averages[0]
    for x in averages[1:]:
        total = total + x
    pairs = [c for i in range(1, n + 1) for c in (f"meth_{i}", f"total_{i}")]
    return df.select(*(by or []), (total / n).alias("avg_total"), *[a.alias(f"avg_{i}") for i, a in enumerate(averages, 1)], *pairs)
