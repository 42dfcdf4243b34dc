"""Other forms and summaries of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methgrid.functions.rounding import share
from methgrid.operators.regions import parse_counts


def to_dss(sites: DataFrame) -> DataFrame:
    """``chr``, ``pos`` (0-based), ``N`` (all calls), ``X`` (methylated calls)."""
    return parse_counts(sites).select(F.col("chrom").alias("chr"), F.col("start").alias("pos"), F.col("total").alias("N"), F.col("meth").alias("X"))


def to_bedgraph(sites: DataFrame) -> DataFrame:
    """One base for each site, whatever its width, and the stored share."""
    return sites.select("chrom", "start", (F.col("start") + 1).alias("end"), "perc")


def stats(sites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``perc``, ``meth``, ``total`` and ``cpgs``; the share is null without calls."""
    sums = parse_counts(sites).groupBy(*(by or [])).agg(F.coalesce(F.sum("meth"), F.lit(0)).alias("meth"), F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"), F.count("*").alias("cpgs"))
    return sums.select(*(by or []), share(F.col("meth"), F.col("total")).alias("perc"), "meth", "total", "cpgs")


def conversion_efficiency(sites: DataFrame, chrom: str = "chrM", by: list[str] | None = None) -> DataFrame:
    """One minus the methylated share of the conversion control."""
    found = stats(sites.filter(F.col("chrom") == chrom), by)
    return found.select(*(by or []), (1 - F.col("perc")).alias("conv_eff"), "meth", "total", F.col("cpgs").alias("cpg_count"))
