"""Overlap joins of half-open intervals.

Both sides are cut into bins and joined on chromosome and bin, so that no task
compares a whole chromosome with itself. A pair that shares several bins is
taken in the last bin where both begin, and so counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of bins where the intervals say none.
BIN = 4096
Width = Column | int


def check_lengths(df: DataFrame) -> DataFrame:
    """Empty intervals raise when the plan runs."""
    ok = F.assert_true(F.col("end") > F.col("start"), F.lit("an interval is empty or runs backwards"))
    return df.filter(ok.isNull())


def mean_length(intervals: DataFrame) -> Column:
    """The width of bins for a join with these intervals: their mean length, one number, found before the join runs.

    So the bins of all intervals are at most three times as many as the
    intervals, and a place is compared, on average, with at most twice as
    many intervals as cover it. Bins of one fixed width are either too many
    for wide intervals, or bring narrow ones together that lie far apart.
    """
    length = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    # a sum of longs is the same however often it is taken; avg() adds fractions
    return intervals.agg(F.coalesce(F.ceil(F.sum(length) / F.count(length)), F.lit(BIN)).cast("long")).scalar()


def binned(df: DataFrame, width: Width) -> DataFrame:
    """A row for each bin that an interval touches, and the ``__first`` of them; for points that is one."""
    ends = {"__first": F.floor(F.col("start") / width), "__last": F.floor((F.col("end") - 1) / width)}
    return df.withColumns(ends).withColumn("__bin", F.explode(F.sequence("__first", F.greatest("__first", "__last")))).drop("__last")


def overlapping(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{a}.end") > F.col(f"{b}.start"))


def overlap_join(left: DataFrame, right: DataFrame, width: Width | None = None) -> DataFrame:
    """All pairs that share a base; the right side's columns get the prefix ``r_``, without its chromosome. Bins are as wide as the right side's intervals on average; a left side of far wider ones needs a ``width``."""
    width = mean_length(right) if width is None else width
    a, b = binned(left, width).alias("a"), binned(right, width).alias("b")
    on = (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.__bin") == F.col("b.__bin")) & overlapping("a", "b")
    once = F.col("a.__bin") == F.greatest("a.__first", "b.__first")
    return a.join(b, on & once).select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}").alias(f"r_{c}") for c in right.columns if c != "chrom"])


def overlap_filter(left: DataFrame, right: DataFrame, how: str, width: Width | None = None) -> DataFrame:
    """Rows of ``left`` with (``left_semi``) or without (``left_anti``) an overlap; whole rows, never clipped.

    Point features stay where they are. A wide feature touches several bins,
    so its overlaps are found first and its key joined back.
    """
    points = left.filter("end = start + 1")
    narrow_width = mean_length(right) if width is None else width
    bins = binned(right.select("chrom", "start", "end"), narrow_width).alias("b")
    at = points.withColumn("__bin", F.floor(F.col("start") / narrow_width)).alias("a")
    on = (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.__bin") == F.col("b.__bin")) & overlapping("a", "b")
    narrow = at.join(bins, on, how).drop("__bin")
    wide = left.filter("end <> start + 1")
    keys = wide.select("chrom", "start", "end").distinct()
    hit = overlap_join(keys, right.select("chrom", "start", "end"), BIN if width is None else width).select("chrom", "start", "end").distinct()
    return narrow.unionByName(wide.join(hit, ["chrom", "start", "end"], how).select(*left.columns))


def mask(sites: DataFrame, masked: DataFrame | None, width: Width | None = None) -> DataFrame:
    """Sites that touch no masked interval; without a mask all of them."""
    return sites if masked is None else overlap_filter(sites, masked, "left_anti", width)


def sites_in(sites: DataFrame, regions: DataFrame, width: Width | None = None) -> DataFrame:
    """Sites that touch a region."""
    return overlap_filter(sites, regions, "left_semi", width)
