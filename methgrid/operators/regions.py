"""Methylation of regions and windows over samples.

Sites have ``sample``, ``chrom``, ``start``, ``end``, ``perc`` (two-decimal
text) and ``total``; regions ``chrom``, ``start``, ``end``, ``name`` and
``ord`` (their order in the file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methgrid.functions.rounding import share, stored_methylated
from methgrid.operators.intervals import Width, mask, mean_length, overlap_join


def parse_counts(sites: DataFrame) -> DataFrame:
    """Sites with ``meth``, the methylated calls that the stored share stands for."""
    return sites.withColumn("meth", stored_methylated(F.col("perc"), F.col("total")))


def split_name(name: Column) -> tuple[Column, Column]:
    """Share (text) and total of a feature's name, like ``0.50-10``."""
    parts = F.split(name, "-")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).cast("long")


def eligible_chroms(files: DataFrame, regions: DataFrame, n_samples: int) -> DataFrame:
    """Chromosomes of the regions for which every sample has a file (``files``: sample, chrom), with their order in the region file."""
    full = files.select("sample", "chrom").distinct().groupBy("chrom").agg(F.count("*").alias("n")).filter(F.col("n") == n_samples).select("chrom")
    return regions.groupBy("chrom").agg(F.min("ord").alias("chrom_ord")).join(full, "chrom", "left_semi")


def own_chroms(sites: DataFrame, regions: DataFrame, samples: list[str], files: DataFrame | None, min_cpgs: int, min_samples: int) -> DataFrame:
    """eligible_chroms() for a wide table. Where no ``files`` are given, and a region passes only with sites of every sample, no region of another chromosome gets into the table: then the sites need not be looked through."""
    if files is None and min_samples in (-1, len(samples)) and min_cpgs >= 1:
        return regions.groupBy("chrom").agg(F.min("ord").alias("chrom_ord"))
    own = (sites if files is None else files).filter(F.col("sample").isin(samples))
    return eligible_chroms(own, regions, len(samples))


def distinct_regions(regions: DataFrame) -> DataFrame:
    """Regions of one start and end become one; the last name wins."""
    return regions.groupBy("chrom", "start", "end").agg(F.max_by("name", "ord").alias("name"))


def region_hits(sites: DataFrame, regions: DataFrame, width: Width | None = None) -> DataFrame:
    """A row for each site in each region: the region's start and end as ``r_start``, ``r_end``, and the site."""
    return overlap_join(sites, regions.select("chrom", "start", "end"), width)


def region_counts(sites: DataFrame, regions: DataFrame, samples: list[str], width: Width | None = None) -> DataFrame:
    """Sums for every region and sample: ``meth``, ``total``, ``cpgs``; zeros where a sample has no site there."""
    hits = region_hits(parse_counts(sites), regions, width)
    sums = hits.groupBy("chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end"), "sample").agg(F.sum("meth").alias("meth"), F.sum("total").cast("long").alias("total"), F.count("*").alias("cpgs"))
    grid = regions.select("chrom", "start", "end", "name").withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
    joined = grid.join(sums, ["chrom", "start", "end", "sample"], "left")
    return joined.select("chrom", "start", "end", "name", "sample", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("meth", "total", "cpgs")])


def passes(min_reads: int, min_cpgs: int) -> Column:
    return (F.col("total") >= min_reads) & (F.col("cpgs") >= min_cpgs)


def gate(counts: DataFrame, min_reads: int = 1, min_cpgs: int = 10) -> DataFrame:
    """Counts with ``perc``: the methylated share, null below either threshold."""
    return counts.withColumn("perc", F.when(passes(min_reads, min_cpgs), share(F.col("meth"), F.col("total"))))


def wide(counts: DataFrame, samples: list[str], min_reads: int, min_cpgs: int, min_samples: int, raw: bool = False) -> DataFrame:
    """One row for each region that at least ``min_samples`` samples pass (-1: all of them): a share for each sample, or, ``raw``, three counts for each, also of samples that fail. Sample columns are aggregates, so no pivot job looks for their names."""
    need = len(samples) if min_samples == -1 else min_samples
    ok = F.count_if(passes(min_reads, min_cpgs))
    own = lambda s, c: F.max(F.when(F.col("sample") == s, F.col(c)))
    if raw:
        cells = [own(s, c).alias(f"{s}_{label}") for s in samples for c, label in (("meth", "methylated"), ("total", "total"), ("cpgs", "cpgs"))]
        table = counts
    else:
        cells = [own(s, "perc").alias(s) for s in samples]
        table = gate(counts, min_reads, min_cpgs)
    return table.groupBy("chrom", "start", "end", "name").agg(ok.alias("__ok"), *cells).filter(F.col("__ok") >= need).drop("__ok")


def roi_meth(
    sites: DataFrame, regions: DataFrame, samples: list[str], masked: DataFrame | None = None, files: DataFrame | None = None, min_reads: int = 1, min_cpgs: int = 10, min_samples: int = -1, raw: bool = False, width: Width | None = None, ordered: bool = True
) -> DataFrame:
    """The wide table of regions, in the order of the region file's chromosomes, then start and end. ``files`` says which sample has which chromosome; by default those with sites."""
    chroms = own_chroms(sites, regions, samples, files, min_cpgs, min_samples)
    own = distinct_regions(regions).join(chroms.select("chrom"), "chrom", "left_semi")
    counts = region_counts(mask(sites, masked, width), own, samples, mean_length(regions) if width is None else width)
    table = wide(counts, samples, min_reads, min_cpgs, min_samples, raw)
    return table.join(chroms, "chrom").orderBy("chrom_ord", "start", "end").drop("chrom_ord") if ordered else table


def windows(chroms: DataFrame, size: int, gapless: bool = False) -> DataFrame:
    """Windows over chromosomes (``chrom``, ``length``): from 1 in steps of ``size``, each ``size - 1`` wide, the last one not clipped. Read half-open they leave out every position that ``size`` divides; ``gapless`` windows leave out none."""
    low = 0 if gapless else 1
    starts = F.when(F.col("length") > low, F.sequence(F.lit(low).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    each = chroms.select("chrom", F.explode(starts).alias("start"))
    return each.select("chrom", "start", (F.col("start") + (size if gapless else size - 1)).alias("end"), F.lit("").alias("name"))


def window_counts(sites: DataFrame, chroms: DataFrame, size: int, samples: list[str], gapless: bool = False) -> DataFrame:
    """region_counts() over windows, without a join for the overlaps: the windows of a site follow from its place."""
    low, shift = F.floor(F.col("start") / size), 1 if gapless else 2
    high = F.floor((F.col("end") - shift) / size)
    # positions that lie between two windows have none
    span = F.when(high >= F.greatest(low, F.lit(0)), F.sequence(F.greatest(low, F.lit(0)), high))
    placed = parse_counts(sites).join(chroms.select("chrom", "length"), "chrom").withColumn("__k", F.explode(span))
    first = F.col("__k") * size + (0 if gapless else 1)
    placed = placed.withColumn("__start", first).filter(F.col("__start") < F.col("length"))
    sums = placed.groupBy("chrom", F.col("__start").alias("start"), "sample").agg(F.sum("meth").alias("meth"), F.sum("total").cast("long").alias("total"), F.count("*").alias("cpgs"))
    grid = windows(chroms, size, gapless).withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
    joined = grid.join(sums, ["chrom", "start", "sample"], "left")
    return joined.select("chrom", "start", "end", "name", "sample", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("meth", "total", "cpgs")])


def window_meth(
    sites: DataFrame, chroms: DataFrame, samples: list[str], size: int = 20000, masked: DataFrame | None = None, files: DataFrame | None = None, min_reads: int = 1, min_cpgs: int = 20, min_samples: int = -1, raw: bool = False, gapless: bool = False, ordered: bool = True
) -> DataFrame:
    """The wide table of windows; ``chroms`` has chrom, length and ord."""
    own = own_chroms(sites, chroms, samples, files, min_cpgs, min_samples)
    lengths = chroms.join(own.select("chrom"), "chrom", "left_semi")
    table = wide(window_counts(mask(sites, masked), lengths, size, samples, gapless), samples, min_reads, min_cpgs, min_samples, raw)
    return table.join(own, "chrom").orderBy("chrom_ord", "start", "end").drop("chrom_ord") if ordered else table
