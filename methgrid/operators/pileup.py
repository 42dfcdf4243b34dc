"""From aligned reads to methylation sites.

An aligned read has ``chrom``, ``start`` (0-based), ``mpos`` (the mate's start,
-1 without), ``strand``, ``xm`` (a call for each base) and ``ord`` (its number
in the file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methgrid.functions.rounding import fraction_text

# Calls by context; capitals are methylated.
CONTEXTS = {
    "C": "ZzYyXx",
    "CG": "Xx",
    "CH": "ZzYy",
    "CHG": "Yy",
    "CHH": "Zz",
}
#: Reads of a file in which duplicates are sought together.
BLOCK_ROWS = 1_000_000
STRANDS = {"positive": "+", "negative": "-", "both": None}
# Track colours by share of methylated calls.
BLACK, BLUE, GREEN, RED = "0,0,0", "27,74,210", "27,210,57", "210,27,27"


def check_arguments(context: str, strand: str) -> None:
    if context not in CONTEXTS:
        raise ValueError(f"context {context!r} is none of {sorted(CONTEXTS)}")
    if strand not in STRANDS:
        raise ValueError(f"strand {strand!r} is none of {sorted(STRANDS)}")


def truncate_mates(reads: DataFrame) -> DataFrame:
    """Calls that lie over the mate are dropped from the read that starts first."""
    over = F.col("mpos") - F.col("start")
    return reads.withColumn("xm", F.when(over > 0, F.substring(F.col("xm"), F.lit(1), over.cast("int"))).otherwise(F.col("xm")))


def strand_filter(reads: DataFrame, strand: str = "both") -> DataFrame:
    sign = STRANDS[strand]
    return reads if sign is None else reads.filter(F.col("strand") == sign)


def dedup_runs(reads: DataFrame, max_dup: int = 1, sorted_by_start: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of each run of consecutive reads with one start, strand and mate start, the first ``max_dup``.

    Runs are sought inside blocks of the file, so that a chromosome is spread
    over all tasks; a row for each block then tells how much of its first run
    lies in the blocks before. In a file that is sorted by start a run never
    leaves its start, so that the starts serve as blocks and nothing is carried
    over.
    """
    key = F.struct("start", "strand", "mpos")
    block = F.col("start") if sorted_by_start else F.floor(F.col("ord") / block_rows)
    blocked = reads.withColumn("__block", block).withColumn("__key", key)
    inside = Window.partitionBy("chrom", "__block").orderBy("ord")
    new = F.lag("ord").over(inside).isNull() | ~F.col("__key").eqNullSafe(F.lag("__key").over(inside))
    marked = blocked.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = marked.withColumn("__place", F.row_number().over(Window.partitionBy("chrom", "__block", "__run").orderBy("ord")))
    if not sorted_by_start:
        placed = placed.join(carried(placed), ["chrom", "__block"]).withColumn("__place", F.col("__place") + F.when(F.col("__run") == 1, F.col("__carry")).otherwise(0))
    return placed.filter(F.col("__place") <= max_dup).select(*reads.columns)


def carried(placed: DataFrame) -> DataFrame:
    """For each chromosome and block how many reads of its first run lie in the blocks before it."""
    blocks = placed.groupBy("chrom", "__block").agg(F.min_by("__key", "ord").alias("first"), F.max_by("__key", "ord").alias("last"), F.max("__run").alias("runs"), F.max_by("__place", "ord").cast("long").alias("trailing"))
    in_order = Window.partitionBy("chrom").orderBy("__block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    linked = blocks.withColumn("continues", F.lag("__block").over(in_order).isNotNull() & F.col("first").eqNullSafe(F.lag("last").over(in_order))).withColumn("sum", F.coalesce(F.sum("trailing").over(before), F.lit(0)))
    # a run reaches back over blocks that are one run and continue the one before; the sum where it begins is the largest of those at other blocks
    begins = F.max(F.when(~((F.col("runs") == 1) & F.col("continues")), F.col("sum"))).over(before)
    return linked.select("chrom", "__block", F.when(F.col("continues"), F.col("sum") - begins).otherwise(0).alias("__carry"))


def called_bases(reads: DataFrame, context: str = "CG") -> DataFrame:
    """A row for each call of the context: chrom, pos, methylated. Positions run down on the minus strand."""
    calls = CONTEXTS[context]
    each = reads.select("chrom", "start", "strand", F.posexplode(F.split("xm", "")).alias("i", "call")).filter(F.col("call").isin(*calls))
    pos = F.when(F.col("strand") == "-", F.col("start") - F.col("i")).otherwise(F.col("start") + F.col("i"))
    return each.select("chrom", pos.cast("long").alias("pos"), (F.col("call") == F.upper("call")).alias("methylated"))


def count_sites(bases: DataFrame) -> DataFrame:
    """Methylated and all calls for each position."""
    return bases.groupBy("chrom", "pos").agg(F.count_if("methylated").alias("meth"), F.count("*").alias("total"))


def pileup(reads: DataFrame, context: str = "CG", strand: str = "both", max_dup: int = 1, sorted_by_start: bool = False) -> DataFrame:
    """Sites of aligned reads: strand filter, duplicate cap, mate truncation, then counting."""
    check_arguments(context, strand)
    return count_sites(called_bases(truncate_mates(dedup_runs(strand_filter(reads, strand), max_dup, sorted_by_start)), context))


def colour(perc: Column) -> Column:
    return F.when(perc == 0, BLACK).when(perc <= 0.6, BLUE).when(perc <= 0.8, GREEN).otherwise(RED)


def render(sites: DataFrame) -> DataFrame:
    """Sites as nine-column BED rows: the share to two decimals and the total as name, and a colour by the unrounded share."""
    perc = F.col("meth") / F.col("total")
    name = F.concat(fraction_text(perc), F.lit("-"), F.col("total").cast("string"))
    zero = F.lit(0).cast("long")
    return sites.select(
        "chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), name.alias("name"), zero.alias("score"), F.lit("+").alias("strand"), zero.alias("thick_start"), zero.alias("thick_end"), colour(perc).alias("rgb")
    )


def merge(*parts: DataFrame) -> DataFrame:
    """Aligned reads of several files, with ``part``, the number of the file."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def merge_sorted(*parts: DataFrame) -> DataFrame:
    """Aligned reads of several files in one order: by chromosome, start, file and place in the file."""
    return merge(*parts).orderBy("chrom", "start", "part", "ord")
