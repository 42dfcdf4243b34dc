"""Read filters and adapter trimming.

A read has ``src`` (its file), ``ord`` (its number in the file), ``header``,
``seq``, ``third`` and ``qual``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADAPTER = "AGATCGGAAG"
FLAGGED = ":[YN]:"
PASSED = r"^@.* [^:]*:N:[^:]*:"
FAILED = r"^@.* [^:]*:Y:[^:]*:"


def quality_filter(reads: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Reads whose header says that the sequencer's filter passed them.

    A file whose first header carries no filter flag is not filtered (with
    ``strict_compat`` it yields nothing). What the first headers say, one row a
    file, is broadcast: dealt by file, the reads of one would go to one task.
    """
    # the least number with the answer in its last digit (0: none, 1: a flag, 2: no header): a long needs no sort
    says = F.coalesce(F.col("header").rlike(FLAGGED).cast("long"), F.lit(2))
    least = F.min(F.col("ord").cast("long") * 4 + says)
    firsts = reads.groupBy("src").agg(F.nullif(F.pmod(least, F.lit(4)), F.lit(2)).cast("boolean").alias("__flagged"))
    joined = reads.join(F.broadcast(firsts), reads["src"].eqNullSafe(firsts["src"])).drop(firsts["src"])
    passed = F.col("header").rlike(PASSED)
    keep = F.col("__flagged") & passed if strict_compat else ~F.col("__flagged") | passed
    return joined.filter(keep).select(*reads.columns)


def head(text: Column, n: Column) -> Column:
    """The first n characters; none for n below 1."""
    return F.substring(text, F.lit(1), F.greatest(n, F.lit(0)))


def chewed(length: Column, chew: int, strict_compat: bool) -> Column:
    """What is left after ``chew`` bases are dropped; dropping 0 drops all only under ``strict_compat``."""
    return F.lit(0) if strict_compat and chew == 0 else length - chew


def trim_se(reads: DataFrame, adapter: str = ADAPTER, chew: int = 10, min_read: int = 35, strict_compat: bool = False) -> DataFrame:
    """Single-end trimming. Reads without the adapter lose ``chew`` last bases (``route`` noadap, whatever their length); the others are cut at its first place, lose ``chew`` more, and stay if ``min_read`` bases are left (``route`` trimmed)."""
    at = F.instr("seq", F.lit(adapter)) if adapter else F.lit(0)
    length = F.when(at > 0, chewed(at - 1, chew, strict_compat)).otherwise(chewed(F.length("seq"), chew, strict_compat))
    df = reads.withColumn("route", F.when(at > 0, "trimmed").otherwise("noadap")).withColumn("__n", length)
    qual_n = F.when(F.col("route") == "trimmed", F.col("__n")).otherwise(chewed(F.length("qual"), chew, strict_compat))
    df = df.filter((F.col("route") == "noadap") | (F.col("__n") >= min_read))
    df = df.withColumn("qual", head(F.col("qual"), qual_n)).withColumn("seq", head(F.col("seq"), F.col("__n")))
    return df.drop("__n")


def trim_pe(forward: DataFrame, reverse: DataFrame, forward_adapter: str = ADAPTER, reverse_adapter: str = ADAPTER, chew: int = 10, min_read: int = 35, strict_compat: bool = False) -> DataFrame:
    """Paired-end trimming of reads paired by ``ord``: one row a pair, columns of either read with prefix ``f_`` and ``r_``.

    A pair goes if either header says failed. Both reads are cut at the earlier
    adapter; if that is the forward read's end, both only lose ``chew`` bases.
    """
    side = lambda df, p: df.select(F.col("ord"), *[F.col(c).alias(f"{p}_{c}") for c in ("header", "seq", "third", "qual")])
    pairs = side(forward, "f").join(side(reverse, "r"), "ord")
    pairs = pairs.filter(~(F.col("f_header").rlike(FAILED) | F.col("r_header").rlike(FAILED)))

    def before(seq: str, adapter: str) -> Column:
        at = F.instr(seq, F.lit(adapter)) if adapter else F.lit(0)
        return F.when(at > 0, at - 1).otherwise(F.length(seq))

    cut = F.least(before("f_seq", forward_adapter), before("r_seq", reverse_adapter))
    pairs = pairs.withColumn("__cut", cut).withColumn("route", F.when(F.col("__cut") == F.length("f_seq"), "noadap").otherwise("trimmed"))
    left = chewed(F.col("__cut"), chew, strict_compat)
    pairs = pairs.filter((F.col("route") == "noadap") | (left >= min_read))
    own = lambda c: head(F.col(c), F.when(F.col("route") == "noadap", chewed(F.length(c), chew, strict_compat)).otherwise(left))
    cutters = ("f_seq", "f_qual", "r_seq", "r_qual")
    return pairs.select("ord", "route", *[own(c).alias(c) if c in cutters else F.col(c) for c in ("f_header", "f_seq", "f_third", "f_qual", "r_header", "r_seq", "r_third", "r_qual")])
