"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The files of a folder that Spark wrote; their numbers give their order.
PART = r"/part-(\d+)-[^/]*$"


def numbered_lines(spark: SparkSession, *paths: str, folders: bool = False, blocks: bool = False) -> DataFrame:
    """``src`` (the file), ``line`` (from 0) and ``value`` of plain and gzipped text files, from any store that Spark reads.

    Files are read in blocks, in parallel. Lines get numbers inside their
    block; one row for each block then says where the block's numbers start.
    These rows are broadcast, so lines stay where they are read, in their order.
    With ``folders`` the parts of a folder that Spark wrote are one file,
    ``src`` being the folder. With ``blocks`` a line also has the first line
    of its block and of the next one, ``block_start`` and ``block_end``.
    """
    text = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    found = text.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__id").alias("__least"))
    found = found.withColumn("src", F.regexp_replace("__file", PART, "") if folders else F.col("__file"))
    # no file that isn't a part shares its src with another, so the number counts only where there is one
    number = F.when(F.col("__file").rlike(PART), F.regexp_extract("__file", PART, 1).cast("long"))
    before = Window.partitionBy("src").orderBy(number, "__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.select("src", "__file", "__block", "n", "__least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_start"))
    placed = text.join(F.broadcast(starts), ["__file", "__block"])
    more = ["block_start", (F.col("block_start") + F.col("n")).alias("block_end")] if blocks else []
    return placed.select("src", (F.col("block_start") + F.col("__id") - F.col("__least")).alias("line"), "value", *more)
