"""FASTQ files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.sources.lines import numbered_lines

FIELDS = ("header", "seq", "third", "qual")


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records from their lines, which come one after the other; only a header's line has its ``src``."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        lines = pa.Table.from_batches([*left, batch]).combine_chunks()
        n = lines.num_rows // 4 * 4
        left = lines.slice(n).to_batches()
        if not n:
            continue
        number = lines["line"].to_numpy()[:n].reshape(-1, 4)
        if (number[:, 0] % 4).any() or (np.diff(number) != 1).any():
            raise ValueError("lines of a FASTQ file are out of order")
        at = [np.arange(k, n, 4) for k in range(4)]
        columns = [lines["src"].take(at[0]), pa.array(number[:, 0] // 4), *[lines["value"].take(x) for x in at]]
        yield from pa.table(columns, names=["src", "ord", *FIELDS]).to_batches()
    if left:
        raise ValueError("a FASTQ record lacks lines")


def read_fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """Reads of plain or ``.gz`` files: ``src``, ``ord`` (their number in the file), ``header``, ``seq``, ``third``, ``qual``. An unfinished last record is left out. A folder as write_fastq() makes it is read like one file.

    Records are put together where their lines are read; only the few that
    lie over the border of two blocks are gathered by their number.
    """
    lines = numbered_lines(spark, *paths, folders=True, blocks=True)
    part, first = F.pmod("line", F.lit(4)), F.col("line") - F.pmod("line", F.lit(4))
    inside = (first >= F.col("block_start")) & (first + 4 <= F.col("block_end"))
    folded = lines.filter(inside).select(F.when(part == 0, F.col("src")).alias("src"), "line", "value")
    folded = folded.mapInArrow(fold, "src string, ord long, " + ", ".join(f"{x} string" for x in FIELDS))
    fields = [F.max(F.when(part == k, F.col("value"))).alias(name) for k, name in enumerate(FIELDS)]
    over = lines.filter(~inside).groupBy("src", F.floor(F.col("line") / 4).cast("long").alias("ord")).agg(*fields)
    return folded.unionByName(over.filter("qual IS NOT NULL"))


def write_fastq(reads: DataFrame, path: str, gz: bool = False, by: str | None = None) -> None:
    """Four lines for each read, in the order of ``ord``; ``by`` names a column that deals the reads to folders."""
    record = F.concat_ws("\n", *FIELDS).alias("value")
    dealt = [by] if by else []
    # sorted by folder first, as the writer asks: it would sort anew, and lose the order
    ordered = reads.repartitionByRange("ord").sortWithinPartitions(*dealt, "ord").select(*dealt, record)
    out = ordered.write.option("compression", "gzip" if gz else "none")
    (out.partitionBy(by) if by else out).text(path)
