"""SAM and BAM files as aligned reads."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from methgrid.sources.lines import numbered_lines
from methgrid.sources.shared import new_folder


def require_tags(reads: DataFrame, wanted: Column) -> DataFrame:
    """The reads that are ``wanted``; one of them without calls or strand raises when the plan runs. One condition, so that the optimizer cannot judge the others."""
    whole = F.assert_true(F.col("xm").isNotNull() & F.col("strand").isin("+", "-"), F.lit("a read lacks its XM tag, or its XO tag has no strand")).isNull()
    return reads.filter(F.when(wanted, whole).otherwise(False))


def read_sam(spark: SparkSession, *paths: str, chroms: list[str] | None = None) -> DataFrame:
    """Placed reads of SAM text: contig, 0-based start and mate start (-1 without), strand (first sign of XO), calls (XM), and their number in the file."""
    lines = numbered_lines(spark, *paths).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    return sam_reads(lines.select("src", F.col("line").alias("ord"), "value"), chroms)


def sam_reads(lines: DataFrame, chroms: list[str] | None = None) -> DataFrame:
    """Placed reads of SAM lines (``value``); other columns stay as they are."""
    cells = F.split("value", "\t")
    tag = lambda name: F.regexp_extract("value", rf"\t{name}:Z:([^\t]*)", 1)
    reads = lines.select(
        *[c for c in lines.columns if c != "value"],
        F.get(cells, F.lit(2)).alias("chrom"),
        (F.get(cells, F.lit(3)).cast("long") - 1).alias("start"),
        (F.get(cells, F.lit(7)).cast("long") - 1).alias("mpos"),
        F.nullif(F.substring(tag("XO"), 1, 1), F.lit("")).alias("strand"),
        F.when(F.col("value").rlike(r"\tXM:Z:"), tag("XM")).alias("xm"),
    )
    placed = (F.col("chrom") != "*") & (F.col("start") >= 0)
    return require_tags(reads, placed if chroms is None else placed & F.col("chrom").isin(chroms))


# How a BGZF block begins; the rest of its head is its length less one, in two bytes.
BLOCK_MARK = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
BLOCK_HEAD = len(BLOCK_MARK) + 2
#: Blocks, of 64 KB at most, that come to Python at once.
BLOCKS_AT_ONCE = 256
#: Reads in a batch.
BATCH = 10_000


def inflate(block: bytes) -> bytes:
    """The contents of one BGZF block, given without its mark."""
    if len(block) < 10 or struct.unpack_from("<H", block)[0] + 1 != len(block) + len(BLOCK_MARK):
        raise ValueError("a BGZF block has another length than it says, or a head of another form")
    return zlib.decompress(block[2:-8], -15)


# Bytes of a tag's value by its type.
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def tags(data: bytes, at: int, end: int) -> dict[str, str]:
    """The text tags of one alignment."""
    out = {}
    while at < end:
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            out[name] = data[at:stop].decode()
            at = stop + 1
        elif kind == "B":
            count = struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + count * TAG_BYTES[chr(data[at])]
        else:
            at += TAG_BYTES[kind]
    return out


def parse_header(data: bytes) -> tuple[list[str], int]:
    """The contigs' names, and where the alignments begin."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        names, (count,) = [], struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(count):
            size = struct.unpack_from("<i", data, at)[0]
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
    except struct.error as e:
        raise ValueError("the header does not end in the first part of the file") from e
    if at > len(data):
        raise ValueError("the header does not end in the first part of the file")
    return names, at


def plausible(data: bytes, at: int) -> int | None:
    """Where an alignment that could begin here would end; none if none could. Beyond the end of ``data`` nothing is known."""
    if at + 36 > len(data):
        return len(data) + 1
    size, ref, start, name_len, _, _, cigars, _, length, mate_ref, mate = struct.unpack_from("<iiiBBHHHiii", data, at)
    least = 32 + name_len + 4 * cigars + (length + 1) // 2 + length
    if name_len < 1 or length < 0 or size < least or min(ref, start, mate_ref, mate) < -1:
        return None
    name = data[at + 36 : at + 36 + name_len]
    if len(name) == name_len and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def first_record(data: bytes, records: int = 4) -> int | None:
    """The first place where a chain of ``records`` alignments could begin, or one that reaches the end of ``data``. Whether it does is settled by the part before (see read_bam)."""
    for at in range(len(data)):
        end, left = at, records
        while left and end is not None and end < len(data):
            end, left = plausible(data, end), left - 1
        if end is not None and (not left or end == len(data)):
            return at
    return None


def parse_record(record: bytes) -> tuple[int, int, int, str, str | None] | None:
    """Contig, start, mate start, strand and calls of an alignment; none if it is not placed."""
    ref, start, name_len, _, _, cigars, _, length, _, mate = struct.unpack_from("<iiBBHHHiii", record)
    if ref < 0:
        return None
    found = tags(record, 32 + name_len + 4 * cigars + (length + 1) // 2 + length, len(record))
    return ref, start, mate, (found.get("XO") or " ")[0], found.get("XM")


def records(data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """Whole alignments from ``at`` on, each with the place behind it."""
    while at + 4 <= len(data):
        end = at + 4 + struct.unpack_from("<i", data, at)[0]
        if end > len(data):
            return
        yield data[at + 4 : end], end
        at = end


PART = pa.schema(
    [("src", pa.string()), ("split", pa.int64()), ("idx", pa.int64()), ("ref", pa.int32()), ("start", pa.int64()), ("mpos", pa.int64()), ("strand", pa.string()), ("xm", pa.string())]
    + [("head", pa.binary()), ("tail", pa.binary()), ("n", pa.int64()), ("names", pa.list_(pa.string()))]
)
PART_SCHEMA = "src string, split long, idx long, ref int, start long, mpos long, strand string, xm string, head binary, tail binary, n long, names array<string>"
#: Inflated bytes among which the first alignment of a part is sought.
SEEK_BYTES = 1 << 20


def _part(src: str, split: int, blocks: Iterator[bytes]) -> Iterator[tuple]:
    """Rows of one part of a file: its placed alignments, then one with the bytes before the first and behind the last whole one (``tail`` is null if none begins here), their number, and, at the file's start, the contigs."""
    held, names, head, n, begun = b"", None, b"", 0, False
    at = 0
    for block in blocks:
        held, at = held[at:] + block, 0
        if not begun and len(held) < SEEK_BYTES:
            continue
        if not begun:
            begun, at, names, head = _begin(split, held)
        if begun:
            for record, at in records(held, at):
                if placed := parse_record(record):
                    yield (src, split, n, *placed, None, None, None, None)
                n += 1
    if not begun:
        begun, at, names, head = _begin(split, held)
        if begun:
            for record, at in records(held, at):
                if placed := parse_record(record):
                    yield (src, split, n, *placed, None, None, None, None)
                n += 1
    yield (src, split, None, None, None, None, None, None, head if begun else held, held[at:] if begun else None, n, names)


def _begin(split: int, held: bytes) -> tuple[bool, int, list[str] | None, bytes]:
    if split == 0:
        names, at = parse_header(held)
        return True, at, names, b""
    at = first_record(held)
    return at is not None, at or 0, None, held[:at] if at is not None else b""


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def decode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (``src``, ``split``, ``block``) in order, to rows of PART."""

    def blocks() -> Iterator[tuple[tuple[str, int], bytes]]:
        for batch in batches:
            for src, split, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = block.as_buffer().to_pybytes()
                # what stands before a file's first mark: nothing
                yield (src, split), inflate(data) if data or split else b""

    def rows() -> Iterator[tuple]:
        for (src, split), own in groupby(blocks(), key=lambda x: x[0]):
            yield from _part(src, split, (data for _, data in own))

    yield from _batches(rows(), PART)


def decode_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments that begin in one part and end in a later one: ``pieces`` in order, to rows of PART, the last with their number."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for src, split, n, pieces in zip(*[c.to_pylist() for c in batch.columns]):
                data, end, k = b"".join(p["bytes"] for p in pieces), 0, 0
                for record, end in records(data, 0):
                    if placed := parse_record(record):
                        yield (src, split, n + k, *placed, None, None, None, None)
                    k += 1
                if end != len(data) or split is None and data:
                    raise ValueError(f"{src}: a part begins inside an alignment, or the file ends inside one")
                yield (src, split, None, None, None, None, None, None, None, None, k, None)

    yield from _batches(rows(), PART)


def read_bam(spark: SparkSession, *paths: str, chroms: list[str] | None = None) -> DataFrame:
    """Placed reads of BAM files of any size, like read_sam(); read once, and kept in the shared folder.

    A file is split where its BGZF blocks begin. Each part looks for its first
    alignment by what a chain of alignments looks like. That guess is then
    proved: what the part before leaves over and what lies before the guess must
    be whole alignments, or the plan raises. Alignments that cross a border are
    read from these pieces. Blocks must have the head that the usual writers
    give them (no time, no further fields).
    """
    blocks = spark.read.option("encoding", "ISO-8859-1").option("lineSep", BLOCK_MARK.decode("latin-1")).text(list(paths))
    blocks = blocks.select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("block"))
    path = new_folder(spark, "bam")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BLOCKS_AT_ONCE)
    try:
        blocks.mapInArrow(decode_parts, PART_SCHEMA).write.parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    rows = spark.read.schema(PART_SCHEMA).parquet(path)
    edges = rows.filter("idx IS NULL")  # a row for each part
    before = Window.partitionBy("src").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    numbered = edges.withColumn("border", F.coalesce(F.sum(F.col("tail").isNotNull().cast("long")).over(before), F.lit(0)))
    pieces = numbered.select("src", "border", F.lit(None).cast("long").alias("own"), F.lit(0).cast("long").alias("n"), F.struct("split", F.lit(0).alias("side"), F.col("head").alias("bytes")).alias("piece")).unionByName(
        numbered.filter("tail IS NOT NULL").select("src", (F.col("border") + 1).alias("border"), F.col("split").alias("own"), "n", F.struct("split", F.lit(1).alias("side"), F.col("tail").alias("bytes")).alias("piece"))
    )
    borders = pieces.groupBy("src", "border").agg(F.max("own").alias("split"), F.max("n").alias("n"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    crossing = borders.select("src", "split", "n", "pieces").mapInArrow(decode_borders, PART_SCHEMA)
    kept = f"{path}-borders"
    crossing.write.parquet(kept)
    crossing = spark.read.schema(PART_SCHEMA).parquet(kept)
    counts = edges.select("src", "split", "n").unionByName(crossing.filter("idx IS NULL AND split IS NOT NULL").select("src", "split", "n")).groupBy("src", "split").agg(F.sum("n").alias("n"))
    starts = counts.select("src", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    starts = starts.join(edges.filter("split = 0").select("src", "names"), "src")
    reads = rows.unionByName(crossing).filter("ref IS NOT NULL").drop("names").join(starts, ["src", "split"])
    reads = reads.select("src", (F.col("first") + F.col("idx")).alias("ord"), F.get("names", F.when(F.col("idx").isNotNull(), F.col("ref"))).alias("chrom"), "start", "mpos", "strand", "xm")
    return require_tags(reads, F.col("chrom").isNotNull() if chroms is None else F.col("chrom").isin(chroms))
