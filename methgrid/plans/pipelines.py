"""Whole runs, from reads to sites, around an aligner that the caller supplies."""

from __future__ import annotations

import shlex
import shutil
import subprocess
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.operators import convert, fastq, pileup
from methgrid.sources.alignments import read_sam, sam_reads
from methgrid.sources.fastq import FIELDS, read_fastq, write_fastq
from methgrid.sources.shared import new_folder
from methgrid.sources.tables import list_files

#: Takes trimmed reads of one route and gives aligned reads (see methgrid.operators.pileup).
Aligner = Callable[[DataFrame], DataFrame]


@dataclass
class Run:
    """What a run gives: trimmed reads, aligned reads of both routes in one order, sites, and the control's conversion efficiency."""

    trimmed: DataFrame
    aligned: DataFrame
    sites: DataFrame
    conversion: DataFrame


def finish(trimmed: DataFrame, align: Aligner, context: str, strand: str, max_dup: int, conv_chrom: str) -> Run:
    routes = pileup.merge(*[align(trimmed.filter(trimmed["route"] == route)) for route in ("noadap", "trimmed")])
    # both routes have their own numbers: part and number together tell the order inside a start
    numbered = routes.withColumn("ord", F.col("ord") * 2 + F.col("part")).drop("part")
    piled = pileup.pileup(numbered, context, strand, max_dup, sorted_by_start=True)
    rendered = pileup.render(piled)
    sites = rendered.select("chrom", "start", "end", F.element_at(F.split("name", "-"), 1).alias("perc"), F.element_at(F.split("name", "-"), 2).cast("long").alias("total"))
    return Run(trimmed, numbered.orderBy("chrom", "start", "ord"), rendered, convert.conversion_efficiency(sites, conv_chrom))


def process_se(spark: SparkSession, path: str, align: Aligner, adapter: str = fastq.ADAPTER, chew: int = 10, min_read: int = 35, context: str = "CG", strand: str = "both", max_dup: int = 1, conv_chrom: str = "chrM") -> Run:
    """Single-end reads: filter, trim, align each route, merge, pile up."""
    pileup.check_arguments(context, strand)
    trimmed = fastq.trim_se(fastq.quality_filter(read_fastq(spark, path)), adapter, chew, min_read)
    return finish(trimmed, align, context, strand, max_dup, conv_chrom)


def process_pe(
    spark: SparkSession, forward: str, reverse: str, align: Aligner, forward_adapter: str = fastq.ADAPTER, reverse_adapter: str = fastq.ADAPTER, chew: int = 10, min_read: int = 35, context: str = "CG", strand: str = "both", max_dup: int = 1, conv_chrom: str = "chrM"
) -> Run:
    """Paired-end reads, paired by their number in the files."""
    pileup.check_arguments(context, strand)
    trimmed = fastq.trim_pe(read_fastq(spark, forward), read_fastq(spark, reverse), forward_adapter, reverse_adapter, chew, min_read)
    return finish(trimmed, align, context, strand, max_dup, conv_chrom)


class external_aligner:
    """An aligner that is run as a program, once for each route: ``command`` has ``{fastq}``, ``{sam}`` and, if it writes one, ``{log}``; ``folder`` is one that the driver and all executors share. ``logs`` are the logs of the routes, in their order."""

    def __init__(self, spark: SparkSession, command: str, folder: str):
        self.spark, self.command, self.folder, self.logs = spark, command, folder, []

    def __call__(self, reads: DataFrame) -> DataFrame:
        base = f"{self.folder}/{uuid4().hex}"
        write_fastq(reads, f"{base}.parts")
        # the program wants one file: the parts, in their names' order
        parts = list_files(self.spark, f"{base}.parts/part-*")
        with open(f"{base}.fq", "wb") as out:
            for part in parts:
                with open(part.removeprefix("file:"), "rb") as f:
                    shutil.copyfileobj(f, out)
        names = {"fastq": f"{base}.fq", "sam": f"{base}.sam", "log": f"{base}.log"}
        subprocess.run(self.command.format(**{k: shlex.quote(v) for k, v in names.items()}), shell=True, check=True)
        if "{log}" in self.command:
            self.logs.append(names["log"])
        return read_sam(self.spark, names["sam"]).drop("src")


class piped_aligner:
    """An aligner that reads FASTQ from its input and writes SAM to its output, one process for each partition, on the executors: no file holds all reads. It must align every read apart from the others; the headers that each process writes are left out."""

    def __init__(self, spark: SparkSession, command: str):
        self.spark, self.command, self.logs = spark, command, []

    def __call__(self, reads: DataFrame) -> DataFrame:
        command = self.command

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # the input goes in from a thread, so that neither side waits for a full pipe
            program = subprocess.Popen(command, shell=True, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
            failed: list[BaseException] = []

            def feed() -> None:
                try:
                    with program.stdin as to:
                        for batch in batches:
                            for record in batch.column(0):
                                to.write(record.as_py().encode() + b"\n")
                except BaseException as e:  # raised again below
                    failed.append(e)

            feeder = threading.Thread(target=feed)
            feeder.start()
            lines: list[str] = []
            try:
                for line in program.stdout:
                    if not line.startswith(b"@"):
                        lines.append(line.decode().rstrip("\r\n"))
                    if len(lines) == 10_000:
                        yield pa.RecordBatch.from_pydict({"value": lines})
                        lines = []
                code = program.wait()
            finally:
                program.kill()  # no harm where it has ended; else feed() stops at the closed pipe
            feeder.join()
            if code:
                raise RuntimeError(f"the aligner ended with {code}")
            if failed:
                raise failed[0]
            if lines:
                yield pa.RecordBatch.from_pydict({"value": lines})

        ordered = reads.repartitionByRange("ord").sortWithinPartitions("ord").select(F.concat_ws("\n", *FIELDS).alias("value"))
        path = new_folder(self.spark, "aligned")  # aligned once, however often the reads are used
        ordered.mapInArrow(run, "value string").withColumn("ord", F.monotonically_increasing_id()).write.parquet(path)
        return sam_reads(self.spark.read.parquet(path))
