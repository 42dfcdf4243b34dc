"""Commands over files: ``python -m methgrid.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.operators import convert, fastq, genome, logs, motif, pileup, regions, tabular
from methgrid.plans import pipelines
from methgrid.sources import alignments, sinks, tables
from methgrid.sources.fastq import read_fastq, write_fastq
from methgrid.sources.shared import read_text


def session() -> SparkSession:
    return SparkSession.builder.appName("methgrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def chroms_of(spark: SparkSession, args):
    return tables.catalog_chroms(spark, tables.read_catalog(spark, args.infoyaml), args.genome)


def bam2pm(spark: SparkSession, args) -> None:
    read = alignments.read_bam if args.in_bam.endswith(".bam") else alignments.read_sam
    chroms = chroms_of(spark, args)
    reads = read(spark, args.in_bam, chroms=[r["chrom"] for r in chroms.select("chrom").collect()])
    prefix = args.bed_prefix if args.bed_prefix.endswith("_") else args.bed_prefix + "_"
    # BAM files that are read by contig are sorted, so duplicates can be sought start by start
    rendered = pileup.render(pileup.pileup(reads, args.methtype, args.strand, args.max_dup_reads, sorted_by_start=args.in_bam.endswith(".bam")))
    sinks.write_sites(rendered, chroms, prefix, args.header or prefix.rpartition("/")[2], args.genome)


def _sites_and_samples(spark: SparkSession, args):
    prefixes = tables.read_sample_sheet(spark, args.input_tsv)
    return tables.read_sites(spark, prefixes), list(prefixes), tables.sample_files(spark, prefixes), tables.read_intervals(spark, args.mask) if args.mask else None


def roi(spark: SparkSession, args) -> None:
    sites, samples, files, masked = _sites_and_samples(spark, args)
    areas = tables.read_intervals(spark, args.roi_file)
    for raw, path in ((False, args.out_table), (True, args.raw_data)):
        if path:
            sinks.write_table(regions.roi_meth(sites, areas, samples, masked, files, args.min_reads, args.min_cpgs, args.min_samples, raw), path, decimals=3)


def window(spark: SparkSession, args) -> None:
    sites, samples, files, masked = _sites_and_samples(spark, args)
    for raw, path in ((False, args.out_table), (True, args.raw_data)):
        if path:
            table = regions.window_meth(sites, chroms_of(spark, args), samples, args.window_size, masked, files, args.min_reads, args.min_cpgs, args.min_samples, raw)
            sinks.write_table(table, path, decimals=3)


def _each_file(spark: SparkSession, args):
    for path in [*tables.list_files(spark, f"{args.in_prefix}*.bed"), *tables.list_files(spark, f"{args.in_prefix}*.bed.gz")]:
        name = path.rpartition("/")[2].removesuffix(".gz").removesuffix(".bed").removeprefix(args.in_prefix.rpartition("/")[2])
        # in the order of the file
        yield name, tables.read_site_files(spark, path).repartitionByRange("part", "ord").sortWithinPartitions("part", "ord")


def pm2dss(spark: SparkSession, args) -> None:
    for name, sites in _each_file(spark, args):
        sinks.write_table(convert.to_dss(sites), f"{args.out_prefix}{name}.dss", gz=args.gz)


def pm2bg(spark: SparkSession, args) -> None:
    for name, sites in _each_file(spark, args):
        sinks.write_table(convert.to_bedgraph(sites), f"{args.out_prefix}{name}.bg", header=False, gz=args.gz)


def pm_stats(spark: SparkSession, args) -> None:
    files = tables.read_site_files(spark, f"{args.in_prefix}*{args.suffix}")
    start = args.in_prefix.rpartition("/")[2]
    rows = convert.stats(files, ["src"]).orderBy("src").collect()  # a row for each file
    shown = [[r["src"].rpartition("/")[2].removeprefix(start).removesuffix(args.suffix), r["perc"], r["meth"], r["total"], r["cpgs"]] for r in rows]
    sinks.small_table(spark, shown, ["name", "percentage", "methylated_reads", "total_reads", "cpg_count"], args.out_file)


def add_genome(spark: SparkSession, args) -> None:
    catalog = tables.read_catalog(spark, args.infoyaml)
    sizes = tables.read_chrom_sizes(spark, args.sizes)
    tables.write_catalog(spark, genome.add_genome(catalog, args.genome, args.fasta, args.index, sizes, args.main, args.force), args.infoyaml)


def motif_command(spark: SparkSession, args) -> None:
    files = [(args.in_file, args.in_file.rpartition("/")[2])]
    if args.table:
        files = [(path, name) for path, name in tables.read_sample_sheet(spark, args.in_file).items()]
    n = args.seq.upper().count("Y")
    rows = [[name, *motif.motif_summary(read_fastq(spark, path), args.seq).first()] for path, name in files]
    header = ["Name", "Avg_Total", *[f"Avg_CpG_{k}" for k in range(1, n + 1)], *[x for k in range(1, n + 1) for x in (f"CpG_meth_{k}", f"CpG_total_{k}")]]
    sinks.small_table(spark, rows, header, args.out_table)


def trim_sefq(spark: SparkSession, args) -> None:
    write_fastq(fastq.trim_se(fastq.quality_filter(read_fastq(spark, args.in_fastq)), args.adapter, args.chew, args.min_read), args.out_prefix, gz=True, by="route")


def trim_pefq(spark: SparkSession, args) -> None:
    pairs = fastq.trim_pe(read_fastq(spark, args.in_for), read_fastq(spark, args.in_rev), args.for_adap, args.rev_adap, args.chew, args.min_read)
    for side, label in (("f", "for"), ("r", "rev")):
        own = pairs.select("ord", "route", *[F.col(f"{side}_{c}").alias(c) for c in ("header", "seq", "third", "qual")])
        write_fastq(own, f"{args.out_prefix}_{label}", gz=True, by="route")


def _summary(spark: SparkSession, noadap: str, trimmed: str, conversion: DataFrame | None, path: str) -> None:
    """Two lines of heads and one of values: the metrics of both runs, then the columns of ``conversion``."""
    table = logs.summarize_logs(tables.read_log(spark, noadap), tables.read_log(spark, trimmed), conversion)
    heads = ["Total bases of uniquely mapped reads", "", "Mappability", "", "mCG", "", "mCHG", "", "mCHH", *([""] + conversion.columns if conversion is not None else [])]
    sinks.small_table(spark, [["noadap", "trimmed"] * 5, list(table.first())], heads, path)


def _process(spark: SparkSession, args, align: pipelines.Aligner, run: pipelines.Run) -> None:
    """Sites, the control's conversion, and the summary of the aligner's logs where the command names its {log}."""
    sinks.write_sites(run.sites, chroms_of(spark, args), f"{args.out_prefix}_", args.out_prefix.rpartition("/")[2] + "_", args.genome)
    conversion = spark.createDataFrame(run.conversion.collect(), run.conversion.schema)  # one row
    sinks.small_table(spark, [list(r) for r in conversion.collect()], conversion.columns, f"{args.out_prefix}_conv.txt")
    if align.logs:
        _summary(spark, *align.logs, conversion, f"{args.out_prefix}_summary.txt")


def aligner_of(spark: SparkSession, args) -> pipelines.Aligner:
    """A command that names its {fastq} and {sam} files runs once a route; any other reads its input and writes its output on the executors."""
    return pipelines.external_aligner(spark, args.aligner, args.shared) if "{fastq}" in args.aligner else pipelines.piped_aligner(spark, args.aligner)


def process_se(spark: SparkSession, args) -> None:
    align = aligner_of(spark, args)
    _process(spark, args, align, pipelines.process_se(spark, args.in_fastq, align, args.adapter, args.chew, args.min_read, args.methtype, args.strand, args.max_dup_reads, args.conv_chr))


def process_pe(spark: SparkSession, args) -> None:
    align = aligner_of(spark, args)
    _process(spark, args, align, pipelines.process_pe(spark, args.in_for, args.in_rev, align, args.for_adap, args.rev_adap, args.chew, args.min_read, args.methtype, args.strand, args.max_dup_reads, args.conv_chr))


def sumlogs(spark: SparkSession, args) -> None:
    conv = None
    if args.conv:
        lines = [x.split("\t") for x in read_text(spark, args.conv).splitlines()[:2]]
        conv = spark.createDataFrame([tuple(lines[1])], ", ".join(f"`{c}` string" for c in lines[0]))
    _summary(spark, args.noadap_log, args.adaptrim_log, conv, args.out)


def adjustcols(spark: SparkSession, args) -> None:
    from methgrid.sources.lines import numbered_lines

    for path in tables.list_files(spark, f"{args.in_prefix}*{args.suffix}"):
        lines = numbered_lines(spark, path)
        header = (F.col("line") == 0) if args.header else None
        done = tabular.adjust_columns(lines, [int(x) for x in args.cols.split(",")], [int(x) for x in args.adjusts.split(",")], header)
        name = path.rpartition("/")[2].removeprefix(args.in_prefix.rpartition("/")[2])
        done.repartitionByRange("line").sortWithinPartitions("line").select("value").write.text(f"{args.out_prefix}{name}")


COMMON = {"--genome": "hg38", "--infoyaml": "info.yaml"}
GATES = {"--mask": "", "--raw-data": "", "--min-reads": 1, "--min-samples": -1}
CALLS = {"--methtype": "CG", "--strand": "both", "--max-dup-reads": 1}
TRIM = {"--chew": 10, "--min-read": 35}
ALIGN = {"--aligner": "", "--shared": "", "--conv-chr": "chrM"}
#: Each command's function, its arguments, and its options with their defaults.
COMMANDS = {
    "bam2pm": (bam2pm, ["in_bam", "bed_prefix"], COMMON | CALLS | {"--header": ""}),
    "roi": (roi, ["input_tsv", "out_table", "roi_file"], GATES | {"--min-cpgs": 10}),
    "window": (window, ["input_tsv", "out_table"], COMMON | GATES | {"--min-cpgs": 20, "--window-size": 20000}),
    "pm2dss": (pm2dss, ["in_prefix", "out_prefix"], {"--gz": False}),
    "pm2bg": (pm2bg, ["in_prefix", "out_prefix"], {"--gz": False}),
    "pm_stats": (pm_stats, ["in_prefix", "out_file"], {"--suffix": ".bed.gz"}),
    "add_genome": (add_genome, ["genome", "fasta", "index"], {"--sizes": "", "--infoyaml": "info.yaml", "--force": False, "--main": False}),
    "motif": (motif_command, ["in_file", "out_table"], {"--seq": motif.LINE1, "--table": False}),
    "process_se": (process_se, ["in_fastq", "out_prefix"], COMMON | CALLS | TRIM | ALIGN | {"--adapter": fastq.ADAPTER}),
    "process_pe": (process_pe, ["in_for", "in_rev", "out_prefix"], COMMON | CALLS | TRIM | ALIGN | {"--for-adap": fastq.ADAPTER, "--rev-adap": fastq.ADAPTER}),
    "sumlogs": (sumlogs, ["noadap_log", "adaptrim_log", "out"], {"--conv": ""}),
    "adjustcols": (adjustcols, ["in_prefix", "out_prefix"], {"--suffix": "", "--cols": "2", "--adjusts": "1", "--no-header": True}),
    "trim_sefq": (trim_sefq, ["in_fastq", "out_prefix"], TRIM | {"--adapter": fastq.ADAPTER}),
    "trim_pefq": (trim_pefq, ["in_for", "in_rev", "out_prefix"], TRIM | {"--for-adap": fastq.ADAPTER, "--rev-adap": fastq.ADAPTER}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="methgrid", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (run, arguments, options) in COMMANDS.items():
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        for a in arguments:
            own.add_argument(a)
        for option, default in options.items():
            if option == "--no-header":
                own.add_argument(option, dest="header", action="store_false")
            elif isinstance(default, bool):
                own.add_argument(option, action="store_true")
            else:
                own.add_argument(option, default=default, type=type(default))
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(session(), args)


if __name__ == "__main__":
    main(sys.argv[1:])
