"""Interval files, site files, sample sheets, logs and genome catalogs."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.operators.regions import split_name
from methgrid.sources.lines import numbered_lines
from methgrid.sources.shared import read_text, write_text

COMMENT = r"^(track|browser|#)"
#: Attributes that name a GTF feature, the first that is there.
GTF_NAMES = ("ID", "Name", "gene_name", "transcript_id", "gene_id")


def data_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines that are neither comments nor empty, as ``cells``."""
    lines = numbered_lines(spark, *paths).filter(~F.col("value").rlike(COMMENT) & (F.trim("value") != ""))
    return lines.select("src", F.col("line").alias("ord"), "value", F.split("value", "\t").alias("cells"))


def read_bed(spark: SparkSession, *paths: str) -> DataFrame:
    """Intervals: ``chrom``, ``start``, ``end``, ``name`` (empty without a fourth column), ``ord``."""
    cell = lambda k: F.get("cells", F.lit(k))
    return data_lines(spark, *paths).select(cell(0).alias("chrom"), cell(1).cast("long").alias("start"), cell(2).cast("long").alias("end"), F.coalesce(cell(3), F.lit("")).alias("name"), "ord")


def read_gtf(spark: SparkSession, *paths: str, names: tuple[str, ...] = GTF_NAMES) -> DataFrame:
    """GTF features as intervals; their 1-based starts become 0-based."""
    cell = lambda k: F.get("cells", F.lit(k))
    named = [F.nullif(F.regexp_extract(cell(8), rf'(?:^|;)\s*{n}[ =]"?([^";]*)', 1), F.lit("")) for n in names]
    return data_lines(spark, *paths).select(cell(0).alias("chrom"), (cell(3).cast("long") - 1).alias("start"), cell(4).cast("long").alias("end"), F.coalesce(*named, F.lit("")).alias("name"), "ord")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """BED, or GTF by the file's name."""
    return read_gtf(spark, path) if path.removesuffix(".gz").endswith((".gtf", ".gff")) else read_bed(spark, path)


def read_sites(spark: SparkSession, prefixes: dict[str, str]) -> DataFrame:
    """Site files ``{prefix}*.bed`` and ``.bed.gz`` of each sample: ``sample``, ``src``, ``chrom``, ``start``, ``end``, ``perc`` (text), ``total``. The sample of a file is that of the longest prefix that fits."""
    sites = read_site_files(spark, *[f"{p}*.bed*" for p in prefixes.values()])
    sample = F.lit(None).cast("string")
    for name, prefix in sorted(prefixes.items(), key=lambda x: len(x[1])):
        sample = F.when(F.col("src").contains(prefix), name).otherwise(sample)
    return sites.select(sample.alias("sample"), "src", "chrom", "start", "end", "perc", "total")


def read_site_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Site files, or folders of their parts as write_sites() makes them: ``src`` (the file or folder), ``chrom``, ``start``, ``end``, ``perc`` (text), ``total``, and ``part`` and ``ord``, which give the order inside."""
    perc, total = split_name(F.col("name"))
    source = F.regexp_replace("src", r"(\.bed(\.gz)?)/[^/]*$", "$1")
    return read_bed_with_src(spark, *paths).select(source.alias("src"), "chrom", "start", "end", perc.alias("perc"), total.alias("total"), F.col("src").alias("part"), "ord")


def read_bed_with_src(spark: SparkSession, *paths: str) -> DataFrame:
    cell = lambda k: F.get("cells", F.lit(k))
    return data_lines(spark, *paths).select("src", cell(0).alias("chrom"), cell(1).cast("long").alias("start"), cell(2).cast("long").alias("end"), cell(3).alias("name"), "ord")


def sample_files(spark: SparkSession, prefixes: dict[str, str]) -> DataFrame:
    """``sample``, ``chrom`` for every site file, empty ones too; ``*`` listings of the folder."""
    rows = []
    for name, prefix in prefixes.items():
        for f in list_files(spark, f"{prefix}*"):
            chrom = f.rpartition("/")[2].removeprefix(prefix.rpartition("/")[2]).removesuffix(".gz")
            if chrom.endswith(".bed"):
                rows.append((name, chrom.removesuffix(".bed")))
    return spark.createDataFrame(sorted(set(rows)), "sample string, chrom string")


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern fits, sorted, in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [])


def read_sample_sheet(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and prefixes in the sheet's order; lines of fewer than two fields are left out. A sheet is short."""
    rows = numbered_lines(spark, path).orderBy("line").collect()
    cells = [r["value"].rstrip().split("\t") for r in rows]
    return {c[0]: c[1] for c in cells if len(c) >= 2}


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``chrom``, ``length``, ``ord``."""
    return data_lines(spark, path).select(F.get("cells", F.lit(0)).alias("chrom"), F.get("cells", F.lit(1)).cast("long").alias("length"), "ord")


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of aligner logs: ``src``, ``value``."""
    return numbered_lines(spark, *paths).select("src", "value")


def read_catalog(spark: SparkSession, path: str) -> dict:
    """The genome catalog of a YAML file."""
    return yaml.safe_load(read_text(spark, path)) or {}


def write_catalog(spark: SparkSession, catalog: dict, path: str) -> None:
    write_text(spark, path, yaml.safe_dump(catalog, sort_keys=False))


def catalog_chroms(spark: SparkSession, catalog: dict, genome: str) -> DataFrame:
    """``chrom``, ``length``, ``ord`` of a genome; names may be numbers in YAML."""
    rows = [(str(c), int(n), k) for k, (c, n) in enumerate(catalog[genome]["chroms"].items())]
    return spark.createDataFrame(rows, "chrom string, length long, ord long")
