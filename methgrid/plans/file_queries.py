"""Queries through files: the driver's tables are written in the formats of the domain, by a writer or a command, and read back.

The files lie in the folder that all executors share (see
methgrid.sources.shared); a result reads them when it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid import cli
from methgrid.operators import convert, genome, logs, pileup
from methgrid.plans.queries import _CONV, _LOG, _METH, _ROIS, _SAMPLES, _WINDOWS, PASSED_SQL, _counts, _piled, _wide, query
from methgrid.plans.views import SAMPLES, WINDOW
from methgrid.sources import alignments, sinks, tables
from methgrid.sources import fastq as fastq_files
from methgrid.sources.shared import new_folder

View = Callable[[str], DataFrame]


def write_lines(df: DataFrame, value: Column, path: str) -> str:
    df.select(value.alias("value")).write.text(path)
    return path


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths))


def command(spark: SparkSession, *argv: str) -> None:
    """A command of the package, in the session at hand."""
    args = cli.parser().parse_args(list(argv))
    args.run(spark, args)


def written_sites(v: View) -> tuple[str, dict[str, str]]:
    """The sites of all samples as site files, and the samples' prefixes."""
    sites, chroms = v("sites"), v("chroms")
    at = new_folder(sites.sparkSession)
    zero = F.lit(0).cast("long")
    rendered = sites.select("sample", "chrom", "start", "end", F.concat("perc", F.lit("-"), F.col("total").cast("string")).alias("name"), zero.alias("score"), F.lit("+").alias("strand"), zero.alias("thick_start"), zero.alias("thick_end"), F.lit(pileup.BLACK).alias("rgb"))
    for s in SAMPLES:
        sinks.write_sites(rendered.filter(F.col("sample") == s).drop("sample"), chroms, f"{at}/{s}_", f"{s}_", "hg")
    return at, {s: f"{at}/{s}_" for s in SAMPLES}


def sheet(v: View, at: str, prefixes: dict[str, str]) -> str:
    spark = v("sites").sparkSession
    return write_lines(spark.createDataFrame([(f"{s}\t{p}",) for s, p in prefixes.items()], "value string").coalesce(1), F.col("value"), f"{at}/samples")


def catalog(v: View, at: str) -> str:
    sinks.write_text(v("chroms").sparkSession, f"{at}/info.yaml", "{}")
    sizes = write_lines(v("chroms").orderBy("ord").coalesce(1), F.concat_ws("\t", "chrom", "length"), f"{at}/sizes")
    command(v("chroms").sparkSession, "add_genome", "hg", "hg.fa", "hg.idx", "--sizes", sizes, "--infoyaml", f"{at}/info.yaml")
    return f"{at}/info.yaml"


# --- sources and writers


@query("SELECT header, seq, third, qual FROM fastq", "fastq")
def file_fastq(v):
    at = new_folder(v("fastq").sparkSession)
    fastq_files.write_fastq(v("fastq").select("ord", *fastq_files.FIELDS), at, gz=True)
    return fastq_files.read_fastq(v("fastq").sparkSession, at).select(*fastq_files.FIELDS)


@query("SELECT concat('r', ord) AS name, chrom, start, mpos, strand, xm FROM reads WHERE ord % 10 <> 0", "reads")
def file_sam(v):
    """One read in ten is not placed, and is not read."""
    reads, lost = v("reads"), F.col("ord") % 10 == 0
    name = F.concat(F.lit("r"), F.col("ord").cast("string"))
    place = [F.when(lost, "*").otherwise(F.col("chrom")), F.when(lost, 0).otherwise(F.col("start") + 1)]
    line = F.concat_ws("\t", name, F.lit("0"), *place, F.lit("255"), F.lit("64M"), F.lit("*"), F.col("mpos") + 1, F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("XO:Z:"), "strand", F.lit("FW")), F.concat(F.lit("XM:Z:"), "xm"), F.concat(F.lit("RN:Z:"), name))
    at = write_lines(reads, line, new_folder(reads.sparkSession))
    lines = read_lines(reads.sparkSession, at).select("value", F.regexp_extract("value", r"\tRN:Z:([^\t]*)", 1).alias("name"))
    return alignments.sam_reads(lines).select("name", "chrom", "start", "mpos", "strand", "xm")


@query('SELECT sample, chrom, start, "end", perc, total FROM sites', "sites")
def file_sites(v):
    _, prefixes = written_sites(v)
    return tables.read_sites(v("sites").sparkSession, prefixes).select("sample", "chrom", "start", "end", "perc", "total")


@query(f"SELECT g.sample, chrom FROM chroms CROSS JOIN {_SAMPLES}", "chroms")
def file_listing(v):
    """Listing of the site files; one for each sample and chromosome."""
    _, prefixes = written_sites(v)
    return tables.sample_files(v("sites").sparkSession, prefixes)


@query("""SELECT chrom, start, "end", CASE WHEN ord % 2 = 0 THEN name ELSE '' END AS name FROM roi""", "roi")
def file_bed(v):
    """Three and four columns, and comments between."""
    roi = v("roi")
    own = F.concat_ws("\t", "chrom", "start", "end", F.when(F.col("ord") % 2 == 0, F.col("name")))
    at = write_lines(roi, F.when(F.col("ord") % 7 == 0, F.concat(F.lit("#comment\n"), own)).otherwise(own), f"{new_folder(roi.sparkSession)}.bed")
    return tables.read_intervals(roi.sparkSession, at).select("chrom", "start", "end", "name")


@query('SELECT chrom, start, "end", name FROM roi', "roi")
def file_gtf(v):
    roi = v("roi")
    cells = ["chrom", F.lit("s"), F.lit("gene"), F.col("start") + 1, "end", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit('gene_id "'), "name", F.lit('";'))]
    at = write_lines(roi, F.concat_ws("\t", *cells), f"{new_folder(roi.sparkSession)}.gtf")
    return tables.read_intervals(roi.sparkSession, at).select("chrom", "start", "end", "name")


@query("SELECT n_name AS sample, concat('p', n_nationkey) AS prefix FROM nation WHERE n_nationkey % 4 <> 0")
def file_sample_sheet(v):
    """Lines of one field are left out."""
    nation = v("nation")
    at = write_lines(nation.coalesce(1), F.concat_ws("\t", "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("p"), F.col("n_nationkey").cast("string")))), new_folder(nation.sparkSession))
    return nation.sparkSession.createDataFrame(list(tables.read_sample_sheet(nation.sparkSession, at).items()), "sample string, prefix string")


@query(r"SELECT chrom, length::BIGINT AS length FROM sizes WHERE chrom NOT LIKE '%\_%' ESCAPE '\'", "sizes")
def file_catalog(v):
    """Chromosome sizes into a catalog in YAML, and out of it."""
    sizes = v("sizes")
    spark, at = sizes.sparkSession, new_folder(sizes.sparkSession)
    held = tables.read_chrom_sizes(spark, write_lines(sizes, F.concat_ws("\t", "chrom", "length"), f"{at}/sizes"))
    tables.write_catalog(spark, genome.add_genome({}, "hg", "hg.fa", "hg.idx", held, main=True), f"{at}/info.yaml")
    return tables.catalog_chroms(spark, tables.read_catalog(spark, f"{at}/info.yaml"), "hg").select("chrom", "length")


@query("SELECT chrom, length::BIGINT AS length FROM sizes", "sizes")
def file_chrom_sizes(v):
    sizes = v("sizes")
    at = write_lines(sizes, F.concat_ws("\t", "chrom", "length"), new_folder(sizes.sparkSession))
    return tables.read_chrom_sizes(sizes.sparkSession, at).select("chrom", "length")


def written_logs(v: View) -> list[str]:
    lines = v("logs")
    return [write_lines(lines.filter(F.col("run") == r), F.col("value"), new_folder(lines.sparkSession)) for r in ("noadap", "trimmed")]


@query(f"SELECT {_LOG} FROM logs", "logs")
def file_logs(v):
    spark = v("logs").sparkSession
    return logs.summarize_logs(*[tables.read_log(spark, p) for p in written_logs(v)])


# --- commands


def _lines_sql(cells: list[str], wide: str) -> str:
    return f"SELECT concat_ws(chr(9), {', '.join(cells)}) AS line FROM ({wide})"


_PLACE = ["chrom", "start", '"end"', "name"]
_SHARES = [f"CASE WHEN {s} IS NULL THEN 'NA' ELSE printf('%.3f', {s}) END" for s in SAMPLES]
_RAW = [f"{s}_{n}" for s in SAMPLES for n in ("methylated", "total", "cpgs")]
_PM0 = "(SELECT * FROM sites WHERE sample = 'pm0')"


def table_lines(spark: SparkSession, path: str, head: str = "chrom\t") -> DataFrame:
    return read_lines(spark, path).filter(~F.col("value").startswith(head)).select(F.col("value").alias("line"))


@query(_lines_sql(_PLACE + _SHARES, _wide(_counts(_ROIS), 2, 1)), "sites", "roi")
def command_roi(v):
    """Every sample has a file for every chromosome, so all regions count."""
    at, prefixes = written_sites(v)
    spark, roi = v("sites").sparkSession, v("roi")
    areas = write_lines(roi, F.concat_ws("\t", "chrom", "start", "end", "name"), f"{at}/roi.bed")
    command(spark, "roi", sheet(v, at, prefixes), f"{at}/out", areas, "--min-cpgs", "2", "--min-samples", "1")
    return table_lines(spark, f"{at}/out")


@query(_lines_sql(_PLACE + _RAW, _wide(_counts(_WINDOWS), 20, 3, raw=True)), "sites", "chroms")
def command_window(v):
    at, prefixes = written_sites(v)
    spark = v("sites").sparkSession
    command(spark, "window", sheet(v, at, prefixes), f"{at}/out", "--genome", "hg", "--infoyaml", catalog(v, at), "--window-size", str(WINDOW), "--raw-data", f"{at}/raw")
    return table_lines(spark, f"{at}/raw")


@query(_lines_sql(["chrom", "start", "total", _METH], _PM0), "sites")
def command_pm2dss(v):
    at, prefixes = written_sites(v)
    spark = v("sites").sparkSession
    command(spark, "pm2dss", prefixes["pm0"], f"{at}/d_", "--gz")
    return table_lines(spark, f"{at}/d_*.dss", "chr\t")


@query(_lines_sql(["chrom", "start", "start + 1", "perc"], _PM0), "sites")
def command_pm2bg(v):
    at, prefixes = written_sites(v)
    spark = v("sites").sparkSession
    command(spark, "pm2bg", prefixes["pm0"], f"{at}/d_")
    return table_lines(spark, f"{at}/d_*.bg")


@query(f"SELECT concat_ws(chr(9), chrom, sum({_METH})::BIGINT, sum(total)::BIGINT, count(*)) AS line FROM {_PM0} GROUP BY chrom", "sites")
def command_pm_stats(v):
    """The share is left to pm_stats, whose digits no text cuts."""
    at, prefixes = written_sites(v)
    spark = v("sites").sparkSession
    command(spark, "pm_stats", prefixes["pm0"], f"{at}/stats")
    cells = F.split("line", "\t")
    return table_lines(spark, f"{at}/stats", "name\t").select(F.concat_ws("\t", cells[0], cells[2], cells[3], cells[4]).alias("line"))


@query(f"SELECT chrom, pos AS start, pos + 1 AS \"end\", printf('%.2f', meth / total) AS perc, total FROM {_piled('CHG', 'positive', 1_000_000_000)}", "reads")
def command_bam2pm(v):
    """SAM text to sites; no duplicate goes, as the order of several files is none."""
    reads = v("reads")
    spark, at = reads.sparkSession, new_folder(reads.sparkSession)
    line = F.concat_ws("\t", F.lit("r"), F.lit("0"), "chrom", F.col("start") + 1, F.lit("255"), F.lit("64M"), F.lit("*"), F.col("mpos") + 1, F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("XO:Z:"), "strand"), F.concat(F.lit("XM:Z:"), "xm"))
    write_lines(reads, line, f"{at}/a.sam")
    command(spark, "bam2pm", f"{at}/a.sam", f"{at}/s", "--genome", "hg", "--infoyaml", catalog(v, at), "--methtype", "CHG", "--strand", "positive", "--max-dup-reads", "1000000000")
    return tables.read_sites(spark, {"s": f"{at}/s_"}).select("chrom", "start", "end", "perc", "total")


@query(f"SELECT concat_ws(chr(9), {', '.join(f"coalesce({n}_{r}, 'NA')" for n, _, _ in logs.METRICS for r in ('noadap', 'trimmed'))}, meth, total, cpg_count) AS line FROM (SELECT {_LOG} FROM logs), {_CONV}", "logs", "sites")
def command_sumlogs(v):
    """The summary with the control's counts."""
    spark, at = v("logs").sparkSession, new_folder(v("logs").sparkSession)
    row = convert.conversion_efficiency(v("sites"), "chr0").select("meth", "total", "cpg_count").first()
    sinks.small_table(spark, [list(row)], ["meth", "total", "cpg_count"], f"{at}/conv")
    command(spark, "sumlogs", *written_logs(v), f"{at}/out", "--conv", f"{at}/conv")
    return read_lines(spark, f"{at}/out").filter(~F.col("value").rlike("^(Total bases|noadap\t)")).select(F.col("value").alias("line"))


@query(
    "SELECT CASE WHEN value LIKE 'track%' THEN value ELSE array_to_string(list_transform(string_split(value, chr(9)), lambda x, i: CASE WHEN i = 2 THEN cast(cast(x AS BIGINT) + 5 AS VARCHAR) ELSE x END), chr(9)) END AS line FROM lines WHERE value NOT LIKE 'track%'",
    "lines",
)
def command_adjustcols(v):
    lines = v("lines").filter(~F.col("value").startswith("track"))
    spark, at = lines.sparkSession, new_folder(lines.sparkSession)
    write_lines(lines, F.col("value"), f"{at}/in_1")
    command(spark, "adjustcols", f"{at}/in_", f"{at}/out_", "--cols", "1", "--adjusts", "5", "--no-header")
    return read_lines(spark, f"{at}/out_1").select(F.col("value").alias("line"))


@query(f"SELECT header, substr(seq, 1, greatest(length(seq) - 10, 0)) AS seq, substr(qual, 1, greatest(length(qual) - 10, 0)) AS qual FROM fastq WHERE strpos(seq, 'AGATCGGAAG') = 0 AND {PASSED_SQL}", "fastq")
def command_trim_sefq(v):
    reads = v("fastq")
    spark, at = reads.sparkSession, new_folder(reads.sparkSession)
    fastq_files.write_fastq(reads.select("ord", *fastq_files.FIELDS), f"{at}/in")
    command(spark, "trim_sefq", f"{at}/in", f"{at}/out")
    return fastq_files.read_fastq(spark, f"{at}/out/route=noadap").select("header", "seq", "qual")


_CUT = "least(CASE WHEN strpos(f.seq, 'AGATCGGAAG') > 0 THEN strpos(f.seq, 'AGATCGGAAG') - 1 ELSE length(f.seq) END, CASE WHEN strpos(r.seq, 'AGATCGGAAG') > 0 THEN strpos(r.seq, 'AGATCGGAAG') - 1 ELSE length(r.seq) END)"


@query(
    f"""SELECT header, substr(seq, 1, cut - 10) AS seq, substr(qual, 1, cut - 10) AS qual FROM (SELECT r.header, r.seq, r.qual, length(f.seq) AS n, {_CUT} AS cut FROM fastq f JOIN fastq_r r ON f.ord = r.ord
        WHERE NOT regexp_matches(f.header, '^@.* [^:]*:Y:[^:]*:') AND NOT regexp_matches(r.header, '^@.* [^:]*:Y:[^:]*:')) WHERE cut <> n AND cut - 10 >= 35""",
    "fastq",
    "fastq_r",
)
def command_trim_pefq(v):
    """The reverse reads whose pair has an adapter. Two folders of one order, each read like one file."""
    spark, at = v("fastq").sparkSession, new_folder(v("fastq").sparkSession)
    sides = [f"{at}/{name}" for name in ("fastq", "fastq_r")]
    for name, side in zip(("fastq", "fastq_r"), sides, strict=True):
        fastq_files.write_fastq(v(name).select("ord", *fastq_files.FIELDS), side)
    command(spark, "trim_pefq", *sides, f"{at}/out")
    return fastq_files.read_fastq(spark, f"{at}/out_rev/route=trimmed").select("header", "seq", "qual")


@query(r"SELECT concat_ws(chr(9), 'all', count(*) FILTER (h LIKE 'AC%'), count(*)) AS line FROM (SELECT regexp_extract(seq, 'A[CT]G') AS h FROM fastq WHERE regexp_matches(seq, 'A[CT]G'))", "fastq")
def command_motif(v):
    """A sheet of one file; the counts of its only site."""
    reads = v("fastq")
    spark, at = reads.sparkSession, new_folder(reads.sparkSession)
    fastq_files.write_fastq(reads.select("ord", *fastq_files.FIELDS), f"{at}/in")
    sinks.write_text(spark, f"{at}/sheet", f"{at}/in\tall\n")
    command(spark, "motif", f"{at}/sheet", f"{at}/out", "--seq", "AYG", "--table")
    cells = F.split("line", "\t")
    return table_lines(spark, f"{at}/out", "Name\t").select(F.concat_ws("\t", cells[0], cells[3], cells[4]).alias("line"))
