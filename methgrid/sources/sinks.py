"""Writers of the domain's text formats. Every writer makes a folder of part files, as executors write side by side."""

from __future__ import annotations

from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.sources.shared import write_text


def write_table(df: DataFrame, path: str, header: bool = True, missing: str = "NA", gz: bool = False, decimals: int | None = None) -> None:
    """Tab-separated text; nulls as ``missing``, fractions to ``decimals`` if given."""
    cells = [F.format_number(c, decimals).alias(c) if decimals is not None and t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cells).write.option("sep", "\t").option("header", header).option("nullValue", missing).option("emptyValue", "").option("quote", "").option("compression", "gzip" if gz else "none").csv(path)


def track_line(prefix: str, genome: str) -> Column:
    name = F.concat(F.lit(prefix), F.col("chrom"))
    return F.concat(F.lit("track name="), name, F.lit(" description="), name, F.lit(f" useScore=0 itemRgb=On db={genome}"))


def write_sites(rendered: DataFrame, chroms: DataFrame, path: str, prefix: str, genome: str, gz: bool = True) -> None:
    """Rendered sites as BED text, a folder ``{path}{chrom}.bed.gz`` (or ``.bed``) for each chromosome of ``chroms``, each led by its track line, also where there is no site. A chromosome is dealt over several files, in order of the position. The readers of site files take such folders as files."""
    columns = ["chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "rgb"]
    body = rendered.select("chrom", F.col("start").alias("at"), F.concat_ws("\t", *columns).alias("value"))
    heads = chroms.select("chrom", F.lit(None).cast("long").alias("at"), track_line(prefix, genome).alias("value"))
    ordered = heads.unionByName(body).repartitionByRange("chrom", F.col("at").asc_nulls_first()).sortWithinPartitions("chrom", F.col("at").asc_nulls_first())
    spark, made = rendered.sparkSession, f"{path}{uuid4().hex}"
    ordered.select("chrom", "value").write.option("compression", "gzip" if gz else "none").partitionBy("chrom").text(made)
    at = spark._jvm.org.apache.hadoop.fs.Path
    store = at(made).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for found in store.listStatus(at(made)):
            name = found.getPath().getName()
            if name.startswith("chrom="):
                to = at(f"{path}{unquote(name.removeprefix('chrom='))}.bed{'.gz' if gz else ''}")
                if store.exists(to):
                    raise FileExistsError(to.toString())
                store.rename(found.getPath(), to)
    finally:
        store.delete(at(made), True)


def write_sites_native(sites: DataFrame, path: str) -> None:
    """Sites as Parquet by sample and chromosome, which later scans prune."""
    sites.write.partitionBy("sample", "chrom").parquet(path)


def small_table(spark: SparkSession, rows: list[list], header: list[str], path: str) -> None:
    """A table of few rows (a line for each file or run) as one text file; fractions with twelve significant digits."""
    shown = lambda x: "NA" if x is None else f"{x:.12g}" if isinstance(x, float) else str(x)
    write_text(spark, path, "".join("\t".join(map(shown, r)) + "\n" for r in (header, *rows)))
