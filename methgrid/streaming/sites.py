"""Site statistics over a folder that sites keep being written to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from methgrid.operators.convert import stats

SCHEMA = "sample string, chrom string, start long, `end` long, perc string, total long"


def watch_sites(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Parquet sites as a stream, up to ``max_files`` new files at a time."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def running_stats(sites: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of each sample's statistics up to date; one row of state for each sample."""
    return stats(sites, ["sample"]).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
