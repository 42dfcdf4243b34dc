"""Intermediate tables that outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a session on one machine may be without; it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Store:
    """Tables written to the shared folder; drop() deletes those that are no longer read."""

    #: Stores whose tables a lazy result may still read, oldest first.
    live: list[Store] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, shared_folder(spark), {}
        Store.live.append(self)

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df``, written (apart for each value of the column ``by``, if given) and read back."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                self._delete(path)

    def drop_part(self, name: str, part: str) -> None:
        """Deletes what a table written ``by`` a column holds for one value, as in ``column=value``."""
        self._delete(f"{self.paths[name]}/{part}")

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def release(since: int = 0) -> None:
    """Deletes the tables of all stores made since ``len(Store.live)`` was ``since``, once the results that read them are written or no longer needed."""
    for store in Store.live[since:]:
        store.drop(*list(store.paths))
    del Store.live[since:]


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written once and read back: its lineage ends at files that all executors reach. release() deletes it."""
    return Store(df.sparkSession).write(df, name)
