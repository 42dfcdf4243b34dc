"""Genome catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def main_chroms(sizes: DataFrame) -> DataFrame:
    """Chromosomes without an underscore in their names."""
    return sizes.filter(~F.col("chrom").contains("_"))


def add_genome(catalog: dict, genome: str, fasta: str, index: str, sizes: DataFrame, main: bool = False, force: bool = False) -> dict:
    """``catalog`` with one more genome; its chromosomes, a short list, come from ``sizes`` (chrom, length)."""
    if genome in catalog and not force:
        raise ValueError(f"{genome} is in the catalog; force replaces it")
    rows = (main_chroms(sizes) if main else sizes).select("chrom", "length").collect()
    return catalog | {genome: {"index": index, "fasta": fasta, "chroms": {r["chrom"]: int(r["length"]) for r in rows}}}
