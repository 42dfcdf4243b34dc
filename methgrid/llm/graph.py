"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methgrid.llm.store import Store


def _mark(edges: DataFrame) -> tuple:
    """Tells two edge tables apart: how many edges, and sums of their hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.select(F.count("*"), F.sum(h.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftright(h, 33))).first())


def components(edges: DataFrame, store: Store, name: str = "stars") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the edges ``u``, ``v``.

    Each round links a node's larger neighbours to the smallest one, then the
    rest; the table of edges is written after each round. Ends with one star
    for each component.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = store.write(e, f"{name}-a")
    mark, side = _mark(e), "b"
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = store.write(small, f"{name}-{side}")
        now = _mark(e)
        store.drop(f"{name}-{'a' if side == 'b' else 'b'}")
        side = "a" if side == "b" else "b"
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
