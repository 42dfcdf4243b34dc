"""Sharding by jump consistent hashing, with gapless places inside each shard.

A row's shard depends on its key and the number of shards alone; with one more
shard, rows only move into the new one. No ring or table of shards is kept.

Cases: a null key counts as the key of the empty string or, for whole numbers,
as -1; null texts count as empty; repeated rows get places of their own; an
empty table gives an empty result; columns whose names clash with the results
are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methgrid.llm.store import keep

#: Places are counted in blocks of about this many rows, so that no task needs a whole shard.
BLOCK_ROWS = 250_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key (Lamping and Veach's generator), all keys side by side."""
    key = keys.astype(np.uint64)
    last, open_ = np.zeros(len(key), np.int64), np.arange(len(key))
    while len(open_):
        key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((key[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        to = ((last[open_] + 1).astype(np.float64) * (float(1 << 31) / draw)).astype(np.int64)
        stay = to >= shards
        open_, to = open_[~stay], to[~stay]
        last[open_] = to
    return last


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a whole-number key."""

    @F.pandas_udf(T.IntegerType())
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(-1)))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``docs`` with its ``size`` (bytes of text and 8 more), ``text_crc32``, ``shard``, ``slot`` (its place inside the shard, by key) and ``grown_shard`` (its shard if there were one more).

    A string key is hashed to a whole number first. Places come in two steps:
    rows are numbered inside blocks that are dealt by range of the key, and the
    blocks' counts, a row for each block and shard, give where a block starts.
    """
    made = {"size", "text_crc32", "shard", "slot", "grown_shard", "__block"}
    rest = [c for c in docs.columns if c != text and c not in made]
    number = docs[key] if dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(F.coalesce(docs[key].cast("string"), F.lit("")))
    body = F.coalesce(docs[text], F.lit(""))
    slim = docs.select(
        *[docs[c] for c in rest],
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        shard_of(number, shards).alias("shard"),
        shard_of(number, shards + 1).alias("grown_shard"),
    )
    slim = keep(slim)  # the ranges are sampled from it: no second pass over the texts
    dealt = slim.repartitionByRange(max(8, -(-slim.count() // block_rows)), slim[key], slim["text_crc32"])
    dealt = keep(dealt.withColumn("__block", F.spark_partition_id()))  # written, so that a row's block is settled
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__block", "shard").count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("__block", "shard").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    placed = dealt.withColumn("__place", F.row_number().over(inside).cast("long"))
    return placed.join(starts, ["__block", "shard"]).select(*[F.col(c) for c in rest], "size", "text_crc32", "shard", (F.col("__start") + F.col("__place") - 1).alias("slot"), "grown_shard")


def oracle_sql(shards: int) -> str:
    """The same in DuckDB's SQL, for unique whole-number ids."""
    jumped = """(WITH RECURSIVE j(key, last, next) AS (
        SELECT (doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616, -1::BIGINT, 0::BIGINT
        UNION ALL
        SELECT k, next, floor((next + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
        FROM (SELECT (key * 2862933555777941757 + 1) % 18446744073709551616 AS k, next FROM j WHERE next < SHARDS) s)
        SELECT max(last)::INTEGER FROM j)"""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE crc(n, c, k) AS (SELECT n, n, 0 FROM range(256) t(n) UNION ALL SELECT n, {step}, k + 1 FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
hexed AS (SELECT doc_id, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, (length(h) // 2 + 8)::BIGINT AS size,
    xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(h, '..'), lambda x: (16 * (strpos('0123456789ABCDEF', x[1]) - 1) + strpos('0123456789ABCDEF', x[2]) - 1)::BIGINT),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM hexed, crc_table),
placed AS (SELECT doc_id, size, text_crc32, {jumped.replace('SHARDS', str(shards))} AS shard, {jumped.replace('SHARDS', str(shards + 1))} AS grown_shard FROM sized)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, grown_shard FROM placed
"""
