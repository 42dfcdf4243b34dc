"""Substring removal by line hashing.

A unit is a sentence: it ends with a word that ends in a full stop, a question
mark or an exclamation mark, and with its line. Its digest covers its words,
with A-Z lower-cased and white space evened out. Occurrences are ranked by the
document's id, null last, then by their place in the document; of all units
with one digest the earliest is kept. The others are removed where they stand
in a row of neighbouring repeated units of ``MIN_WORDS`` words or ``MIN_BYTES``
bytes in all, so that what a passage shares is found although it begins or
ends within a line, and short common sentences are left alone. The removed
units' offsets in the original text are kept.

Cases: null and empty texts have no units; occurrences of equal rank (rows of
one id with the unit at the same place, as in repeated rows) are all the
earliest, or all removed; among rows without an id the place alone decides; an
empty table gives an empty result; columns whose names clash with the results
are dropped; a text without white space is one word, judged by its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methgrid.llm.store import keep
from methgrid.llm.textnp import LOWER, OTHER_BASE, OTHER_CODE, flat, mix, owners, pieces, powers, span_hash, words

#: What neighbouring repeated units must have in all, in words or in bytes, to count as a copy.
MIN_WORDS, MIN_BYTES = 20, 400
BASES = (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)
STOP = np.zeros(256, bool)
STOP[[*b".!?"]] = True


def sequence_hash(h: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A hash of the words first .. last-1 of each unit, in their order."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    return mix((sums[last] - sums[first]) * powers(pow(base, -1, 1 << 64), len(h) + 1)[first] + (last - first).astype(np.uint64))


def units(docs: DataFrame, row: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each unit: the document's ``row`` and id, unit_no, start_byte, end_byte, n_words and its digest of 128 bits (d1, d2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            data, offsets = flat(batch.column("t"))
            starts, ends, first = words(data, offsets)
            if not len(starts):
                continue
            doc = owners(first)
            breaks = np.r_[0, np.cumsum(data == 10)]
            closed = STOP[data[ends - 1]]
            closed[:-1] |= (breaks[starts[1:]] > breaks[ends[:-1]]) | (doc[1:] != doc[:-1])
            closed[-1] = True
            stop = np.flatnonzero(closed) + 1
            begin = np.r_[0, stop[:-1]]
            of = doc[begin]
            lower = LOWER[data]
            d1 = sequence_hash(span_hash(lower, starts, ends), begin, stop, BASES[0])
            d2 = sequence_hash(span_hash(lower, starts, ends, OTHER_CODE, OTHER_BASE), begin, stop, BASES[1])
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column("row").take(pa.array(of)),
                    "id": batch.column("id").take(pa.array(of)),
                    "unit_no": pa.array(np.arange(len(begin)) - np.searchsorted(of, of), pa.int64()),
                    "start_byte": pa.array(starts[begin] - offsets[of], pa.int64()),
                    "end_byte": pa.array(ends[stop - 1] - offsets[of], pa.int64()),
                    "n_words": pa.array(stop - begin, pa.int64()),
                    "d1": pa.array(d1.view(np.int64)),
                    "d2": pa.array(d2.view(np.int64)),
                }
            )

    slim = docs.select(F.col(row).alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return slim.mapInArrow(run, "row long, id long, unit_no long, start_byte long, end_byte long, n_words long, d1 long, d2 long")


def _removed(docs: DataFrame, row: str, min_words: int, min_bytes: int, key: str, text: str) -> DataFrame:
    """The units to remove, with the number of their document's row.

    The units are written once. The earliest occurrences are found by partial
    aggregation; the join that takes them back is one that Spark can split
    where a unit is very frequent. Rows of neighbours are looked for inside a
    document.
    """
    found = keep(units(docs, row, key, text), "units")
    rank = F.struct(F.col("id").isNull().alias("without"), "id", "unit_no")
    earliest = found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    earliest = keep(earliest, "earliest")  # a side of its own: only then can Spark split a frequent unit's rows in the join
    again = found.join(earliest, ["d1", "d2"]).filter(rank > F.col("first")).drop("d1", "d2").withColumn("first", F.col("first.id"))
    in_order, island = Window.partitionBy("row").orderBy("unit_no"), Window.partitionBy("row", "island")
    runs = again.withColumn("island", F.col("unit_no") - F.row_number().over(in_order))
    runs = runs.withColumn("words", F.sum("n_words").over(island)).withColumn("bytes", F.sum(F.col("end_byte") - F.col("start_byte")).over(island))
    return runs.filter((F.col("words") >= min_words) | (F.col("bytes") >= min_bytes))


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each unit to remove, with its offsets and ``first_doc_id``, the document that keeps the earliest occurrence."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("t"))
    gone = _removed(slim, "row", min_words, min_bytes, "id", "t")
    return gone.select(F.col("id").alias(key), "unit_no", "start_byte", "end_byte", "n_words", F.col("first").alias("first_doc_id"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated units cut from the text and ``removed``, their original offsets in bytes."""
    rest = [c for c in docs.columns if c not in ("removed", "__row")]
    numbered = keep(docs.select(*rest, F.monotonically_increasing_id().alias("__row")), "numbered")  # the numbers stay what they are
    gone = _removed(numbered, "__row", min_words, min_bytes, key, text)
    spans = gone.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte", F.col("first").alias("first_doc_id")))).alias("removed"))
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("removed", i - 1)["end_byte"])  # noqa: E731
    gaps = F.transform("removed", lambda x, i: F.decode(F.substring(body, before(i) + 1, x["start_byte"] - before(i)), "UTF-8"))
    tail = F.decode(F.substring(body, before(F.size("removed")) + 1, F.length(body)), "UTF-8")
    none = F.array().cast("array<struct<start_byte:bigint,end_byte:bigint,first_doc_id:bigint>>")
    joined = numbered.join(spans, "__row", "left").withColumn("removed", F.coalesce("removed", none))
    return joined.withColumn(text, F.when(F.size("removed") > 0, F.concat(F.array_join(gaps, ""), tail)).otherwise(F.col(text))).select(*rest, "removed")


BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS whole, ltrim(coalesce(text, ''), {BLANKS}) AS t FROM documents),
x AS (SELECT r, doc_id, strlen(whole) - strlen(t) AS skipped, regexp_extract_all(t, '[^ 	-]+') AS words, regexp_extract_all(t, '[ 	-]+') AS blanks FROM d),
w AS (SELECT r, doc_id, skipped, generate_subscripts(words, 1) AS k, unnest(words) AS w, unnest(blanks[1 : len(words)]) AS blank FROM x),
p AS (SELECT *, skipped + coalesce(sum(strlen(w) + strlen(coalesce(blank, ''))) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place0 FROM w WHERE w IS NOT NULL),
e AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(w, '[.!?]$') OR contains(coalesce(blank, ''), chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit_no FROM p),
u AS (SELECT r, doc_id, unit_no, string_agg(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' ORDER BY k) AS unit, min(place0) AS start_byte, max(place0 + strlen(w)) AS end_byte, count(*) AS n_words FROM e GROUP BY r, doc_id, unit_no),
f AS (SELECT *, rank() OVER ranked AS place, first_value(doc_id) OVER ranked AS first_doc_id FROM u WINDOW ranked AS (PARTITION BY unit ORDER BY doc_id NULLS LAST, unit_no)),
g AS (SELECT *, unit_no - row_number() OVER (PARTITION BY r ORDER BY unit_no) AS island FROM f WHERE place > 1),
h AS (SELECT *, sum(n_words) OVER (PARTITION BY r, island) AS run_words, sum(end_byte - start_byte) OVER (PARTITION BY r, island) AS run_bytes FROM g)
SELECT doc_id, unit_no::BIGINT AS unit_no, start_byte::BIGINT AS start_byte, end_byte::BIGINT AS end_byte, n_words::BIGINT AS n_words, first_doc_id
FROM h WHERE run_words >= {MIN_WORDS} OR run_bytes >= {MIN_BYTES}
"""
