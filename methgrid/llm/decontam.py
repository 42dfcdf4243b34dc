"""Benchmark decontamination by spaced-seed hashing.

A seed takes the words at a mask's ones and ignores those between, so that a
changed word under a zero does no harm. Seeds of documents and of benchmark
items are joined; around each hit the item is laid along the document and the
words are compared one by one. An item leaks into a document where, in a window
of ``WINDOW`` words (the whole item, if shorter), at least the asked share of
words is equal. Words are runs without white space and ASCII punctuation, in
lower case.

Items of fewer than eight words have seeds of four words besides, so that a
place with as many changed words as the asked share allows always holds a seed.

The benchmark goes to the executors in slices of bounded size, one after
another; with several slices each one's finds are written before the next is
sent. Hits are laid along the documents in portions of bounded size, however
often a seed occurs on either side.

Cases: null and empty texts leak nothing; items of fewer than ``LEAST`` words
are too short to tell and are left out; an item without an id is reported with
a null one; of an item's places in a document the best is reported, the first
among equals; repeated rows and repeated items are reported alike; an empty
table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methgrid.llm.store import keep
from methgrid.llm.textnp import LOWER, SPACE, flat, mix, owners, pieces, span_hash
from methgrid.llm.textnp import words as cut_words

#: Five words each, ignoring up to four between them.
MASKS = ("11111", "1101011", "11010011", "110010101", "101100101", "1010101001")
#: Seeds of items of fewer than SHORT words: wherever one word is changed, four others lie under one of these.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
SHORT, LEAST = 8, 5
#: Places of words that are compared at a time.
PORTION = 1 << 21
WINDOW = 13
PERCENT = 80
#: A benchmark's items are sent to the executors in slices of at most this many bytes of text (one longer item is a slice of its own).
SLICE_BYTES = 16 << 20

BREAK = SPACE.copy()
BREAK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
BLANKED = np.where(BREAK, np.uint8(32), LOWER)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words, the number of each row's first word, and the rows' offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    lower = pc.utf8_lower(column)
    # offsets must hold in the original: the rare texts whose length changes keep their other capitals
    column = pc.if_else(pc.equal(pc.binary_length(lower), pc.binary_length(column)), lower, column)
    data, offsets = flat(column)
    data = BLANKED[data]
    starts, ends, first = cut_words(data, offsets)
    return span_hash(data, starts, ends), starts, ends, first, offsets


def seeds(h: np.ndarray, first: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed at each word from which the mask fits into the row, and these words."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, number + 1, np.uint64)
    for k, one in enumerate(mask):
        if one == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    place = np.flatnonzero(np.arange(n) + len(mask) <= first[1:][owners(first)[:n]])
    return mix(out[place]), place


class Index:
    """The seeds of one slice of items, sorted."""

    def __init__(self, items: pa.Table):
        self.portion = PORTION
        self.ids = items.column("id").combine_chunks()
        self.h, _, _, self.first, _ = tokens(items.column("t").combine_chunks())
        size = np.diff(self.first)
        found = []
        self.masks = [(k, m) for k, m in enumerate((*MASKS, *SHORT_MASKS)) if k < len(MASKS) or ((size >= LEAST) & (size < SHORT)).any()]
        for k, m in self.masks:
            seed, place = seeds(self.h, self.first, m, k)
            n = size[owners(self.first)[place]]
            good = (n >= LEAST) & ((k < len(MASKS)) | (n < SHORT))
            found.append((seed[good], place[good]))
        seed, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(seed, kind="stable")
        self.seed, self.place = seed[order], place[order]
        self.item = owners(self.first)[self.place]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[seed >> np.uint64(44)] = True

    def hits(self, h: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """Where items may lie along documents: item, the word at which its first word would be (its sign is free), and document, in portions of about ``portion`` words of items."""
        doc = owners(first)
        for k, m in self.masks:
            seed, place = seeds(h, first, m, k)
            good = self.maybe[seed >> np.uint64(44)]
            seed, place = seed[good], place[good]
            lo, hi = np.searchsorted(self.seed, seed), np.searchsorted(self.seed, seed, "right")
            n = hi - lo
            place, lo, n = place[n > 0], lo[n > 0], n[n > 0]
            ends = np.cumsum(n)
            at = 0
            while at < (ends[-1] if len(ends) else 0):
                # pairs at .. to - 1 of all; a seed's pairs may fall into several portions
                to = min(int(ends[-1]), at + max(1, self.portion // 16))
                pair = np.arange(at, to)
                of = np.searchsorted(ends, pair, "right")
                own = lo[of] + pair - (ends[of] - n[of])
                item = self.item[own]
                found = np.unique(np.stack([item, place[of] - (self.place[own] - self.first[item]), doc[place[of]]]), axis=1)
                words_ = np.cumsum(self.first[found[0] + 1] - self.first[found[0]])
                for cut in np.split(found, np.searchsorted(words_, np.arange(self.portion, int(words_[-1]) if len(words_) else 0, self.portion)), axis=1):
                    if cut.shape[1]:
                        yield cut
                at = to


def slices_of(benchmark: DataFrame, item: str, item_text: str) -> list[DataFrame]:
    """The items in slices of bounded size."""
    items = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, -(-int(size) // SLICE_BYTES))
    return [items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(slices)) == k) if slices > 1 else items for k in range(slices)]


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that leaks into it: ``doc_id``, ``item_id``, ``start_byte`` and ``end_byte`` of the leak in the document, ``n_equal`` words of ``n_aligned``, and ``n_item``, the item's words.

    The benchmark's seeds go to the executors slice by slice; the documents
    stay where they are.
    """
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    parts = slices_of(benchmark, item, item_text)
    out = None
    for part in parts:
        sent = docs.sparkSession.sparkContext.broadcast(Index(part.toArrow()))
        found = slim.mapInArrow(lambda batches, sent=sent: _search(batches, sent.value, percent, window), "doc_id long, item_id long, start_byte long, end_byte long, n_equal long, n_aligned long, n_item long")
        if len(parts) > 1:
            found = keep(found, "leaks")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"doc_id": key, "item_id": item})


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks; with a benchmark of one slice they pass through in place."""
    parts = slices_of(benchmark, item, item_text)
    if len(parts) > 1:
        docs = keep(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")  # the numbers stay what they are
        bad = leaks(docs, benchmark, percent, window, "__row", text, item, item_text)
        return docs.join(bad.select("__row").distinct(), "__row", "left_anti").drop("__row")
    sent = docs.sparkSession.sparkContext.broadcast(Index(parts[0].toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 1 << 20):
            place = pa.array(np.arange(len(batch)), pa.int64())
            found = _search(iter([pa.RecordBatch.from_arrays([place, batch.column(text)], ["id", "t"])]), sent.value, percent, window)
            bad = np.concatenate([x.column("doc_id").to_numpy() for x in found])
            good = np.ones(len(batch), bool)
            good[bad] = False
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def _aligned(h: np.ndarray, first: np.ndarray, index: Index, found: np.ndarray, percent: int, window: int) -> np.ndarray:
    """Of places where items may lie, those that leak: document, item, the first and last word of the leak, and how many words are equal; the best of each document and item."""
    item, at, doc = found
    size = index.first[item + 1] - index.first[item]
    lo, hi = np.maximum(0, first[doc] - at), np.minimum(size, first[doc + 1] - at)  # the item's words that lie inside the document
    n = hi - lo
    begin = np.cumsum(n) - n
    inner = np.arange(int(n.sum())) - np.repeat(begin, n)
    equal = h[np.repeat(at + lo, n) + inner] == index.h[np.repeat(index.first[item] + lo, n) + inner]
    sums = np.r_[0, np.cumsum(equal)]
    width = np.minimum(window, size)
    wide = np.repeat(width, n)
    here = np.flatnonzero(inner + wide <= np.repeat(n, n))
    hits = here[(sums[here + wide[here]] - sums[here]) * 100 >= percent * wide[here]]
    of = np.repeat(np.arange(len(n)), n)
    leak, where = np.unique(of[hits], return_index=True)
    if not len(leak):
        return np.zeros((5, 0), np.int64)
    head, tail = hits[where], hits[np.r_[where[1:], len(hits)] - 1]
    a, b = at[leak] + lo[leak] + inner[head], at[leak] + lo[leak] + inner[tail] + width[leak] - 1
    return best_of(np.stack([doc[leak], item[leak], a, b, sums[tail + width[leak]] - sums[head]]))


def best_of(rows: np.ndarray) -> np.ndarray:
    """For each document and item the place with the most equal words, the first among equals."""
    doc, item, a, b, matched = rows
    rows = rows[:, np.lexsort((b, a, -matched, item, doc))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
    return rows[:, new]


def _search(batches: Iterator[pa.RecordBatch], index: Index, percent: int, window: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "t", 1 << 20):
        h, starts, ends, first, offsets = tokens(batch.column("t"))
        best = np.zeros((5, 0), np.int64)
        for found in index.hits(h, first) if len(h) and len(index.seed) else ():
            best = best_of(np.concatenate([best, _aligned(h, first, index, found, percent, window)], 1))
        d, item, a, b, matched = best
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("id").take(pa.array(d)),
                "item_id": index.ids.take(pa.array(item)),
                "start_byte": pa.array(starts[a] - offsets[d], pa.int64()),
                "end_byte": pa.array(ends[b] - offsets[d], pa.int64()),
                "n_equal": pa.array(matched, pa.int64()),
                "n_aligned": pa.array(b - a + 1, pa.int64()),
                "n_item": pa.array(index.first[item + 1] - index.first[item], pa.int64()),
            }
        )
