"""Removal of long substrings that occur in an earlier document, by column-wise multi-document suffix construction.

The construction takes a collection of strings and, in each round, inserts one
more symbol of every string, from their right ends on: the suffixes that begin
with it find their places in the collection's Burrows-Wheeler transform by
ranking, and the lengths of the common prefixes beside them by minima over the
table of the round before. All tables are read and written in one direction,
as sequential files would be. They stay in memory: a collection is a bounded
part of the corpus, and files of one machine would be lost with it.

How a corpus becomes bounded collections, without loss:

1. Every window of ``length`` bytes has a minimizer, the inner gram of the
   smallest hash. Equal windows have equal minimizers. Windows that lie side by
   side and share their minimizer form a fragment.
2. Minimizers that occur in one document only are dropped: their windows cannot
   recur elsewhere. Hash collisions can only keep too much here.
3. Equal fragments of a chunk of documents become one, with the smallest id.
   Fragments are dealt by their minimizer, so equal windows meet. Where a
   minimizer is found in very many chunks, its windows are dealt one by one, by
   their own hash, so that no collection grows with a frequent passage.
4. Neighbours in the suffix order with a common prefix of ``length`` are equal
   windows; the smallest id among them decides for all.

Fragments merge by a digest and are then compared byte by byte; the rare two
that differ under one digest are told apart.

Cases: null texts count as empty; texts shorter than ``length`` lose nothing;
matches never cross documents; rows with equal ids are not earlier than each
other; a null id comes after all others, and rows without an id are not earlier
than each other; an empty table gives an empty result; other columns are not
carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methgrid.llm.store import Store
from methgrid.llm.textnp import flat, mix, pieces, span_hash

CHUNK_BYTES = 2 << 20
#: Bytes of text that are hashed at a time, which bounds a task's memory.
PIECE_BYTES = 512 << 10
#: Inner grams of 26 bytes leave 25 windows of 50 bytes around each place.
GRAM_SHARE = 0.52
#: A minimizer of more chunks than this is frequent. Up to here its distinct fragments are a small part of a task; one window apiece costs twenty times the bytes.
FREQUENT = 4096
#: Strings that one construction takes, unless one minimizer alone has more.
COLLECTION = 1024
#: The rank of rows without an id: behind all others.
LAST = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def fragments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows with one minimizer: its hash, the first window's start, the number of windows, the document."""
    parts = []
    d = 0
    while d < len(offsets) - 1:
        to = max(d + 1, int(np.searchsorted(offsets, offsets[d] + PIECE_BYTES, "right")) - 1)
        low, high = int(offsets[d]), int(offsets[to])
        # a long text goes in parts that overlap by a window less one byte
        for at in range(low, high, PIECE_BYTES) if to == d + 1 else (low,):
            stop = min(high, at + PIECE_BYTES + length - 1) if to == d + 1 else high
            f, s, n, own = piece_fragments(data[at:stop], offsets[d : to + 1] - low if to > d + 1 else np.array([0, stop - at]), length)
            parts.append((f, s + at, n, own + d))
        d = to
    if not parts:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def piece_fragments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """fragments() of less than 2**24 bytes."""
    gram = max(1, int(length * GRAM_SHARE))
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none, none
    place = np.arange(len(data) - gram + 1)
    h = span_hash(data, place, place + gram)
    low = np.uint64((1 << 24) - 1)
    least = sliding_min((h & ~low) | place.astype(np.uint64), width)
    at = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    whole = np.arange(len(at)) + length <= offsets[1:][doc]
    breaks = np.ones(len(at), bool)
    breaks[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    runs = np.flatnonzero(breaks)
    inside = np.r_[0, np.cumsum(whole)]
    n = inside[np.r_[runs[1:], len(at)]] - inside[runs]
    runs, n = runs[n > 0], n[n > 0]
    return h[at[runs]], runs, n, doc[runs]


def construct(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise construction over strings ``symbols[start : start + size]``. For all suffixes of at least ``length`` in suffix order: the string, the suffix's length, and whether it shares ``length`` symbols with the one before."""
    m, longest = len(starts), int(sizes.max())
    used, ranks = np.unique(symbols, return_inverse=True)
    kind = np.uint8 if len(used) < 256 else np.uint16
    # columns from the right; 0 ends a string
    column = np.arange(longest + 1)
    inner = column < sizes[:, None]
    text = np.zeros((m, longest + 1), kind)
    text[inner] = (ranks + 1)[((starts + sizes - 1)[:, None] - column)[inner]]
    transform, common = text[:, 0].copy(), np.zeros(m, np.uint8 if length < 250 else np.int32)
    string, depth, place = np.arange(m, dtype=np.int32), np.zeros(m, np.int32), np.arange(m)
    for j in range(longest):
        active = np.flatnonzero(text[:, j])
        order = np.argsort(transform, kind="stable")
        order = order[len(order) - np.count_nonzero(transform) :]
        rank = np.empty(len(transform), np.int64)
        rank[order] = np.arange(len(order))
        old = place[active]
        by_rank = np.argsort(-rank[old])  # backwards, so that the ranges below never span a gap
        active, old = active[by_rank], old[by_rank]
        at = rank[old]
        now = transform[old]
        table = np.append(common, 0)

        def beside(low: np.ndarray, high: np.ndarray, same: np.ndarray) -> np.ndarray:
            """One more than the common prefix of rows low and high of the round before, where their symbols agree."""
            out = np.zeros(len(low), common.dtype)
            if same.any():
                pairs = np.empty(2 * int(same.sum()), np.int64)
                pairs[0::2], pairs[1::2] = low[same] + 1, high[same] + 1
                out[same] = np.minimum(np.minimum.reduceat(table, pairs)[0::2], length - 1) + 1
            return out

        before, after = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, len(order) - 1)]
        with_before = beside(before, old, (at > 0) & (transform[before] == now))
        with_after = beside(old, after, (at + 1 < len(order)) & (transform[after] == now))
        new = at + m
        stay = np.ones(len(transform) + len(active), bool)
        stay[new] = False

        def inserted(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
            out = np.empty(len(stay), rows.dtype)
            out[stay] = rows
            out[new] = values
            return out

        transform = inserted(transform, text[active, j + 1])
        string, depth = inserted(string, active), inserted(depth, np.full(len(active), j + 1))
        common = inserted(common, with_before)
        inner_ = new + 1 < len(common)
        common[new[inner_] + 1] = with_after[inner_]
        place[active] = new
    rows = np.flatnonzero(depth >= length)
    return string[rows], depth[rows], common[rows] >= length


def earlier(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """For each string, one bit for each of its windows: whether the window also begins in a string of a smaller ``first``."""
    string, depth, joined = construct(symbols, starts, sizes, length)
    out = np.zeros(len(starts), np.int64)
    if len(string):
        heads = np.flatnonzero(~joined)
        group = np.cumsum(~joined) - 1
        least = np.minimum.reduceat(first[string], heads)
        bad = least[group] < first[string]
        np.add.at(out, string[bad], np.int64(1) << (sizes[string[bad]] - depth[bad]).astype(np.int64))
    return out


def squeezed(column: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: high bytes, which hardly change, cost next to nothing."""
    return pa.compress(np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes(), "zstd", asbytes=True) if len(column) else b""


def tight(data: bytes) -> bytes:
    """Text that is written, dealt and read several times; a high level pays."""
    return pa.Codec("zstd", compression_level=9).compress(data, asbytes=True)


def spread(packed: bytes, n: int, kind: type) -> np.ndarray:
    """The ``n`` numbers of squeezed()."""
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(packed, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def chunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents packed into chunks: a number that no other chunk has (it is made of the task's place, and this table is written before it is used), ids, which of them are null, sizes, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "t", CHUNK_BYTES):
            data, offsets = flat(batch.column("t"))
            ids = batch.column("id").fill_null(LAST).to_numpy().astype(np.int64)
            nulls = np.packbits(batch.column("id").is_null().to_numpy(zero_copy_only=False)).tobytes()
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([number], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "nulls": pa.array([nulls], pa.binary()), "sizes": pa.array([np.diff(offsets).tobytes()], pa.binary()), "n_bytes": pa.array([len(data)], pa.int64()), "packed": pa.array([tight(data.tobytes())], pa.binary())}
            )
            number += 1

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "chunk long, ids binary, nulls binary, sizes binary, n_bytes long, packed binary")


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes at ``a`` and at ``b`` are equal, some thousands at a time."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 8192):
        n = size[k : k + 8192]
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begin, n)
        out[k : k + 8192] = np.logical_and.reduceat(data[np.repeat(a[k : k + 8192], n) + inner] == data[np.repeat(b[k : k + 8192], n) + inner], begin)
    return out


def merged(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal spans of one group as one: the first of each, in order of group, and the number of each span's."""
    order = np.lexsort((size, digest, group))
    new = np.ones(len(order), bool)
    new[1:] = (digest[order][1:] != digest[order][:-1]) | (group[order][1:] != group[order][:-1]) | (size[order][1:] != size[order][:-1])
    number = np.cumsum(new) - 1
    alike = same_bytes(data, start[order], start[order[new]][number], size[order])
    if not alike.all():  # one digest over different bytes: these go by their bytes
        for n in np.unique(number[~alike]).tolist():
            rows = np.flatnonzero(number == n)
            spans = [data[start[k] : start[k] + size[k]].tobytes() for k in order[rows].tolist()]
            by_bytes = sorted(range(len(rows)), key=spans.__getitem__)
            order[rows] = order[rows][by_bytes]
            new[rows] = [k == 0 or spans[by_bytes[k]] != spans[by_bytes[k - 1]] for k in range(len(rows))]
        number = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = number
    return order[new], out


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's ids, bytes and offsets."""
    sizes = np.frombuffer(row["sizes"], np.int64)
    data = pa.decompress(row["packed"], row["n_bytes"], "zstd", asbytes=True)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(data, np.uint8), np.r_[0, np.cumsum(sizes)]


def distinct(prints: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints, cut to ``width`` bytes, in order, and whether each is of several ids."""
    prints = prints >> np.uint64(64 - 8 * width)
    order = np.lexsort((ids, prints))
    prints, ids = prints[order], ids[order]
    new = np.r_[True, prints[1:] != prints[:-1]][: len(prints)]
    other = np.r_[False, ~new[1:] & (ids[1:] != ids[:-1])][: len(prints)]
    heads = np.flatnonzero(new)
    return prints[heads], np.logical_or.reduceat(other, heads) if len(heads) else other


def cut(sorted_keys: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """Where each bucket's range of fingerprints begins."""
    edges = [(k << (8 * width)) // buckets for k in range(buckets)]
    return np.r_[np.searchsorted(sorted_keys, np.array(edges, np.uint64)), len(sorted_keys)]


def print_rows(chunks: DataFrame, length: int, buckets: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, data, offsets = unpack(row)
                prints, _, _, doc = fragments(data, offsets, length)
                keys, several = distinct(prints, ids[doc], width)
                at = cut(keys, buckets, width)
                full = [k for k in range(buckets) if at[k] < at[k + 1]]
                steps = lambda x: np.diff(x, prepend=np.uint64(0))
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(full, pa.int32()),
                        "chunk": pa.array([row["chunk"]] * len(full), pa.int64()),
                        "n": pa.array([at[k + 1] - at[k] for k in full], pa.int64()),
                        "keys": pa.array([squeezed(steps(keys[at[k] : at[k + 1]])) for k in full], pa.binary()),
                        "several": pa.array([np.packbits(several[at[k] : at[k + 1]]).tobytes() for k in full], pa.binary()),
                    }
                )

    return chunks.mapInArrow(run, "bucket int, chunk long, n long, keys binary, several binary")


def shared_prints(rows: DataFrame) -> DataFrame:
    """For each chunk and bucket which fingerprints are of several documents, and which are frequent."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        keys = np.concatenate([np.cumsum(spread(x, n, np.uint64), dtype=np.uint64) for x, n in zip(table.column("keys").to_pylist(), sizes.tolist())])
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("several").to_pylist(), sizes)]).astype(bool)
        shared = count > 1
        shared[back[several]] = True
        shared, frequent = shared[back], (count > FREQUENT)[back]
        ends = np.cumsum(sizes)
        packed = lambda x: [np.packbits(x[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": pa.array(sizes, pa.int64()), "shared": pa.array(packed(shared), pa.binary()), "frequent": pa.array(packed(frequent), pa.binary())})

    return rows.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, n long, shared binary, frequent binary")


def fragment_rows(chunks: DataFrame, replies: DataFrame, length: int, buckets: int, width: int) -> DataFrame:
    """Rows of kind 0: a chunk's distinct fragments of one bucket; of kind 1: where a chunk's fragments begin and which they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, data, offsets = unpack(row)
                prints, start, n, doc = fragments(data, offsets, length)
                keys, _ = distinct(prints, ids[doc], width)
                found = sorted(row["replies"] or [], key=lambda x: x["bucket"])
                bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(x[c], np.uint8), count=x["n"]) for x in found] or [np.zeros(0, np.uint8)]).astype(bool)
                of = np.searchsorted(keys, prints >> np.uint64(64 - 8 * width))
                keep, often = bits("shared")[of], bits("frequent")[of]
                prints, start, n, often = prints[keep], start[keep], n[keep], often[keep]
                # a frequent minimizer's windows go one by one
                times = np.where(often, n, 1)
                inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                prints, start, n, often = np.repeat(prints, times), np.repeat(start, times) + inner, np.where(np.repeat(often, times), 1, np.repeat(n, times)), np.repeat(often, times)
                digest = span_hash(data, start, start + n + (length - 1))
                group = mix(np.where(often, digest, prints) ^ np.uint64(0x632BE59BD9B4E019))
                heads, number = merged(data, start, n + (length - 1), group, digest)
                bucket = ((group >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                first = np.full(len(heads), np.iinfo(np.int64).max)
                np.minimum.at(first, number, ids[np.searchsorted(offsets, start, "right") - 1])
                at = np.searchsorted(bucket[heads], np.arange(buckets + 1))
                full = [k for k in range(buckets) if at[k] < at[k + 1]]
                raw = data.tobytes()
                payload = []
                for k in full:
                    own = heads[at[k] : at[k + 1]]
                    body = b"".join([raw[a:b] for a, b in zip(start[own].tolist(), (start[own] + n[own] + (length - 1)).tolist())])
                    # a cut group number may join two minimizers in one collection, which does no harm
                    payload.append((len(own), squeezed((group[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), squeezed(n[own].astype(np.uint8)), squeezed(first[at[k] : at[k + 1]]), tight(body)))
                order = np.argsort(start, kind="stable")
                payload.append((len(order), squeezed(np.diff(start[order], prepend=0).astype(np.uint32)), squeezed(n[order].astype(np.uint8)), squeezed(number[order].astype(np.uint32)), b""))
                counts, *rest = zip(*payload)
                columns = [pa.array(counts, pa.int64()), *[pa.array(x, pa.binary()) for x in rest]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * len(full) + [1], pa.int32()), pa.array([*full, -1], pa.int32()), pa.array([row["chunk"]] * len(payload), pa.int64()), *columns],
                    ["kind", "bucket", "chunk", "count", "a", "n", "b", "body"],
                )

    gathered = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "shared", "frequent")).alias("replies"))
    return chunks.join(gathered, "chunk", "left").mapInArrow(run, "kind int, bucket int, chunk long, count long, a binary, n binary, b binary, body binary")


def decided(rows: DataFrame, length: int) -> DataFrame:
    """For each chunk and bucket: each fragment's smallest id of all, and bits for the windows that an even smaller id has."""

    def run(table: pa.Table) -> pa.Table:
        counts = table.column("count").to_numpy()
        of = lambda c, kind: [spread(x, k, kind) for x, k in zip(table.column(c).to_pylist(), counts.tolist())]
        windows = [w.astype(np.int64) for w in of("n", np.uint8)]
        group, first, n = np.concatenate(of("a", np.uint32)), np.concatenate(of("b", np.int64)), np.concatenate(windows)
        body = np.frombuffer(b"".join(pa.decompress(x, int((w + length - 1).sum()), "zstd", asbytes=True) for x, w in zip(table.column("body").to_pylist(), windows)), np.uint8)
        size = n + length - 1
        start = np.cumsum(size) - size
        digest = np.concatenate([span_hash(body[start[k] : start[e] + size[e]], start[k : e + 1] - start[k], start[k : e + 1] - start[k] + size[k : e + 1]) for k in range(0, len(start), 8192) for e in [min(k + 8191, len(start) - 1)]])
        heads, number = merged(body, start, size, group, digest)
        least = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(least, number, first)
        mask = np.zeros(len(heads), np.int64)
        # whole groups, up to COLLECTION strings at a time; a string alone in its group meets no other
        edges = np.flatnonzero(np.r_[True, group[heads][1:] != group[heads][:-1], True])
        many = np.repeat(np.diff(edges) > 1, np.diff(edges))
        chosen = np.flatnonzero(many)
        edges = np.r_[0, np.cumsum(np.diff(edges)[np.diff(edges) > 1])]
        at = 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + COLLECTION, "right")) - 1)
            part = chosen[edges[at] : edges[to]]
            own = heads[part]
            text = np.concatenate([body[a:b] for a, b in zip(start[own].tolist(), (start[own] + size[own]).tolist())])
            mask[part] = earlier(text, np.cumsum(size[own]) - size[own], size[own], least[part], length)
            at = to
        ends = np.cumsum(counts)
        packed = lambda x: pa.array([squeezed(x[number[e - c : e]]) for e, c in zip(ends, counts)], pa.binary())
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "count": table.column("count"), "least": packed(least), "mask": packed(mask)})

    return rows.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, count long, least binary, mask binary")


def remove_earlier(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: its key, ``n_bytes``, ``spans`` (the removed runs, start and end in bytes of the original) and ``kept`` (the remaining bytes)."""
    if not 2 <= length <= 100:
        raise ValueError("windows of 2 to 100 bytes")
    store = Store(docs.sparkSession)
    chunks = store.write(chunked(docs, key, text), "chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    # larger corpora get larger buckets first, so that a chunk's row for a bucket still carries many fingerprints
    buckets = max(8, math.ceil(total / min(256 << 20, max(12 << 20, total / 1024))))
    grams = max(1, total / (length * (1 - GRAM_SHARE) / 2))
    width = min(8, math.ceil((math.log2(grams) + 10) / 8))
    prints = print_rows(chunks, length, buckets, width)
    replies = store.write(shared_prints(prints), "replies")
    rows = store.write(fragment_rows(chunks, replies, length, 2 * buckets, width), "fragments", "kind")
    answers = store.write(decided(rows.filter("kind = 0").drop("kind"), length), "answers")
    store.drop("replies")
    store.drop_part("fragments", "kind=0")  # the bytes of the fragments are read no more
    gathered = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "count", "least", "mask")).alias("answers"))
    places = rows.filter("kind = 1").select("chunk", F.col("count"), F.col("a").alias("start"), F.col("b").alias("number"), F.col("n").alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, data, offsets = unpack(row)
                change = np.zeros(len(data) + 1, np.int32)
                found = sorted(row["answers"] or [], key=lambda x: x["bucket"])
                if found:
                    least, mask = (np.concatenate([spread(x[c], x["count"], np.int64) for x in found]) for c in ("least", "mask"))
                    start, number, n = np.cumsum(spread(row["start"], row["count"], np.uint32), dtype=np.int64), spread(row["number"], row["count"], np.uint32), spread(row["windows"], row["count"], np.uint8).astype(np.int64)
                    own = ids[np.searchsorted(offsets, start, "right") - 1]
                    later, bits = own > least[number], mask[number]
                    for k in range(int(n.max(initial=0))):  # the windows of all fragments, column by column
                        bad = start[(k < n) & (later | ((bits >> k) & 1).astype(bool))] + k
                        change[bad] += 1  # no two windows begin at one place
                        change[bad + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets] = True
                heads = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]][: len(gone)]))
                tails = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False][: len(gone)])) + 1
                of = np.searchsorted(offsets, heads, "right") - 1
                begin = np.searchsorted(of, np.arange(len(ids) + 1))
                own_ids = pa.array(ids, mask=np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(ids)).astype(bool))
                left = np.r_[0, np.cumsum(~gone)][offsets]
                kept = data[~gone].tobytes()
                base = offsets[of]
                spans = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.StructArray.from_arrays([pa.array(heads - base, pa.int64()), pa.array(tails - base, pa.int64())], ["start", "end"]))
                for k in range(0, len(ids), 512):
                    to = min(len(ids), k + 512)
                    yield pa.RecordBatch.from_pydict(
                        {"id": own_ids.slice(k, to - k), "n_bytes": pa.array(np.diff(offsets)[k:to], pa.int64()), "spans": spans.slice(k, to - k), "kept": pa.array([kept[a:b] for a, b in zip(left[k:to], left[k + 1 : to + 1])], pa.binary())}
                    )

    whole = chunks.join(places, "chunk", "left").join(gathered, "chunk", "left")
    return whole.mapInArrow(run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", key)


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT r, doc_id, length(h) // 2 AS n, h, unnest(range(0, (length(h) // 2 + 50) // 100)) AS k FROM d WHERE length(h) >= 100),
y AS (SELECT r, doc_id, k, n, substr(h, 200 * k + 1, 298) AS part FROM x),
w AS (SELECT r, doc_id, k, part, unnest(range(0, least(100, n - 49 - 100 * k))) AS i FROM y),
s AS (SELECT r, 100 * k + i AS p, doc_id > min(doc_id) OVER (PARTITION BY substr(part, 2 * i + 1, 100)) AS bad FROM w),
b AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM s WHERE bad),
n AS (SELECT r, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS span FROM b),
g AS (SELECT r, span, min(p) AS a, max(p) + 50 AS z FROM n GROUP BY r, span),
k AS (SELECT r, span, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS from_ FROM g),
o AS (SELECT d.r, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM k JOIN d ON k.r = d.r GROUP BY d.r)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, lower(sha256(unhex(coalesce(kept, h)))) AS kept_sha256
FROM d LEFT JOIN o ON d.r = o.r
"""
