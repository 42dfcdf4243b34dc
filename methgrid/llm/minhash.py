"""Near-duplicate groups by MinHash: universal hash minima, banding, verification on full sets, and connected components.

Documents with equal shingle sets are one text; the rest works on one document
of each. Texts that agree in a band meet in its bucket. First each bucket's
members are compared with its smallest one alone, which joins most of them.
Where members then still are of several components, every member outside the
bucket's largest component is compared with all members of other components,
block by block, by counting common shingles over postings. So each pair that
could join two components is compared, and no bucket's pairs are listed: a
block gives at most one link for each component that it joins. Every link is
confirmed on the full shingle sets.

Rows are told apart by a number of their own, not by their key.

Cases: null and empty texts, and texts of white space, have no shingles and
stay alone; repeated rows are copies of each other, and rows of one key and
different texts are compared like any others; a row without a key links like
any other, but the smallest key is one that is there: a component that has none
has a null id, and all its rows are kept; an empty table gives an empty result;
columns whose names clash with the results are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methgrid.llm.graph import components
from methgrid.llm.store import Store
from methgrid.llm.textnp import LOWER, flat, mix, owners, pieces, span_hash, words

#: A pair just at the threshold shares no band with at most this probability.
MISS = 1e-6
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
#: Standard errors by which a signature may fall short of the threshold.
SLACK = 5.0


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document in order of document and value, and where each document's start (one more entry at the end)."""
    starts, ends, first = words(data, offsets)
    h = span_hash(data, starts, ends)
    doc = owners(first)
    n = np.diff(first)
    factor = [np.uint64((2 * k + 1) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) for k in range(width)]
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        out += h[k : k + len(out)] * factor[k]
    whole = np.arange(len(out)) + width <= first[1:][doc[: len(out)]]
    out, doc_out = mix(out[whole]), doc[: len(out)][whole]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        alone = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            there = n[short] > k
            alone[there] += h[first[short[there]] + k] * factor[k]
        out = np.concatenate([out, mix(alone + n[short].astype(np.uint64))])
        doc_out = np.concatenate([doc_out, short])
    order = np.lexsort((out, doc_out))
    out, doc_out = out[order], doc_out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc_out[1:] != doc_out[:-1])
    out, doc_out = out[new], doc_out[new]
    return out, np.searchsorted(doc_out, np.arange(len(offsets)))


class Bands:
    """How many hash functions for a threshold, and their values."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.rows = 5 if threshold >= 0.85 else 4
        self.bands = math.ceil(math.log(MISS) / math.log(1 - threshold**self.rows))
        self.size = self.rows * self.bands
        rng = np.random.default_rng(7)
        self.a = rng.integers(1, 1 << 63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # chance matches of one byte are allowed for by the plain similarity
        self.least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / self.size)

    def minima(self, sets: np.ndarray, where: np.ndarray) -> np.ndarray:
        """For each non-empty set the minima of all hash functions."""
        out = np.zeros((len(where) - 1, self.size), np.uint64)
        at = 0
        x = sets >> np.uint64(32)
        while at < len(where) - 1:  # slices that stay in the processor's cache
            to = min(max(int(np.searchsorted(where, where[at] + 32768, "right")) - 1, at + 1), len(where) - 1)
            part, begin = x[where[at] : where[to]], where[at:to] - where[at]
            buffer = np.empty_like(part)
            for k in range(self.size):
                np.multiply(part, self.a[k], out=buffer)
                np.add(buffer, self.b[k], out=buffer)
                out[at:to, k] = np.minimum.reduceat(buffer, begin)
            at = to
        return out >> np.uint64(32)

    def buckets(self, minima: np.ndarray) -> np.ndarray:
        """A number for each band of each row; bands never meet each other's."""
        out = np.zeros((len(minima), self.bands), np.uint64)
        for k in range(self.rows):
            out = mix(out * np.uint64(3) + minima[:, k :: self.rows][:, : self.bands] + np.uint64(k))
        return mix(out + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def sketch(docs: DataFrame, bands: Bands, width: int, row: Column, key: str, text: str) -> DataFrame:
    """For each row: id (its number ``row``), key, n_shingles, a 128-bit digest of the set (``d1``, ``d2``), buckets, signature, and the packed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            data, offsets = flat(batch.column("t"))
            data = LOWER[data]
            sets, where = shingles(data, offsets, width)
            n = np.diff(where)
            full = np.flatnonzero(n)
            minima = bands.minima(sets, np.r_[where[:-1][full], where[-1:]]) if len(full) else np.zeros((0, bands.size), np.uint64)
            buckets = bands.buckets(minima)
            sums = [np.r_[np.uint64(0), np.cumsum(f(sets))] for f in (mix, lambda x: mix(x ^ np.uint64(0x94D049BB133111EB)))]
            digest = [(s[where[1:]] - s[where[:-1]]).view(np.int64) for s in sums]
            ids = batch.column("id").to_pylist()
            empty = n == 0  # alone, each under a digest of its own
            digest[0][empty], digest[1][empty] = [i for i, e in zip(ids, empty) if e], -1
            of = np.full(len(ids), -1)
            of[full] = np.arange(len(full))
            signature = (minima & np.uint64(255)).astype(np.uint8)
            raw = data.tobytes()
            rows = {
                "id": batch.column("id"),
                "key": batch.column("key"),
                "n_shingles": pa.array(n, pa.int64()),
                "d1": pa.array(digest[0], pa.int64()),
                "d2": pa.array(digest[1], pa.int64()),
                "buckets": pa.array([buckets[k] if k >= 0 else [] for k in of], pa.list_(pa.int64())),
                "signature": pa.array([signature[k].tobytes() if k >= 0 else b"" for k in of], pa.binary()),
                "packed": pa.array([pa.compress(raw[a:b], "zstd", asbytes=True) if b > a else b"" for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                "size": pa.array(np.diff(offsets), pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(rows)

    slim = docs.select(row.alias("id"), F.col(key).cast("long").alias("key"), F.col(text).alias("t"))
    return slim.mapInArrow(run, "id long, key long, n_shingles long, d1 long, d2 long, buckets array<long>, signature binary, packed binary, size long")


def unpacked(packed: list[bytes], sizes: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of packed texts."""
    raw = [pa.decompress(p, n, "zstd", asbytes=True) if n else b"" for p, n in zip(packed, sizes)]
    return shingles(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([*map(len, raw)])].astype(np.int64), width)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, bands: Bands) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets are similar enough; those whose signatures are too far apart are not unpacked."""
    side = lambda c: texts.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n_shingles", "signature", "packed", "size")])
    both = pairs.join(side("b"), "b").join(side("a"), "a").filter(F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * percent)
    least = bands.least * bands.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("signature_a", "signature_b"))
                batch = batch.filter(pa.array((x == y).sum(1) >= least))
                if not len(batch):
                    continue
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                need: dict[int, tuple[pa.Scalar, pa.Scalar]] = {}
                for side, ids in (("a", a), ("b", b)):
                    for i, p, n in zip(ids, batch.column(f"packed_{side}"), batch.column(f"size_{side}")):
                        need.setdefault(i, (p, n))
                sets, where = unpacked([p.as_py() for p, _ in need.values()], [n.as_py() for _, n in need.values()], width)
                own = {i: sets[where[k] : where[k + 1]] for k, i in enumerate(need)}
                common = [len(np.intersect1d(own[i], own[j], assume_unique=True)) for i, j in zip(a, b)]
                good = pa.array([100 * n >= percent * (len(own[i]) + len(own[j]) - n) for i, j, n in zip(a, b, common)])
                yield pa.RecordBatch.from_pydict({"u": batch.column("b").filter(good), "v": batch.column("a").filter(good)})

    return both.select("a", "b", "signature_a", "packed_a", "size_a", "signature_b", "packed_b", "size_b").mapInArrow(run, "u long, v long")


def joining_links(sets: np.ndarray, where: np.ndarray, ids: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows ``left`` and ``right`` of different labels, as many as join labels anew."""
    n = np.diff(where)
    in_right = np.zeros(len(n), bool)
    in_right[right] = True
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(sets, kind="stable")
    order = order[in_right[row[order]]]
    values, holder = sets[order], row[order]  # postings of the right side
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            x = y
        return x

    out = []
    for k in left.tolist():
        own = sets[where[k] : where[k + 1]]
        lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        common = np.bincount(holder[at], minlength=len(n))
        linked = np.flatnonzero((common * 100 >= percent * (n[k] + n - common)) & (labels != labels[k]) & (common > 0))
        for j in linked[np.unique(labels[linked], return_index=True)[1]].tolist():
            x, y = root(int(labels[k])), root(int(labels[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ids[k]), int(ids[j])))
    return out


def block_links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """For members (bucket, home, away, id, label, is_left, packed, size), sorted by group: joining links of each group's left rows with its right rows."""

    def of_group(rows: pa.Table) -> list[tuple[int, int]]:
        side = rows.column("is_left").to_numpy()
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        ids, first, back = np.unique(ids, return_index=True, return_inverse=True)
        labels = labels[first]
        picked = rows.select(["packed", "size"]).take(pa.array(first))
        sets, where = unpacked(picked.column("packed").to_pylist(), picked.column("size").to_pylist(), width)
        return joining_links(sets, where, ids, labels, np.unique(back[side]), np.unique(back[~side]), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("bucket", "home", "away")
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found = of_group(pa.Table.from_batches(held))
            held.clear()
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in names])
            cut = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
            for a, b in zip(cut, np.r_[cut[1:], len(batch)]):
                key = tuple(keys[:, a])
                if held and key != last:
                    yield from flush()
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield from flush()

    return members.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``n_shingles``, ``component_id`` (the smallest key that links of at least ``percent`` similarity over shingles of ``width`` words reach) and ``kept`` (whether it is that smallest one)."""
    spark = docs.sparkSession
    store = Store(spark)
    bands = Bands(percent / 100)
    made = ("n_shingles", "component_id", "kept", "__row")
    rest = [c for c in docs.columns if c not in (key, text, *made)]
    if rest:
        docs = store.write(docs.select(key, text, *rest).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    row = F.col("__row") if rest else F.monotonically_increasing_id()
    sketches = store.write(sketch(docs, bands, width, row, key, text), "sketches")  # written, so that the numbers stay what they are
    texts = store.write(sketches.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.min("key").alias("key")), "texts")  # one document of each set
    own = sketches.join(texts.select("id"), "id", "left_semi")
    slots = own.select("id", F.explode("buckets").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    shared = store.write(shared, "shared")  # a side of its own, so that Spark can split a large bucket in the join
    slots = store.write(slots.join(shared, "bucket"), "slots")
    involved = slots.select("id").distinct()
    packed = store.write(own.join(involved, "id", "left_semi").select("id", "n_shingles", "signature", "packed", "size"), "packed")
    first = slots.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    edges = store.write(verified(first, packed, width, percent, bands), "edges")
    labels = store.write(components(edges, store, "stars"), "labels")
    # buckets of two are settled; those of several components go on
    slots = slots.filter("members > 2").select("bucket", "id").join(labels, slots["id"] == labels["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("label"))
    kinds = slots.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    open_ = kinds.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > most")
    blocks, away = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int")
    members = slots.join(open_.select("bucket", "main", blocks.alias("homes"), away.alias("aways")), "bucket")
    members = store.write(members.select("*", F.pmod(F.xxhash64("id"), F.col("homes")).cast("int").alias("home"), F.pmod(F.xxhash64("id"), F.col("aways")).cast("int").alias("away")), "members")
    right = members.select("bucket", "home", F.explode(F.sequence(F.lit(0), F.col("aways") - 1)).alias("away"), "id", "label", F.lit(False).alias("is_left"))
    left = members.filter("label <> main").select("bucket", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("home"), "away", "id", "label", F.lit(True).alias("is_left"))
    grouped = right.unionByName(left).join(packed.select("id", "packed", "size"), "id").repartition("bucket", "home", "away").sortWithinPartitions("bucket", "home", "away")
    more = store.write(block_links(grouped, width, percent), "more")
    between = more.join(labels.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(labels.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    joined = store.write(components(between.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")), store, "joined"), "joins")
    final = labels.select("node", "component").join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = joined.join(labels.select("node"), "node", "left_anti").select("node", "component")
    labels = store.write(final.unionByName(alone), "all-labels")
    of_text = texts.join(labels, texts["id"] == labels["node"], "left").select("d1", "d2", "key", F.coalesce("component", "id").alias("component"))
    smallest = of_text.groupBy("component").agg(F.min("key").alias("component_id"))
    of_text = of_text.select("d1", "d2", "component").join(smallest, "component").select("d1", "d2", "component_id")
    out = sketches.select("id", "key", "n_shingles", "d1", "d2").join(of_text, ["d1", "d2"])
    out = out.select(F.col("id").alias("__number"), F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
    store.drop("slots", "shared", "packed", "members", "more", "edges", "labels", "joins", "stars-a", "stars-b", "joined-a", "joined-b")
    if not rest:
        return out.drop("__number")
    return docs.select(key, "__row", *rest).join(out.select(F.col("__number").alias("__row"), *made[:3]), "__row").drop("__row")


def oracle_sql(percent: int, width: int) -> str:
    """The same in DuckDB's SQL, by counting the common shingles of all pairs that have one."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(0, len(words) - {width - 1}), lambda i: array_to_string(words[i + 1 : i + {width}], ' ')) END) AS g FROM w) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * c.n >= {percent} * (x.n + y.n - c.n)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(node, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.top FROM r JOIN e ON r.node = e.u AND r.top < e.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.top) AS component_id, d.doc_id = min(r.top) AS kept
FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
