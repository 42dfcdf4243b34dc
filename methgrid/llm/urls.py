"""URL verdicts from host and path rules and a character language-model ratio.

Two smoothed variable-order Markov models over the bytes of host and path are
counted, one from all URLs that an allow rule fits and one from all that a
block rule fits. The counts are exact: a distributed table of the grams of all
URLs, which grows with the corpus and is joined to the URLs' bytes. A URL that no rule fits is judged by the difference of the
two log-likelihoods per byte, against a threshold that is calibrated on a fold
of the ruled URLs that the models did not see.

Cases: a null URL, or one without ``://``, has an empty host and path and is
allowed, as no evidence speaks against it; with no URL under one of the two
kinds of rules every other URL is allowed; repeated URLs count as often as they
occur; columns whose names clash with the results are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methgrid.llm.store import keep
from methgrid.llm.textnp import BYTE_CODE, flat, mix

#: (verdict, host, path)
Rule = tuple[str, str, str]
ORDER = 5
#: Bits for a byte, or the place before a text's start, in a gram.
SYMBOL = 9
UNIT = 1 << 40
#: Cells for each class of loglik(), the model over hashed counts that fits in memory.
CELLS = 1 << 18
#: One fifth of the ruled URLs sets the threshold.
FOLDS = 5
BINS = 4001


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host_: Column, path_: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as host and path; null if none does."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, h + p).otherwise(out)
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashes of every byte's context and of context and byte together."""
    n = len(data)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    context = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        if k:
            code = np.full(n, 0x5851F42D4C957F2D, np.uint64)
            inside = np.flatnonzero(place >= k)
            code[inside] = BYTE_CODE[data[inside - k]]
            context = mix(context + code * np.uint64(2 * k + 1))
        yield mix(context + np.uint64(k)), mix(context * np.uint64(3) + BYTE_CODE[data])


def cell(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - 18)).astype(np.int64)


def loglik(data: np.ndarray, offsets: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Each row's log-likelihood per byte; every order is smoothed by the next shorter one in proportion to the kinds of bytes seen."""
    gram_n, context_n, kinds = model
    p = np.full(len(data), 1 / 256)
    for c, g in grams(data, offsets):
        n, k = context_n[cell(c)], kinds[cell(c)]
        p = np.where(n > 0, (np.minimum(gram_n[cell(g)], n) + k * p) / np.maximum(n + k, 1), p)
    sums = np.r_[0, np.cumsum(np.log(p))]
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every byte with the ORDER bytes before it, exactly: SYMBOL bits each, the byte itself lowest, 0 before a text's start."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros(len(data), np.int64)
    for k in range(ORDER + 1):
        inside = np.flatnonzero(place >= k)
        out[inside] |= (data[inside - k].astype(np.int64) + 1) << (SYMBOL * k)
    return out


def positions(texts: DataFrame) -> DataFrame:
    """For each text (uid, seen, allow, block) its grams with their number, and how often each stands under either verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                data, offsets = flat(part.column("seen"))
                row = np.repeat(np.arange(len(part)), np.diff(offsets))
                columns = [part.column(c).take(pa.array(row)) for c in ("uid", "allow", "block")]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array(codes(data, offsets)), *columns[1:]], ["uid", "gram", "allow", "block"])

    return texts.select("uid", "seen", "allow", "block").mapInArrow(run, "uid long, gram long, allow long, block long")


def short_orders(counted: DataFrame) -> dict[str, np.ndarray]:
    """For each class the probability of every byte after every byte by orders 0 and 1; empty for a class without URLs. 257 * 256 rows at most come to the driver."""
    mask = (1 << 2 * SYMBOL) - 1
    rows = counted.filter("allow + block > 0").groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).toPandas()
    grams_ = rows["gram"].to_numpy(np.int64)
    every = np.arange(mask + 1)
    out = {}
    for verdict in ("allow", "block"):
        n = np.zeros(mask + 1)
        n[grams_] = rows[verdict]
        p = np.full(mask + 1, 1 / 256)
        for k in (0, 1):
            p = finer(every, n, p, k)
        out[verdict] = p if n.any() else p[:0]
    return out


def finer(grams_: np.ndarray, n: np.ndarray, p: np.ndarray, order: int) -> np.ndarray:
    """``p``, each gram's probability by the next shorter order, carried on to ``order``; ``n`` are the counts of all grams that share a context of that order with one of ``grams_``."""
    own, at = np.unique(grams_ & ((1 << SYMBOL * (order + 1)) - 1), return_inverse=True)
    gram_n = np.bincount(at, n, len(own))
    of = np.unique(own >> SYMBOL, return_inverse=True)[1]
    context_n, kinds = np.bincount(of, gram_n)[of][at], np.bincount(of, gram_n > 0)[of][at]
    return np.where(context_n > 0, (gram_n[at] + kinds * p) / np.maximum(context_n + kinds, 1), p)


def ratios(counted: DataFrame, short: dict[str, np.ndarray]) -> DataFrame:
    """How much likelier each gram's byte is among the accepted, in units of 1 / UNIT: whole numbers, whose sums don't depend on the order of rows. Grams that share two bytes of context share those of every longer one, so each such group is settled alone."""
    sent = counted.sparkSession.sparkContext.broadcast(short)

    def run(group: pa.Table) -> pa.Table:
        grams_ = group.column("gram").to_numpy()
        logs = []
        for verdict in ("allow", "block"):
            p, n = np.full(len(grams_), 1 / 256), group.column(verdict).to_numpy().astype(float)
            if len(sent.value[verdict]):
                p = sent.value[verdict][grams_ & (len(sent.value[verdict]) - 1)]
                for k in range(2, ORDER + 1):
                    p = finer(grams_, n, p, k)
            logs.append(np.log(p))
        return pa.table({"gram": grams_, "ratio": np.rint((logs[0] - logs[1]) * UNIT).astype(np.int64)})

    context = F.shiftright("gram", SYMBOL).bitwiseAND((1 << 2 * SYMBOL) - 1)
    return counted.withColumn("context", context).groupBy("context").applyInArrow(run, "gram long, ratio long")


def scores(df: DataFrame) -> tuple[DataFrame, bool]:
    """For each text of ``df`` (seen, allow, block: whether a model counts the row) the mean over its bytes of how much likelier it is among the accepted; and whether both classes have a URL."""
    texts = df.groupBy("seen").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).withColumn("uid", F.monotonically_increasing_id())
    texts = keep(texts, "texts")  # the numbers stay what they are
    grams_ = positions(texts)
    counted = keep(grams_.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "counted")
    short = short_orders(counted)
    found = keep(ratios(counted, short), "ratios")  # a side of its own, so that Spark can split a frequent gram's rows in the join
    sums = grams_.select("uid", "gram").join(found, "gram").groupBy("uid").agg((F.sum("ratio") / F.count("*") / UNIT).alias("score"))
    return keep(texts.select("uid", "seen").join(sums, "uid", "left").select("seen", F.coalesce("score", F.lit(0.0)).alias("score")), "scores"), all(map(len, short.values()))


def threshold(scores: DataFrame) -> float:
    """The border between accepted and rejected that errs least on both alike; ``scores`` has verdict and score. At most BINS rows come to the driver."""
    binned = F.least(F.greatest(F.round(F.col("score") * 400), F.lit(-(BINS // 2))), F.lit(BINS // 2)).cast("int")
    found = scores.groupBy(binned.alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")).orderBy("bin").toPandas()
    if not len(found) or not found["good"].sum() or not found["bad"].sum():
        return 0.0
    below = found["good"].cumsum().shift(fill_value=0) / found["good"].sum() + 1 - found["bad"].cumsum().shift(fill_value=0) / found["bad"].sum()
    edges = (found["bin"] - 0.5) / 400
    best = below <= below.min() + 1e-12
    return float(min(edges[best], key=abs))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block)."""
    made = {"host", "path", "rule", "score", "verdict"}
    rest = [c for c in pages.columns if c not in made]
    u = F.coalesce(pages[url], F.lit(""))
    df = pages.select(*[pages[c] for c in rest], host(u).alias("host"), path(u).alias("path"))
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for v, h, p in rules:
        verdict = F.when(F.col("rule") == h + p, v).otherwise(verdict)
    df = df.withColumn("__verdict", verdict).withColumn("__seen", F.concat("host", "path"))
    held = F.pmod(F.xxhash64("__seen"), F.lit(FOLDS)) == 0
    counts = [F.coalesce((F.col("__verdict") == v) & ~held, F.lit(False)).cast("long").alias(v) for v in ("allow", "block")]
    found, able = scores(df.select(F.col("__seen").alias("seen"), *counts))
    df = df.join(found.select(F.col("seen").alias("__seen"), "score"), "__seen")
    border = threshold(df.filter("__verdict IS NOT NULL").filter(held).select(F.col("__verdict").alias("verdict"), "score")) if able else 0.0
    judged = F.when(F.lit(not able) | (F.col("__seen") == "") | (F.col("score") >= border), "allow").otherwise("block")
    return df.select(*rest, "host", "path", "rule", "score", F.coalesce("__verdict", judged).alias("verdict"))
