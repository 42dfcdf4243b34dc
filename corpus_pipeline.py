"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.llm import bpe, decontam, minhash, quality, secrets
from methgrid.llm.queries import table, vocabulary_path
from methgrid.llm.store import Store, keep, release


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.judge(docs).filter("kept").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, a similarity of 0.8 or more) the one of smallest id stays, one without an id only where none has one.

    Every row is a document of its own, known by a number and not by its id:
    texts that share an id, or have none, are compared like any others, and of
    equal ids in one group the first row stays.
    """
    docs = keep(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")  # the numbers stay what they are
    groups = minhash.near_duplicates(docs.select("__row", "text"), percent=80, width=5, key="__row").select("__row", "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "__row")
    first = docs.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(F.min(rank).alias("first"))
    return docs.join(first.select("first.__row"), "__row", "left_semi").drop("__row")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; ``n_chars`` follows the text."""
    found = secrets.scan(docs)
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text that they decode to."""
    return bpe.encode_decode(docs, vocabulary_path())


STAGES = [
    ("quality rules", keep_good),
    ("minhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", redact_secrets),
    ("bpe encoding and decoding", encode),
]

#: Near-duplicate components and the vocabulary's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = table(spark, sf_dir, "documents"), Store(spark)
    for k, (name, stage) in enumerate(STAGES):
        before = len(Store.live)
        docs = store.write(stage(spark, docs, sf_dir), f"stage{k}")
        release(before)
        if k:
            store.drop(f"stage{k - 1}")
    return docs
