"""One query per operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.llm import bpe, decontam, html, lines, minhash, quality, secrets, sharding, suffix, urls

SHARDS = 24
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_earlier(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_bpe_speculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["k"] == secrets.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(F.encode(secrets.shown(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256"),
        secrets.shown(F.col("spans")).alias("spans"),
    )


def op8_html_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, width=3)


QUERIES = {f.__name__: f for f in (op1_line_hashing, op2_suffix_columns, op3_quality_cascade, op4_jump_sharding, op5_url_language_model, op6_spaced_seeds, op7_secret_battery, op8_html_two_pass, op9_bpe_speculate, op10_minhash_components)}
ORACLES: dict[str, str] = {"op1_line_hashing": lines.ORACLE_SQL, "op2_suffix_columns": suffix.ORACLE_SQL, "op3_quality_cascade": quality.ORACLE_SQL, "op4_jump_sharding": sharding.oracle_sql(SHARDS), "op10_minhash_components": minhash.oracle_sql(85, 3)}
