"""Registered queries of the training-data operators, with SQL where it is fast enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (block_topk, bloom_cascade, bootstrap_pii, chosen_path, feistel_shards, hyperdim, merkle, mixing,
                           oracles, prefix_trie, substring_dedup, suffix_dedup, warc, winnowing)
from panelcast.llm.components import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_domain(docs: DataFrame) -> DataFrame:
    """The tree's first level: a domain from the number in the source's name."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    names = F.array(*(F.lit(d) for d in oracles.DOMAINS))
    return docs.withColumn("domain", F.when(number != "", F.get(names, F.pmod(number.cast("int"), F.lit(len(oracles.DOMAINS))))))


def mixing_weights() -> list:
    """Weight columns of domain, language and source."""
    def pick(column, weights):
        pairs = [F.lit(x) for kv in weights.items() for x in kv]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col(column)), F.lit(1))
    return [pick("domain", oracles.DOMAIN_WEIGHTS), pick("lang", oracles.LANG_WEIGHTS), F.lit(1)]


@query("op1_source_mixing", oracles.MIXING)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of a domain, language and source tree: what each document gives."""
    docs = with_domain(table(spark, sf_dir, "documents")).withColumn("n_tokens", mixing.token_count())
    slim = written(docs.select("doc_id", "domain", "lang", "source", "n_tokens", F.xxhash64("text").cast("string").alias("text")))
    got = mixing.mix(slim, ["domain", "lang", "source"], mixing_weights(), F.col("total"), epochs=oracles.EPOCHS, seed=oracles.SEED)
    return got.select("doc_id", "domain", "lang", "source", "n_tokens", "n_epochs", "n_prefix", "n_taken")


@query("op2_warc_index", oracles.WARC)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, read back, and merged into one capture history."""
    time = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(315360000))),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").alias("payload"), time.alias("time"))
    return warc.archive_and_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_block_topk", oracles.TOPK)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector against all others."""
    return block_topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


@query("op4_winnowing_decontamination", oracles.DECONTAMINATION)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in all documents."""
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)


@query("op5_bootstrapped_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base patterns and what their contexts lead to."""
    return bootstrap_pii.find_private(table(spark, sf_dir, "documents"))


@query("op6_bloom_cascade_urls", oracles.URL_FILTER)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules, else by the cascade over the listed hosts."""
    listed = F.lit(False)
    for label in oracles.LISTED_LABELS:
        listed = listed | F.concat(F.lit("."), F.col("key")).contains(f".{label}.")
    return bloom_cascade.judge(table(spark, sf_dir, "pages"), listed, oracles.RULES).drop("listed")


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-byte strings of whole documents that an earlier document holds."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)


@query("op8_substring_dedup", oracles.WORD_REPEATS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows of whole documents that an earlier document holds."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=13)


@query("op9_hyperdimensional_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    return hyperdim.identify(table(spark, sf_dir, "documents"))


@query("op10_chosen_path_near_dedup", oracles.NEAR_DUPLICATES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are similar to 0.75 or more."""
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=75)


@query("op11_prefix_trie", oracles.TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op12_feistel_shards", oracles.sharding(16, feistel_shards.round_keys(oracles.SEED), feistel_shards.TIMES))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in a keyed shuffle of the row numbers."""
    return feistel_shards.assign(table(spark, sf_dir, "documents"), shards=16, seed=oracles.SEED)


@query("op13_merkle_manifest", oracles.MANIFEST)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether its tampered text still folds to the root."""
    docs = table(spark, sf_dir, "documents")
    return merkle.Manifest(docs, *merkle.without_newlines()).prove()
