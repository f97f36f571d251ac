"""Corpus pipeline over ``documents``: language, near-duplicates, benchmark, private data, mixture.

Every stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps, with the
columns of ``documents``; the last adds what the mixture takes of each row. Stages
work on all rows their predecessor kept. A row is told apart by ``doc_id`` and
text, so null ids, repeated rows and extra columns pass as the operators say;
null and wordless texts leave in the first stage.

Each stage sets ``BATCHES`` for its session, as a stage's passes may run after it
has returned; Python workers then hold few texts at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bootstrap_pii, chosen_path, hyperdim, mixing, oracles, winnowing
from panelcast.llm.components import written
from panelcast.llm.queries import mixing_weights, table, with_domain

#: Rows and bytes that a Python worker gets at a time. Spark's 10,000 rows are some 20 MB of texts, which
#: the executor holds beside its heap, in vectors that double as they grow, and the worker once more.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def in_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, in a session whose Python workers get ``BATCHES``."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in BATCHES.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)
    return run


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; a null label is filled in."""
    told = hyperdim.with_language(docs, "_pred", "_score").where(F.col("_pred") != hyperdim.UNKNOWN)
    return told.withColumn("lang", F.coalesce("lang", "_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, once."""
    groups = chosen_path.near_duplicates(docs.select("doc_id", "text"), words=5, percent=75)
    gone = written(groups.where("NOT kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return winnowing.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), span=10)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = bootstrap_pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each document gives to the mixture; documents that give nothing go."""
    counted = with_domain(docs).withColumn("n_tokens", mixing.token_count())
    got = mixing.mix(counted, ["domain", "lang", "source"], mixing_weights(), F.col("total"), epochs=oracles.EPOCHS, seed=oracles.SEED)
    return got.where("n_taken > 0")


STAGES = [(stage.__name__, in_batches(stage)) for stage in (language_id, near_dedup, decontaminate, private_data, mixture)]

#: The language model and the graph of patterns are no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
