"""Shards from a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by their id (null first; equal ids by size, checksum and hash of the
text). A keyed Feistel network permutes the numbers of the least even count of bits
that holds them; a result beyond the last row is permuted again until it is a row
(cycle walking), so the numbers below ``n`` are permuted among themselves. The place
in the shuffle gives the shard (place modulo shards) and the slot (place divided by
shards): counts differ by one at most and slots have no gaps, at any size and skew.
Both ways are computable from ``n``, the seed and the shard count alone: ``places``
tells where a row went, ``rows_at`` which row holds a slot, with no lookup table.

Repeated rows get a place each; null texts have no bytes; an empty table gives no rows;
extra columns are ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import numbering
from panelcast.llm.components import written
from panelcast.llm.vec import U, mix

ROUNDS = 6
LOW = U(0xFFFFFFFF)
#: Odd multipliers of the round function.
TIMES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def round_keys(seed: int) -> list[int]:
    return [int(k) for k in mix(np.arange(ROUNDS, dtype=U) + mix(np.array([seed], U))[0])]


def half_bits(n: int) -> int:
    """Bits of one half: the halves together hold all numbers below ``n``."""
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _turn(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = half * U(TIMES[0]) + U(key)
    return (((x >> U(32)) ^ (x & LOW)) * U(TIMES[1])) >> U(64 - bits)


def _forward(x: np.ndarray, keys: list[int], bits: int) -> np.ndarray:
    left, right = x >> U(bits), x & U((1 << bits) - 1)
    for k in keys:
        left, right = right, left ^ _turn(right, k, bits)
    return (left << U(bits)) | right


def _backward(x: np.ndarray, keys: list[int], bits: int) -> np.ndarray:
    left, right = x >> U(bits), x & U((1 << bits) - 1)
    for k in reversed(keys):
        left, right = right ^ _turn(left, k, bits), left
    return (left << U(bits)) | right


def _walk(x: np.ndarray, n: int, seed: int, step) -> np.ndarray:
    if n < 1 or n > 1 << 62:
        raise ValueError("a permutation needs between 1 and 2**62 rows")
    keys, bits = round_keys(seed), half_bits(n)
    x = step(np.asarray(x).astype(U), keys, bits)
    out = np.flatnonzero(x >= U(n))
    while len(out):
        x[out] = step(x[out], keys, bits)
        out = out[x[out] >= U(n)]
    return x.astype(np.int64)


def places(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Place of each row number in the shuffle of ``n`` rows."""
    return _walk(rows, n, seed, _forward)


def rows_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """Row numbers that a shard's slots hold: the way back, without a table."""
    at = np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64)
    if len(at) and (at.min() < 0 or at.max() >= n):
        raise ValueError("no such slot")
    return _walk(at, n, seed, _backward)


def place_column(row, n: int, seed: int):
    """``places`` as a column of a long column of row numbers."""
    @F.pandas_udf("long")
    def shuffled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(places(b.to_numpy(), n, seed))
    return shuffled(row)


def measured(docs: DataFrame) -> DataFrame:
    """Id, size in bytes plus one, checksum and hash of each text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))


def _placed(rows: DataFrame, order: list[str], shards: int, seed: int, range_rows: int) -> DataFrame:
    if shards < 1:
        raise ValueError("at least one shard")
    laid, spans = numbering.laid_out(rows, [], order, range_rows)
    n = laid.count()
    numbered = numbering.with_spans(laid, spans, []).withColumn("row", F.col("_index"))
    at = place_column(F.col("row"), max(n, 1), seed)
    return (numbered.select(*rows.columns, "row", at.alias("place"))
            .withColumns({"shard": F.pmod("place", F.lit(shards)).cast("int"),
                          "slot": F.expr(f"place div {int(shards)}")}))


def assign(docs: DataFrame, shards: int = 16, seed: int = 7, range_rows: int = numbering.RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``), row, place."""
    got = _placed(written(measured(docs)), ["doc_id", "size", "text_crc32", "text_hash"], shards, seed, range_rows)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "row", "place")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 7, slots_per_file: int = 1 << 17,
                 range_rows: int = numbering.RANGE_ROWS) -> DataFrame:
    """Write whole documents as ``path/_shard=…`` with their ``_row`` and ``_slot``, sorted by slot; returns the table.

    Files are ranges of (shard, slot), so a shard is written by many tasks. A column
    named like one of these three is refused.
    """
    own = {"_row", "_shard", "_slot"}
    if own & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns named {sorted(own)} are the operator's own")
    text = F.coalesce("text", F.lit(""))
    inner = docs.select(F.struct(*docs.columns).alias("document"), F.col("doc_id").alias("id"), F.octet_length(text).alias("bytes"),
                        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash"))
    got = _placed(written(inner), ["id", "bytes", "crc", "hash"], shards, seed, range_rows)
    out = got.select("document.*", F.col("row").alias("_row"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    files = max(shards, -(-got.count() // slots_per_file))
    (out.repartitionByRange(files, "_shard", "_slot").sortWithinPartitions("_shard", "_slot")
     .write.partitionBy("_shard").parquet(path))
    return docs.sparkSession.read.parquet(path)
