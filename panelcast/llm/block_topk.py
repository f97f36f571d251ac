"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are integer term weights (``floor(scale * x)``). Candidates lie in blocks of
neighbouring ids; a block keeps a forward index (its weight matrix) and the least
and greatest weight per term. For a query, a block's bound is the sum over
terms of the query's weight times the greatest (for negative query weights: the
least) weight. Blocks are scored in descending order of bound until it falls
below the k-th best score; equal bounds are still scored, for the ties.

Spark deals groups of blocks and blocks of queries and pairs them by an
equi-join on the group, so a task holds one group and one query block at a time.

Vectors that are null or hold null or non-finite components take no part, and
neither do null ids. Shorter vectors count as 0 in the terms they lack. Rows that
repeat id and vector count once; a query never gets a row with its own id.
Scores are exact as far as a long reaches: weights beyond 2**62 in size count as 2**62,
and a score beyond a long is the nearest long, so such scores tie and smaller ids win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
GROUP = 8 * BLOCK
QUERIES = 256
#: Greatest weight; every weight is a whole double, so it is exact as a long and as a double.
CLAMP = 1 << 62
#: Greatest score; the least long stands for no score.
MOST = (1 << 63) - 1
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)

PACK = pa.schema([("g", pa.int32()), ("ids", pa.binary()), ("dims", pa.binary()), ("weights", pa.binary())])
PACK_DDL = "g int, ids binary, dims binary, weights binary"


def pack(rows: int, groups: int):
    """Vectors as rows of up to ``rows`` ids, term counts and weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, n = [], [], 0

        def out():
            nonlocal ids, vectors, n
            all_ids, flat = np.concatenate(ids), np.concatenate([v[1] for v in vectors])
            dims = np.concatenate([v[0] for v in vectors])
            off = np.r_[0, np.cumsum(dims)]
            made = []
            while len(all_ids) - (at := len(made) * rows) >= rows or (n < 0 and at < len(all_ids)):
                end = min(at + rows, len(all_ids))
                made.append((int(all_ids[at] % groups), all_ids[at:end].tobytes(), dims[at:end].tobytes(),
                             flat[off[at]:off[end]].tobytes()))
            at = min(len(made) * rows, len(all_ids))
            ids, vectors = [all_ids[at:]], [(dims[at:], flat[off[at]:])]
            n = len(ids[0]) if n >= 0 else n
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made), PACK)], schema=PACK) if made else None

        for batch in batches:
            v = batch.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ids.append(batch.column("vec_id").to_numpy())
            vectors.append((np.diff(v.offsets.to_numpy()).astype(np.int64), flat))
            n += batch.num_rows
            if n >= rows and (made := out()):
                yield made
        if n:
            n = -1
            if made := out():
                yield made
    return run


def matrix(ids: bytes, dims: bytes, weights: bytes, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    ids, dims, flat = (np.frombuffer(x, np.int64) for x in (ids, dims, weights))
    out = np.zeros((len(ids), max(width, int(dims.max(initial=0)))), np.float64)
    out[np.arange(out.shape[1])[None, :] < dims[:, None]] = flat
    return ids, out


def _dot(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond the range of doubles by integers of any size."""
    reach = np.abs(q).sum(axis=1).max(initial=0) * np.abs(v).max(initial=0)
    if reach < EXACT:
        return (q @ v.T).astype(np.int64)
    exact = q.astype(np.int64).astype(object) @ v.astype(np.int64).astype(object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def best(qid, q, ids, v, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's ``k`` best in one group of blocks."""
    starts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(v, starts), np.minimum.reduceat(v, starts)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    bound = plus @ high.T + minus @ low.T
    bound += np.abs(bound) * 1e-12  # never below the true bound where doubles round
    order = np.argsort(-bound, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    score = np.full((len(q), k), none)
    found = np.full((len(q), k), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    for r in range(len(starts)):
        block = order[live, r]
        go = (score[live, -1] == none) | (bound[live, block] >= score[live, -1])
        live, block = live[go], block[go]
        if not len(live):
            break
        for b in np.unique(block).tolist():
            rows = live[block == b]
            own = ids[starts[b]:starts[b] + BLOCK]
            s = _dot(q[rows], v[starts[b]:starts[b] + BLOCK])
            s = np.where(own[None, :] == qid[rows, None], none, s)
            # Only scores from the k-th so far (at first: of this block) on are sorted, ties among them.
            least = score[rows, -1]
            if s.shape[1] > k and len(new := np.flatnonzero(least == none)):
                least[new] = np.partition(s[new], -k, axis=1)[:, -k]
            at, column = np.nonzero((s >= least[:, None]) & (s != none))
            if not len(at):
                continue
            hit, at = np.unique(at, return_inverse=True)
            of, rows = rows[hit[at]], rows[hit]
            all_s = np.concatenate([score[rows].ravel(), s[hit[at], column]])
            all_i = np.concatenate([found[rows].ravel(), own[column]])
            all_r = np.concatenate([np.repeat(rows, k), of])
            order_r = np.lexsort((all_i, ~all_s, all_r))
            first = np.searchsorted(all_r[order_r], rows)
            pick = order_r[first[:, None] + np.arange(k)]
            score[rows], found[rows] = all_s[pick], all_i[pick]
    real = score != none
    return np.repeat(qid, real.sum(axis=1)), found[real], score[real]


def search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if row["ids"] != last:
                    last, held = row["ids"], matrix(row["ids"], row["dims"], row["weights"])
                qid, q = matrix(row["q_ids"], row["q_dims"], row["q_weights"], held[1].shape[1])
                ids, v = held
                if q.shape[1] > v.shape[1]:
                    v = np.pad(v, ((0, 0), (0, q.shape[1] - v.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best(qid, q, ids, v, k)], schema=schema)
    return run


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): the rows that take part, as integer weights."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (x.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.coalesce(finite, F.lit(False)))
            .select("vec_id", F.transform("e", lambda c: F.floor(F.greatest(F.lit(-float(CLAMP)), F.least(F.lit(float(CLAMP)), c * scale))).cast("long")).alias("v")))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id ``every`` divides, against all rows."""
    spark = vectors.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = integer_vectors(vectors, scale).dropDuplicates()
    blocks = rows.repartitionByRange(groups, "vec_id").sortWithinPartitions("vec_id").mapInArrow(pack(GROUP, groups), PACK_DDL)
    asked = (rows.where(F.col("vec_id") % every == 0).repartitionByRange(max(1, groups // 8), "vec_id")
             .mapInArrow(pack(QUERIES, groups), PACK_DDL)
             .select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.col("ids").alias("q_ids"),
                     F.col("dims").alias("q_dims"), F.col("weights").alias("q_weights")))
    # Spark's estimate of ``asked`` is that before the copies for each group, so it may be far below the
    # broadcast threshold when its true size is not: both sides are shuffled, whatever their estimates.
    found = blocks.join(asked.hint("merge"), "g").drop("g").mapInArrow(search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
