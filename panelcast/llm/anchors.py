"""Winnowed anchors and the two exchanges that find the shared ones.

An anchor is the k-gram of least hash in a window of ``length`` units (bytes
or words), so any two equal windows hold an equal anchor. Anchors travel as
column blobs, one row per (flush, bucket): a flush sends an anchor that
several of its documents hold just once, whence a passage that a third of
all documents share costs one entry per flush and never meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.vec import U, inside_rows, mix, runs, sliding_min

FLUSH = 1 << 19
BUCKETS_PER_PARTITION = 2


def winnow(hashes: np.ndarray, off: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ``length`` units within a row, and each one's anchor."""
    width = length - k + 1
    assert 1 <= width <= 64
    windows = inside_rows(off, length)
    if not len(windows):
        return windows, windows
    # The low bits tell the place in the row, so one minimum yields hash and
    # place, and a row's anchors don't depend on the rows beside it.
    begin = np.repeat(off[:-1], np.diff(off))
    local = np.arange(len(begin)) - begin
    packed = (hashes & ~U(63)) | (local[:len(hashes)].astype(U) & U(63))
    low = sliding_min(packed, width)[windows].astype(np.int64)
    return windows, windows + ((low - local[windows]) & 63)


def buckets(spark, per_partition: int = BUCKETS_PER_PARTITION) -> int:
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian byte planes: near-constant planes vanish in compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((low.shape[1], 8), np.uint8)
    out[:, :width] = low.T
    return out.reshape(-1).view("<u8")


BLOB = pa.schema([("bucket", pa.int32()), ("single", pa.binary()), ("doc", pa.binary()),
                  ("place", pa.binary()), ("known", pa.binary()), ("known_doc", pa.binary()),
                  ("known_place", pa.binary())])
BLOB_DDL = ", ".join(f"{f.name} {'int' if f.name == 'bucket' else 'binary'}" for f in BLOB)


def flush(h: np.ndarray, doc: np.ndarray, place: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """One row per bucket: anchors of one document, one entry of each that several
    documents share, and the places of the latter, which need no answer."""
    order = np.argsort(h, kind="stable")
    h, doc, place = h[order], doc[order], place[order]
    at = runs(h)
    size = np.diff(np.r_[at, len(h)])
    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    known = np.repeat(several, size)
    bucket = ((h >> U(50)) % U(n_buckets)).astype(np.int64)
    only = np.flatnonzero(~known)
    only = only[np.lexsort((place[only], doc[only], bucket[only]))]
    shared = at[several]
    shared = shared[np.argsort(bucket[shared], kind="stable")]
    told = np.flatnonzero(known)
    told = told[np.lexsort((place[told], doc[told], bucket[told]))]
    edge = np.arange(n_buckets + 1)
    a, b, c = (np.searchsorted(bucket[x], edge) for x in (only, shared, told))
    rows = []
    for i in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0) | (np.diff(c) > 0)).tolist():
        x, y, z = only[a[i]:a[i + 1]], shared[b[i]:b[i + 1]], told[c[i]:c[i + 1]]
        rows.append((i, planes(h[x], 6), planes(np.diff(doc[x], prepend=0).view(U), 8), planes(place[x], 4),
                     planes(h[y], 6), planes(np.diff(doc[z], prepend=0).view(U), 8), planes(place[z], 4)))
    return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows), BLOB)], schema=BLOB)


def anchor_rows(find: Callable, n_buckets: int) -> Callable:
    """``find(batch)`` yields (hash, doc_id, place) arrays of a batch's distinct anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for h, doc, place in find(batches):
            held.append((h, doc, place))
            count += len(h)
            if count >= FLUSH:
                yield flush(*map(np.concatenate, zip(*held)), n_buckets)
                held, count = [], 0
        if count:
            yield flush(*map(np.concatenate, zip(*held)), n_buckets)
    return run


ANSWER = pa.schema([("part", pa.int32()), ("told", pa.binary())])
ANSWER_DDL = "part int, told binary"


def pack(columns: list[np.ndarray]) -> bytes:
    """Rows (doc, 32-bit columns…) in order of doc as compressed columns."""
    n = len(columns[0])
    raw = b"".join([planes(np.diff(columns[0], prepend=0), 8), *(planes(c, 4) for c in columns[1:])])
    return n.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, width: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=(4 + 4 * width) * n, codec="zstd", asbytes=True)
    return [np.cumsum(unplanes(raw[:8 * n], 8).view(np.int64)),
            *(unplanes(raw[(4 + 4 * i) * n:(8 + 4 * i) * n], 4).astype(np.int64) for i in range(1, width))]


def deal(columns: list[np.ndarray], parts: int) -> pa.Table:
    """Rows (doc, …) dealt by document: one packed row per part."""
    part = (mix(columns[0].view(U)) % U(parts)).astype(np.int64)
    order = np.lexsort((columns[-1], columns[0], part))
    part, columns = part[order], [c[order] for c in columns]
    at = runs(part)
    rows = [(int(part[a]), pack([c[a:b] for c in columns])) for a, b in zip(at, np.r_[at[1:], len(part)])]
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ANSWER)], schema=ANSWER)


def places_by_doc(table: pa.Table) -> pa.Table:
    """One row per document with all its places."""
    doc, place = map(np.concatenate, zip(*(unpack(x, 2) for x in table.column("told").to_pylist())))
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order]
    at = runs(doc)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(doc)].astype(np.int32)), pa.array(place.astype(np.int32)))
    return pa.table({"doc_id": pa.array(doc[at]), "places": lists})


def answer(parts: int):
    return lambda table: deal(shared_of(table), parts)


def shared_of(table: pa.Table) -> list[np.ndarray]:
    """(doc, place) of a bucket's anchors that at least two documents hold."""
    h, doc, place, known, docs, places = [], [], [], [], [], []
    for row in table.to_pylist():
        h.append(unplanes(row["single"], 6))
        doc.append(np.cumsum(unplanes(row["doc"], 8).view(np.int64)))
        place.append(unplanes(row["place"], 4))
        known.append(unplanes(row["known"], 6))
        docs.append(np.cumsum(unplanes(row["known_doc"], 8).view(np.int64)))
        places.append(unplanes(row["known_place"], 4))
    h, doc, place, known = map(np.concatenate, (h, doc, place, known))
    if len(h):
        order = np.argsort(h, kind="stable")
        h, doc, place = h[order], doc[order], place[order]
        at = runs(h)
        shared = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        if len(known):
            known = np.unique(known)
            slot = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            shared |= known[slot] == h[at]
        hit = np.repeat(shared, np.diff(np.r_[at, len(h)]))
        docs.append(doc[hit])
        places.append(place[hit])
    return [np.concatenate(docs).astype(np.int64), np.concatenate(places).astype(np.int64)]


def shared_places(docs: DataFrame, find: Callable) -> DataFrame:
    """(doc_id, places): the anchors of each document that another document holds too."""
    n, parts = buckets(docs.sparkSession), buckets(docs.sparkSession, 1)
    blobs = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(anchor_rows(find, n), BLOB_DDL)
    told = blobs.groupBy("bucket").applyInArrow(answer(parts), ANSWER_DDL)
    return told.groupBy("part").applyInArrow(places_by_doc, "doc_id long, places array<int>")


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``docs`` with their places; the text only where there are any. The outer join shuffles
    the same rows as the join that applies the result later, so Spark shuffles texts once."""
    return docs.join(places, "doc_id", "left").withColumn("text", F.when(F.col("places").isNotNull(), F.col("text")))


def spots(batch: pa.RecordBatch, off: np.ndarray) -> np.ndarray:
    """The places of all rows, as offsets into the batch."""
    found = [p.values.to_numpy() + off[i] for i, p in enumerate(batch.column("places")) if p.is_valid]
    return np.concatenate(found) if found else np.empty(0, np.int64)
