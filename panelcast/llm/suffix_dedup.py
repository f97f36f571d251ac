"""Exact removal of byte strings that an earlier document holds (suffix arrays).

``remove_repeats`` treats texts as UTF-8. Every byte covered by a ``length``
-byte string that also starts in a document with a smaller ``doc_id`` goes.

Documents are cut around the winnowed anchors they share with others, into
segments that hold all windows of an anchor; equal windows hold equal
anchors, so a segment's shard (by anchor) sees every equal window. Each shard
sorts its distinct segments' suffixes by induction; neighbours with a common
prefix of ``length`` bytes form a class, and a start whose class has a
smaller document is covered.

Null text is empty. Rows with a null ``doc_id`` take no part and keep all.
Rows that repeat a ``doc_id`` never cover each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import anchors, vec
from panelcast.llm.anchors import planes, unplanes
from panelcast.llm.suffix import repeated
from panelcast.llm.vec import U

SEGMENTS = "bucket int, n_bytes int, text binary, shard binary, size binary, doc binary, mark binary, place binary, told binary"
TOLD = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("start", "<i8"), ("stop", "<i8")])
FLUSH_BYTES = 1 << 25
#: A suffix array takes some 60 bytes per byte of its shard, so a bucket is sorted in shards of
#: about so many bytes at most, as many as its size asks for.
SHARD_BYTES = 1 << 21
#: Kinds of anchors that shards are made of; a power of two that fits a byte.
SHARDS = 256


def pack_told(told: np.ndarray) -> bytes:
    """Spans as compressed columns, in order of document and start."""
    told = told[np.lexsort((told["start"], told["doc"]))]
    return anchors.pack(_columns(told))


def unpack_told(data: bytes) -> np.ndarray:
    columns = anchors.unpack(data, 4)
    told = np.empty(len(columns[0]), TOLD)
    for name, c in zip(("doc", "mark", "start", "stop"), columns):
        told[name] = c
    told["stop"] += told["start"]
    return told


def _columns(told: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(x) for x in (told["doc"], told["mark"], told["start"], told["stop"] - told["start"])]


def deal_told(told: np.ndarray, parts: int) -> pa.Table:
    return anchors.deal(_columns(told), parts)


def _windows(batch: pa.RecordBatch, k: int, length: int):
    data, off = vec.text_bytes(batch.column("text"))
    windows, anchor = anchors.winnow(vec.byte_spans(data).every(k), off, k, length)
    return data, off, windows, anchor


def find_anchors(k: int, length: int):
    def find(batches: Iterator[pa.RecordBatch]):
        for batch in vec.slices(batches, "text"):
            data, off, _, anchor = _windows(batch, k, length)
            at = anchor[vec.runs(anchor)]
            if len(at):
                row = np.searchsorted(off, at, "right") - 1
                h = vec.byte_spans(data).every(k)[at]
                yield h, vec.ids(batch.column("doc_id"))[row], at - off[row]
    return find


SEGMENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("n_bytes", pa.int32()),
                            *((c, pa.binary()) for c in ("text", "shard", "size", "doc", "mark", "place", "told"))])


def segment_rows(k: int, length: int, n_buckets: int):
    """Segments around the shared anchors, one row per bucket and flush.

    Of segments equal within a flush those of the smallest document travel;
    the others are covered already and are told so."""
    def flush(held):
        data = np.concatenate([x[0] for x in held])
        size, h1, h2, doc, mark, place, anchor = (np.concatenate([x[i] for x in held]) for i in range(1, 8))
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, h2, h1))
        same = np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
        least = doc[order][np.flatnonzero(same)][np.cumsum(same) - 1]
        late = np.zeros(len(doc), bool)
        late[order] = doc[order] > least
        told = np.empty(int(late.sum()), TOLD)
        for f, v in (("doc", doc), ("mark", mark), ("start", place), ("stop", place + size)):
            told[f] = v[late]
        bucket = ((anchor >> U(50)) % U(n_buckets)).astype(np.int64)
        keep = np.flatnonzero(~late)
        keep = keep[np.lexsort((place[keep], doc[keep], bucket[keep]))]
        at = vec.runs(bucket[keep])
        rows = []
        for a, b in zip(at, np.r_[at[1:], len(keep)]):
            x = keep[a:b]
            n = size[x]
            take = np.repeat(begin[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            shard = (anchor[x] >> U(40)) & U(SHARDS - 1)
            rows.append((int(bucket[x[0]]), len(take), pa.compress(data[take].tobytes(), codec="zstd", asbytes=True), planes(shard, 1),
                         planes(n, 4), planes(np.diff(doc[x], prepend=0), 8), planes(mark[x], 4), planes(place[x], 4), b""))
        rows.append((-1 - int(h1[0] % U(n_buckets)), 0, *[b""] * 6, pack_told(told)))
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), SEGMENT_SCHEMA)], schema=SEGMENT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in vec.slices(batches, "text"):
            data, off, windows, anchor = _windows(batch, k, length)
            at = vec.runs(anchor)
            if not len(at):
                continue
            first = windows[at]
            last = windows[np.r_[at[1:], len(windows)] - 1]
            anchor = anchor[at]
            row = np.searchsorted(off, anchor, "right") - 1
            hit = np.isin(anchor, anchors.spots(batch, off))
            first, stop, anchor, row = first[hit], last[hit] + length, anchor[hit], row[hit]
            if not len(first):
                continue
            size = stop - first
            one, two = vec.byte_spans(data), vec.byte_spans(data, 1)
            take = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            held.append((data[take], size, one.at(first, stop), two.at(first, stop),
                         vec.ids(batch.column("doc_id"))[row], batch.column("mark").to_numpy()[row],
                         first - off[row], one.at(anchor, anchor + k)))
            count += len(take)
            if count >= FLUSH_BYTES:
                yield flush(held)
                held, count = [], 0
        if held:
            yield flush(held)
    return run


def sort_shard(length: int, parts: int):
    """Covered spans of a shard's segments, from its suffix array."""
    def shard(text, size, doc, mark, place) -> list[np.ndarray]:
        told = []
        off = np.r_[0, np.cumsum(size)]
        one, two = (vec.byte_spans(text, i).at(off[:-1], off[1:]) for i in range(2))
        order = np.lexsort((doc, two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
        group = np.cumsum(new) - 1
        lead = order[np.flatnonzero(new)]  # of each distinct segment, one of the smallest document
        late = doc[order] > doc[lead][group]
        told.append(_told(doc, mark, place, size, order[late]))
        n = size[lead]
        take = np.repeat(off[lead] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        distinct = np.r_[0, np.cumsum(n)]
        sa, classes = repeated(text[take], distinct, length)
        if not len(sa):
            return told
        own = doc[lead][np.searchsorted(distinct, sa, "right") - 1]
        least = np.minimum.reduceat(own, classes)
        least = np.repeat(least, np.diff(np.r_[classes, len(sa)]))
        hit = np.sort(sa[least < own])
        if len(hit):
            # Neighbouring starts of one segment make one span.
            seg = np.searchsorted(distinct, hit, "right") - 1
            cut = np.r_[True, (hit[1:] != hit[:-1] + 1) | (seg[1:] != seg[:-1])]
            a = np.flatnonzero(cut)
            b = np.r_[a[1:], len(hit)] - 1
            seg = seg[a]
            begin, stop = hit[a] - distinct[seg], hit[b] + length - distinct[seg]
            # Every entry of the smallest document gets its segment's spans.
            entry, of = order[~late], group[~late]
            lo, hi = np.searchsorted(seg, of), np.searchsorted(seg, of, "right")
            many = hi - lo
            span = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            entry = np.repeat(entry, many)
            more = np.empty(len(entry), TOLD)
            more["doc"], more["mark"] = doc[entry], mark[entry]
            more["start"], more["stop"] = place[entry] + begin[span], place[entry] + stop[span]
            told.append(more)
        return told

    def run(table: pa.Table) -> pa.Table:
        told = [unpack_told(x.as_py()) for x in table.column("told") if x.as_buffer().size]
        n_bytes = table.column("n_bytes").to_numpy()
        full = np.flatnonzero(n_bytes).tolist()
        if full:
            # Row by row into one array: a bucket's texts are never held twice.
            text, end = np.empty(int(n_bytes.sum()), np.uint8), np.cumsum(n_bytes, dtype=np.int64).tolist()
            for i in full:
                text[end[i] - int(n_bytes[i]):end[i]] = np.frombuffer(
                    pa.decompress(table.column("text")[i].as_buffer(), decompressed_size=int(n_bytes[i]), codec="zstd"), np.uint8)
            of, size, mark, place = (np.concatenate([unplanes(table.column(c)[i].as_buffer(), w).astype(kind) for i in full])
                                     for c, w, kind in (("shard", 1, np.uint8), ("size", 4, np.int64), ("mark", 4, np.int64), ("place", 4, np.int64)))
            doc = np.concatenate([np.cumsum(unplanes(table.column("doc")[i].as_buffer(), 8).view(np.int64)) for i in full])
            at = np.cumsum(size) - size
            shards = 1
            while shards < SHARDS and len(text) > shards * SHARD_BYTES:
                shards *= 2
            of &= np.uint8(shards - 1)
            for i in range(shards):
                x = np.flatnonzero(of == i)
                if len(x):
                    n = size[x]
                    take = np.repeat(at[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    told += shard(text[take], n, doc[x], mark[x], place[x])
        return deal_told(np.concatenate(told), parts)
    return run


def _told(doc, mark, place, size, x) -> np.ndarray:
    out = np.empty(len(x), TOLD)
    out["doc"], out["mark"], out["start"], out["stop"] = doc[x], mark[x], place[x], place[x] + size[x]
    return out


SPANS = "doc_id long, spans array<struct<mark:long,start:int,size:int>>"


def spans_by_doc(table: pa.Table) -> pa.Table:
    """One row per document with all its spans."""
    told = np.concatenate([unpack_told(x) for x in table.column("told").to_pylist()])
    told = told[np.argsort(told["doc"], kind="stable")]
    at = vec.runs(told["doc"])
    doc, mark, start, size = _columns(told)
    parts = pa.StructArray.from_arrays([pa.array(mark), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["mark", "start", "size"])
    return pa.table({"doc_id": pa.array(doc[at]), "spans": pa.ListArray.from_arrays(pa.array(np.r_[at, len(doc)].astype(np.int32)), parts)})


def row_spans(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and stops told for each row, where the row's mark agrees."""
    spans, marks = batch.column("spans"), batch.column("mark").to_numpy()
    none = np.empty(0, np.int64)
    for i in range(batch.num_rows):
        s = spans[i].values
        if s is None or not len(s):
            yield none, none
            continue
        ok = s.field("mark").to_numpy() == marks[i]
        start = s.field("start").to_numpy()[ok].astype(np.int64)
        yield start, start + s.field("size").to_numpy()[ok]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                    ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def apply_spans(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.slices(batches, "text", 1 << 23):
            data, off = vec.text_bytes(batch.column("text"))
            out = []
            for i, (doc, (a, b)) in enumerate(zip(batch.column("doc_id").to_pylist(), row_spans(batch))):
                text = data[off[i]:off[i + 1]]
                n_removed = n_spans = 0
                kept = text.tobytes()
                if len(a):
                    gone = vec.cover(a, b, len(text))
                    n_removed, n_spans = int(gone.sum()), int((gone[1:] > gone[:-1]).sum() + gone[0])
                    kept = text[~gone].tobytes()
                out.append((doc, len(text), n_removed, n_spans, hashlib.sha256(kept).hexdigest(),
                            kept if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), RESULT)], schema=RESULT)
    return run


def remove_repeats(docs: DataFrame, length: int = 50, k: int = 20, keep_text: bool = False) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    ``docs`` has ``doc_id`` and ``text``. ``length`` is the least repeat in
    bytes (8 or more), ``k`` the anchor's size (``length - 63`` to ``length``).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = anchors.shared_places(docs, find_anchors(k, length))
    marked = docs.withColumn("mark", F.crc32(F.coalesce("text", F.lit(""))))
    n = anchors.buckets(docs.sparkSession, 1)
    segments = anchors.with_places(marked, places).mapInArrow(segment_rows(k, length, n), SEGMENTS)
    told = (segments.groupBy("bucket").applyInArrow(sort_shard(length, n), anchors.ANSWER_DDL)
            .groupBy("part").applyInArrow(spans_by_doc, SPANS))
    done = marked.join(told, "doc_id", "left").mapInArrow(
        apply_spans(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if keep_text else done.drop("kept")
