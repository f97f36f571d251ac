"""Exact removal of word runs that an earlier document holds (seed and extend).

``remove_repeats``: words are runs of bytes other than \\x20 and \\x09-\\x0D.
Each word covered by ``length`` consecutive words whose sequence also starts
in a document with a smaller ``doc_id`` goes.

Seeds are winnowed anchors: ``k`` words of least hash per window, so equal
windows hold equal anchors. Documents that share an anchor with another one
extend it both ways: the words around it form a segment that holds all of the
anchor's windows, and the segments of an anchor meet in its shard, where equal
windows form classes. A window whose class has a smaller document is covered;
neighbouring covered windows join to maximal repeats.

Null text has no words. Rows with a null ``doc_id`` take no part and keep all.
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
from panelcast.llm.suffix_dedup import SPANS, TOLD, deal_told, pack_told, row_spans, spans_by_doc, unpack_told
from panelcast.llm.vec import U

WINDOWS = "bucket int, one binary, two binary, doc binary, mark binary, place binary, told binary"
FLUSH_WINDOWS = 1 << 20


def _words(batch: pa.RecordBatch):
    data, off = vec.text_bytes(batch.column("text"))
    start, end, row = vec.word_bounds(data, off)
    return data, start, end, row


def _seeds(data, start, end, row, k, length):
    spans = vec.Spans(vec.byte_spans(data).at(start, end))
    windows, anchor = anchors.winnow(spans.every(k), row, k, length)
    return spans, windows, anchor


def find_anchors(k: int, length: int):
    def find(batches: Iterator[pa.RecordBatch]):
        for batch in vec.slices(batches, "text"):
            data, start, end, off = _words(batch)
            spans, _, anchor = _seeds(data, start, end, off, k, length)
            at = anchor[vec.runs(anchor)]
            if len(at):
                row = np.searchsorted(off, at, "right") - 1
                yield spans.at(at, at + k), vec.ids(batch.column("doc_id"))[row], at - off[row]
    return find


def window_rows(k: int, length: int, n_buckets: int):
    """The windows around shared anchors, dealt by anchor; of windows equal within a
    flush those of the smallest document travel, the others are told at once."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("one", "two", "doc", "mark", "place", "told"))])

    def flush(held):
        one, two, doc, mark, place, anchor = (np.concatenate([x[i] for x in held]) for i in range(6))
        order = np.lexsort((doc, two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
        least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        late = np.zeros(len(doc), bool)
        late[order] = doc[order] > least
        bucket = ((anchor >> U(50)) % U(n_buckets)).astype(np.int64)
        keep = np.flatnonzero(~late)
        keep = keep[np.lexsort((place[keep], doc[keep], bucket[keep]))]
        at = vec.runs(bucket[keep])
        rows = []
        for a, b in zip(at, np.r_[at[1:], len(keep)]):
            x = keep[a:b]
            rows.append((int(bucket[x[0]]), one[x].tobytes(), two[x].tobytes(), planes(np.diff(doc[x], prepend=0), 8),
                         planes(mark[x], 4), planes(place[x], 4), b""))
        told = joined(doc[late], mark[late], place[late], length)
        rows.append((-1 - int(one[0] % U(n_buckets)), b"", b"", b"", b"", b"", pack_told(told)))
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in vec.slices(batches, "text"):
            data, start, end, off = _words(batch)
            spans, windows, anchor = _seeds(data, start, end, off, k, length)
            if not len(windows):
                continue
            hit = np.isin(anchor, anchors.spots(batch, off))
            windows, anchor = windows[hit], anchor[hit]
            if not len(windows):
                continue
            row = np.searchsorted(off, windows, "right") - 1
            second = vec.Spans(vec.byte_spans(data, 1).at(start, end), 1)
            held.append((spans.at(windows, windows + length), second.at(windows, windows + length),
                         vec.ids(batch.column("doc_id"))[row], batch.column("mark").to_numpy()[row],
                         windows - off[row], spans.at(anchor, anchor + k)))
            count += len(windows)
            if count >= FLUSH_WINDOWS:
                yield flush(held)
                held, count = [], 0
        if held:
            yield flush(held)
    return run


def joined(doc: np.ndarray, mark: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Maximal repeats: neighbouring covered windows of a document as one span."""
    order = np.lexsort((place, mark, doc))
    doc, mark, place = doc[order], mark[order], place[order]
    cut = np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (place[1:] != place[:-1] + 1)][:len(doc)]
    a = np.flatnonzero(cut)
    b = np.r_[a[1:], len(doc)] - 1
    out = np.empty(len(a), TOLD)
    out["doc"], out["mark"], out["start"] = doc[a], mark[a], place[a]
    out["stop"] = place[b] + length if len(a) else 0
    return out


def match_shard(length: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        told = [unpack_told(r["told"]) for r in rows if r["told"]]
        full = [r for r in rows if r["one"]]
        if full:
            one, two = (np.concatenate([np.frombuffer(r[c], "<u8") for r in full]) for c in ("one", "two"))
            mark, place = (np.concatenate([unplanes(r[c], 4).astype(np.int64) for r in full]) for c in ("mark", "place"))
            doc = np.concatenate([np.cumsum(unplanes(r["doc"], 8).view(np.int64)) for r in full])
            order = np.lexsort((doc, two, one))
            one, two, doc, mark, place = one[order], two[order], doc[order], mark[order], place[order]
            new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
            late = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            told.append(joined(doc[late], mark[late], place[late], length))
        return deal_told(np.concatenate(told), parts)
    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                    ("kept_sha256", pa.string()), ("kept", pa.string())])


def apply_spans(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.slices(batches, "text", 1 << 23):
            out = []
            texts = batch.column("text").to_pylist()
            for doc, text, (a, b) in zip(batch.column("doc_id").to_pylist(), texts, row_spans(batch)):
                words = text.encode().split() if text else []  # bytes split at the six ASCII spaces alone
                n, gone = len(words), 0
                if len(a):
                    covered = vec.cover(a, b, n)
                    gone = int(covered.sum())
                    words = [words[i] for i in np.flatnonzero(~covered).tolist()]
                kept = b" ".join(words)
                out.append((doc, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), RESULT)], schema=RESULT)
    return run


def remove_repeats(docs: DataFrame, length: int = 13, k: int = 5, keep_text: bool = False) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 and, if asked for, the kept words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = anchors.shared_places(docs, find_anchors(k, length))
    marked = docs.withColumn("mark", F.crc32(F.coalesce("text", F.lit(""))))
    n = anchors.buckets(docs.sparkSession, 1)
    told = (anchors.with_places(marked, places).mapInArrow(window_rows(k, length, n), WINDOWS)
            .groupBy("bucket").applyInArrow(match_shard(length, n), anchors.ANSWER_DDL)
            .groupBy("part").applyInArrow(spans_by_doc, SPANS))
    done = marked.join(told, "doc_id", "left").mapInArrow(
        apply_spans(keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if keep_text else done.drop("kept")
