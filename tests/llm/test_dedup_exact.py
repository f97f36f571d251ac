"""Byte and word repeats against brute force: the sf0.001 table, planted and edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import byte_dedup, word_dedup

from panelcast.llm import substring_dedup, suffix_dedup
from panelcast.llm.queries import QUERIES
from panelcast.llm.suffix import repeated

DDL = "doc_id long, text string, bucket int, mark string, n_words long"


def key(r):
    return tuple((x is not None, x) for x in r)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def edge_rows():
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60))
    near = passage.split()
    near[30] = "changed"
    rows = [(7, passage), (3, "x " + passage), (3, passage + " tail"), (9, passage), (9, passage), (4, " ".join(near)),
            (1, None), (2, ""), (5, " \t\n\x0b\x0c\r "), (6, "a" * 400), (8, "a" * 120), (11, "a" * 49), (12, "ab " * 300),
            (13, "ab " * 20), (None, passage), (None, None), (14, "one two"), (15, "\x00\x01" * 90), (16, "z y " * 40),
            (17, passage[:200] + passage[100:]), (-5, passage[20:400]), (18, " ".join(str(i) for i in range(30000)))]
    return [(d, t, i, "clash", None) for i, (d, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(12))
def test_suffix_classes(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 2, 4, 26])
    rows = [bytes(97 + rng.randrange(size) for _ in range(rng.randint(0, 250))) for _ in range(rng.randint(1, 6))]
    length = rng.choice([3, 8, 13, 50])
    off = np.r_[0, np.cumsum([len(r) for r in rows])]
    order, at = repeated(np.frombuffer(b"".join(rows), np.uint8), off, length)
    got = sorted(sorted(order[a:b].tolist()) for a, b in zip(at, np.r_[at[1:], len(order)]))
    want = {}
    for i, r in enumerate(rows):
        for j in range(len(r) - length + 1):
            want.setdefault(r[j:j + length], []).append(int(off[i]) + j)
    assert got == sorted(want.values())


def test_edges(spark):
    rows = edge_rows()
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    pairs = [r[:2] for r in rows]
    same(suffix_dedup.remove_repeats(docs), byte_dedup(pairs))
    same(substring_dedup.remove_repeats(docs), word_dedup(pairs))
    empty = spark.createDataFrame([], DDL)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_kept_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "x a b c d e f g h i j k l m n y")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substring_dedup.remove_repeats(docs, keep_text=True).collect()}
    assert got == {1: "a b c d e f g h i j k l m n", 2: "x y"}


def test_queries(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op7_suffix_array_dedup"](spark, sf_small), byte_dedup(rows))
    same(QUERIES["op8_substring_dedup"](spark, sf_small), word_dedup(rows))


def bucket(sizes, anchors, texts):
    """One bucket's table of segments of document 1, 2, …, as ``segment_rows`` packs them."""
    planes = suffix_dedup.planes
    text = b"".join(texts)
    row = (0, len(text), pa.compress(text, codec="zstd", asbytes=True), planes(anchors, 1), planes(sizes, 4),
           planes(np.ones(len(sizes), np.int64), 8), planes(np.zeros(len(sizes)), 4), planes(np.zeros(len(sizes)), 4), b"")
    return pa.table([pa.array([v], f.type) for v, f in zip(row, suffix_dedup.SEGMENT_SCHEMA)], schema=suffix_dedup.SEGMENT_SCHEMA)


def test_shards_follow_the_size_of_a_bucket(monkeypatch):
    """A suffix array is never built over a fixed share of a bucket, however large that is."""
    rng, n, width = np.random.default_rng(1), 100_000, 400
    texts = rng.integers(97, 123, n * width, np.uint8)
    built = []
    monkeypatch.setattr(suffix_dedup, "repeated", lambda data, off, length: built.append(len(data)) or (np.empty(0, np.int64),) * 2)
    suffix_dedup.sort_shard(50, 2)(bucket(np.full(n, width), rng.integers(0, 256, n), [texts.tobytes()]))
    assert sum(built) == n * width and max(built) < 3 << 20


@pytest.mark.parametrize("shard_bytes", [1 << 21, 300, 1])
def test_spans_are_the_same_in_any_number_of_shards(monkeypatch, shard_bytes):
    rng = random.Random(4)
    passages = ["".join(rng.choice("abc") for _ in range(90)) for _ in range(20)]
    held = [(i, p) for i, p in enumerate(passages) for _ in range(4)]
    rng.shuffle(held)
    texts = [("".join(rng.choice("xyz") for _ in range(rng.randrange(9))) + p[rng.randrange(20):]).encode() for _, p in held]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
    table = bucket(np.array([len(t) for t in texts]), np.array([i for i, _ in held]), texts)
    got = set()
    for part in suffix_dedup.sort_shard(50, 1)(table).column("told").to_pylist():
        for doc, _, start, stop in suffix_dedup.unpack_told(part).tolist():
            got |= {(doc, i) for i in range(start, stop)}
    want, seen = set(), set()
    for doc, t in enumerate(texts, 1):
        now = {t[i:i + 50]: None for i in range(len(t) - 49)}
        want |= {(doc, i + j) for i in range(len(t) - 49) if t[i:i + 50] in seen for j in range(50)}
        seen |= now.keys()
    assert got == want and want
