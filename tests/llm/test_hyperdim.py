"""Language profiles: held-out accuracy, independence of labels, edge cases."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from panelcast.llm import hyperdim
from panelcast.llm.queries import QUERIES

DDL = "doc_id long, text string, lang string, source string, score string"



def test_query(spark, sf_dir="/root/testdata/sf0.01"):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op9_hyperdimensional_language_id"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.held_out and r.lang_pred != "und":
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert right >= 0.95 * total > 0


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", None, "x"), (2, "le chat et la souris", "fr", "s", None),
            (3, None, "en", None, None), (4, "", None, None, None), (6, "12 34 !?", "fr", None, None),
            (7, "the", None, None, None), (None, "the cat", "fr", None, None), (8, "é", "fr", None, None),
            (9, "the cat " * 20000, "en", None, None), (9, "the cat " * 20000, "en", None, None)]
    got = {(r.doc_id, r.lang_pred) for r in hyperdim.identify(spark.createDataFrame(rows, DDL).repartition(3)).collect()}
    assert {(3, "und"), (4, "und"), (6, "und"), (7, "en"), (9, "en"), (None, "en")} <= got
    assert hyperdim.identify(spark.createDataFrame([], DDL)).count() == 0
    none = spark.createDataFrame([(1, "abc", None, None, None)], DDL)
    assert [(r.lang_pred, r.score) for r in hyperdim.identify(none).collect()] == [("und", 0.0)]


def test_bundle_is_the_sum_of_bound_trigrams():
    import pyarrow as pa
    code, off, letters = hyperdim.trigrams(pa.array(["Ab, c!", None, "é"]))
    assert letters.tolist() == [True, False, True]
    s = hyperdim.SYMBOLS
    symbol = [0, 1, 2, 0, 3, 0]
    assert code[off[0]:off[1]].tolist() == [(a * s + b) * s + c for a, b, c in zip(symbol, symbol[1:], symbol[2:])]
    v = hyperdim.trigram_vectors()
    letters = np.random.default_rng(2024).choice(np.array([-1, 1], np.int8), (s, hyperdim.DIMS))
    assert (v[(1 * s + 2) * s + 3] == np.roll(letters[1], 2) * np.roll(letters[2], 1) * letters[3]).all()


def test_other_letters_are_told_apart(spark):
    """Every letter is a symbol of its own, also where scripts or languages differ in few letters."""
    import pyarrow as pa
    code, off, _ = hyperdim.trigrams(pa.array(list("éöäñíúжшαβあいאב中文")))
    assert len(set(code.tolist())) == off[-1] == 16
    v = hyperdim.letter_vectors(code >> hyperdim.WIDE).astype(int)
    assert np.abs(v @ v.T - hyperdim.DIMS * np.eye(16, dtype=int)).max() < 5 * hyperdim.DIMS ** 0.5
    x, y, z = (hyperdim.letter_vectors(np.array([ord(c) + hyperdim.SYMBOLS]))[0] for c in "жшщ")
    code, _, _ = hyperdim.trigrams(pa.array(["жшщ"]))
    assert (hyperdim.wide_sums(np.r_[code[1:2], code[1:2]], np.array([1, 1]), 2)
            == np.stack([x * 0, 2 * (np.roll(x, 2) * np.roll(y, 1) * z)])).all()
    # Two languages of each script, whose letters lie 13 code points apart.
    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for base in (0x430, 0x3B1, 0x3041, 0x4E00):
        for shift in (0, 13):
            letters = [chr(base + shift + i) for i in range(5)]
            for _ in range(40):
                doc = len(rows)
                truth[doc] = f"{base}-{shift}"
                rows.append((doc, " ".join("".join(rng.choice(letters, 4)) for _ in range(12)), truth[doc], None, None))
    got = [r for r in hyperdim.identify(spark.createDataFrame(rows, DDL)).collect() if r.held_out]
    assert len(got) > 40 and all(r.lang_pred == truth[r.doc_id] for r in got)


def test_memory_does_not_follow_from_the_number_of_rows():
    texts = [f"a short text of number {chr(97 + i % 26)} é" for i in range(10_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    hyperdim.trigram_vectors(), hyperdim._symbols()
    run = hyperdim.predict({"de": np.ones(hyperdim.DIMS), "en": -np.ones(hyperdim.DIMS)})
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch]))) == len(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64e6
