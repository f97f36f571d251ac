"""The corpus pipeline, stage by stage, against brute force; edge rows through all stages."""

import re

import corpus_pipeline as P
import pyarrow as pa
from brute import decontaminated, mixture, near_components, private
from test_dedup_exact import key

from panelcast.llm import oracles


def redacted(text):
    out, at = "", 0
    for a, k, b in private(text)[0]:
        if a >= at:
            out += text[at:a] + ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")[k]
        at = max(at, b)
    return out + text[at:]


def stage_rows(spark, sf, docs, limit_to=4):
    out = []
    for _, stage in P.STAGES[:limit_to]:
        docs = P.written(stage(spark, docs, sf))
        out.append(docs)
    return out


def test_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    want = [[(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]]
    want.append([r for r, c in zip(want[-1], near_components(want[-1])) if c[-1]])
    want.append([r for r, c in zip(want[-1], decontaminated(want[-1], items)) if not c[-1]])
    want.append([(d, redacted(t)) for d, t in want[-1]])
    assert len(want[3]) < len(want[1]) < len(rows)
    for df, w in zip(stage_rows(spark, sf_small, docs), want):
        assert df.columns == docs.columns
        got = df.collect()
        assert sorted((r.doc_id, r.text) for r in got) == w
        assert all(r.n_chars == len(r.text) for r in got if "<" in r.text)
    leaves, clean = {}, {r.doc_id: r for r in got}
    for r in got:
        domain = oracles.DOMAINS[int(re.search("[0-9]+$", r.source)[0]) % 3]
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        path = (domain, r.lang, r.source)
        w = (oracles.DOMAIN_WEIGHTS[domain], oracles.LANG_WEIGHTS[r.lang], 1)
        leaves[path] = (*w, leaves.get(path, (0, 0, 0, 0))[3] + n * oracles.EPOCHS)
    last = P.run(spark, sf_small).collect()
    taken = {}
    for r in last:
        assert r.text == clean[r.doc_id].text and r.n_taken > 0
        taken[r.domain, r.lang, r.source] = taken.get((r.domain, r.lang, r.source), 0) + r.n_taken
    total = sum(v[3] for v in leaves.values()) // oracles.EPOCHS
    assert taken == {p: t for p, t in mixture(leaves, total).items() if t}


def test_edge_rows(spark, sf_small):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, "en", "src1", 0, "x"), (2, "", None, None, None, "x"), (3, "123 !", "en", "src2", 5, None), (4, passage, "en", "src3", 1, "y"),
            (4, passage, "en", "src3", 1, "y"), (5, passage + " more", None, None, None, "z"), (None, "text without an id a@b.cc", "fr", "odd", 3, None),
            (6, "mail x@y.example.org now", "xx", "src999999", 1, "n"), (7, "long " * 30000, "de", "src4", 1, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark string")
    stages = stage_rows(spark, sf_small, docs, 5)
    assert all(s.columns == docs.columns for s in stages[:4])
    assert sorted((r.doc_id for r in stages[3].collect()), key=lambda x: key((x,))) == [None, 4, 6, 7]
    assert {r.text for r in stages[3].where("doc_id = 6").collect()} == {"mail <EMAIL> now"}
    assert stage_rows(spark, sf_small, docs.limit(0), 5)[-1].count() == 0


def test_workers_get_few_texts_at_a_time(spark, sf_small):
    """Neither many short texts nor a few long ones meet in one batch, whatever the session said."""
    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.column("text").nbytes]})

    wide = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "64m"}
    was = {key: spark.conf.get(key) for key in wide}
    docs = spark.range(0, 1, numPartitions=1).selectExpr("id AS doc_id", "'plain words' AS text", "'en' AS lang", "'src1' AS source", "11L AS n_chars")
    short = spark.range(0, 9000, 1, 1).selectExpr("concat('text ', id) AS text")
    long = spark.range(0, 60, 1, 1).selectExpr("repeat(concat('text ', id, ' '), 20000) AS text")
    try:
        for _, stage in P.STAGES:
            for key, value in wide.items():
                spark.conf.set(key, value)
            stage(spark, docs, sf_small)
            got = [r for df in (short, long) for r in df.mapInArrow(seen, "n long, size long").collect()]
            assert sum(r.n for r in got) == 9060
            assert max(r.n for r in got) <= 2000 and max(r["size"] for r in got) <= 1 << 22
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
