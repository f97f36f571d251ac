"""Mixing, WARC index, top-k, decontamination, personal data and url filter against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest
from brute import decontaminated, luhn, mixture, private
from pyspark.sql import functions as F
from test_dedup_exact import key, same

from panelcast.llm import block_topk, bloom_cascade, bootstrap_pii, mixing, oracles, warc, winnowing
from panelcast.llm.queries import QUERIES

DOCS = "doc_id long, text string, mark int, hits string, item_id long, rest long, n_taken long"


def more(rows):
    """Rows with extra columns whose names clash with inner ones."""
    return [(*r, i, "x", None, 5, None) for i, r in enumerate(rows)]


# -- mixing -----------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_mixing_budgets(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        domain, lang = rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None])
        source = rng.choice(["hot", "s1", "s2", "s3"]) if rng.random() < 0.7 else "hot"
        rows.append((i // 2 if i < 20 else i, f"t{i}", domain, lang, source, rng.choice([0, 1, 5, 40, 300]), "clash", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string, n_tokens long, _x string, n_prefix int")
    weight = {"a": 5, "b": 0, "c": 2, None: 3}
    weights = [F.when(F.col("domain") == "a", 5).when(F.col("domain") == "b", 0).when(F.col("domain") == "c", 2).otherwise(3),
               F.when(F.col("lang") == "x", 3).otherwise(1), F.lit(1)]
    total = sum(r[5] for r in rows)
    budget, epochs = rng.choice([total // 3, total, 10 * total, 7]), 3
    got = mixing.mix(docs, ["domain", "lang", "source"], weights, F.lit(budget), epochs=epochs, seed=1).collect()
    assert len(got) == len(rows)
    supply = {}
    for r in rows:
        if r[5] and weight[r[2]]:
            supply[r[2:5]] = supply.get(r[2:5], 0) + r[5]
    want = mixture({p: (weight[p[0]], 3 if p[1] == "x" else 1, 1, s * epochs) for p, s in supply.items()},
                   min(budget, sum(supply.values()) * epochs))
    taken, partial = {}, {}
    for r in got:
        path = (r.domain, r.lang, r.source)
        taken[path] = taken.get(path, 0) + r.n_taken
        assert r.n_taken == r.n_epochs * r.n_tokens + r.n_prefix and 0 <= r.n_prefix <= r.n_tokens
        partial[path] = partial.get(path, 0) + (0 < r.n_prefix < r.n_tokens)
    assert {p: t for p, t in taken.items() if t} == {p: t for p, t in want.items() if t}
    assert max(partial.values()) <= 1  # a prefix cuts one document at most


def test_mixing_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, n_tokens long")
    assert mixing.mix(docs, ["lang"], [F.lit(1)], F.col("total")).count() == 0
    none = spark.createDataFrame([(1, None, "en", 0)], docs.schema)
    assert [r.n_taken for r in mixing.mix(none, ["lang"], [F.lit(1)], F.col("total")).collect()] == [0]


# -- WARC -------------------------------------------------------------------

def test_warc_round_trip(spark):
    rng = random.Random(2)
    body = ["", None, "a", "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "x\n" * 5000, "\r\n", "one", "long " * 100000]
    rows = [(i, rng.choice(["http://B.example.com/x", "https://a.example.org/é?q#f", None, "no scheme", "http://e.net/a\r\nb"]),
             rng.choice(body)) for i in rng.sample(range(-50, 3000), 700)]
    rows += [rows[0], rows[0], (None, "http://z.org", "one"), (None, None, "only null")]
    pages = spark.createDataFrame([(*r, "2024-01-01T00:00:%02dZ" % rng.randrange(60), "clash") for r in rows],
                                  "page_id long, url string, payload string, time string, sha string").repartition(5)
    got = warc.archive_and_index(pages).orderBy("part", "pos").collect()
    order = [warc._key((r.urlkey, r.time, r.page_id)) for r in got]
    assert order == sorted(order) and len({r.part for r in got}) > 1
    first = {}
    for p, _, b in rows:
        if p is not None:
            first[b or ""] = min(first.get(b or "", p), p)
    want = []
    for p, _, b in rows:
        raw, head = (b or "").encode(), first.get(b or "")
        new = head is None or p == head
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if new else "revisit", None if new else head))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[c] for c in cols) for r in got), key=key) == sorted(want, key=key)
    empty = spark.createDataFrame([], pages.schema)
    assert warc.archive_and_index(empty).count() == 0


def test_loser_tree_and_runs():
    rng = random.Random(4)
    for n in range(0, 12):
        runs = [sorted(rng.choices(range(20), k=rng.randrange(0, 9))) for _ in range(n)]
        tree, out = warc.LoserTree([iter([(x,) for x in r]) for r in runs]), []
        while tree.head() is not None:
            out.append(tree.pop()[0])
        assert out == sorted(x for r in runs for x in r)


def test_damaged_archive(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/", "payload", "2024-01-01T00:00:00Z")], "page_id long, url string, payload string, time string")
    bad = warc.records(pages).select(F.replace("record", F.lit("payload\r"), F.lit("payl0ad\r")))
    bad.write.option("compression", "gzip").text(str(tmp_path / "w"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, str(tmp_path / "w")).collect()


# -- top-k ------------------------------------------------------------------

def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.uniform(-1, 1)]) for _ in range(rng.choice([8, 8, 8, 3]))], 1) for i in rng.sample(range(6000), 3000)]
    rows += [(50 * i, rows[0][1], 2) for i in range(130, 135)] + [(None, rows[0][1], 0), (7001, None, 0), (7050, None, 0), (7100, [], 1)]
    rows += [(7002, [1.0, None], 0), (7003, [float("nan")], 0), (7004, [float("inf")], 0), (7005, [1e300] * 8, 0), rows[5], rows[5]]
    rows += [(7006, [5e9], 0), (7007, [6e9], 0), (7150, [1.0], 0), (7200, [1e300, -1e300], 0), (7008, [-1e300], 0), (7250, [3e15, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4)
    top = float(block_topk.CLAMP)
    whole = {}
    for i, e, _ in rows:
        if i is not None and e is not None and all(x is not None and abs(x) < float("inf") for x in e):
            whole[i, tuple(e)] = [int(max(-top, min(top, 256 * x // 1))) for x in e]
    want = []
    for (q, e), a in whole.items():
        if q % 50 == 0:
            scored = sorted((-max(-block_topk.MOST, min(block_topk.MOST, sum(x * y for x, y in zip(a, b)))), i) for (i, _), b in whole.items() if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    same(block_topk.top_k(frame), want)
    assert block_topk.top_k(spark.createDataFrame([], frame.schema)).count() == 0
    assert block_topk.top_k(frame.where("vec_id = 50 * 130")).count() == 0


def test_top_k_broadcasts_no_query_packs(spark):
    """The packs are copied for each group, which Spark's estimate of their size leaves out."""
    got = block_topk.top_k(spark.createDataFrame([(i, [i / 7, 1.0]) for i in range(120)], "vec_id long, embedding array<double>"))
    assert len(got.collect()) == 15
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_best_of_many_ties():
    rng = np.random.default_rng(3)
    ids, qid = rng.permutation(900).astype(np.int64), np.arange(0, 900, 50)
    v, q = rng.integers(-2, 3, (900, 3)).astype(float), rng.integers(-1, 2, (18, 3)).astype(float)
    for n in (900, 257, 4, 1):
        got = {}
        for a, i, s in zip(*(x.tolist() for x in block_topk.best(qid, q, ids[:n], v[:n], 5))):
            got.setdefault(a, []).append((-s, i))
        for a, x in zip(qid.tolist(), q):
            assert got.get(a, []) == sorted((-int(x @ y), i) for i, y in zip(ids[:n].tolist(), v[:n]) if i != a)[:5]


# -- decontamination --------------------------------------------------------

@pytest.mark.parametrize("mark", ["'", ".", ":", "^", "-", "'́"])
def test_letters_beside_marks(spark, mark):
    """Windows whose letters lower-case differently beside other letters."""
    ten = " ".join(f"w{i}" for i in range(9)) + " ΑΣ"
    items = [(1, ten), (2, " ".join(["ΑΣ"] * 10)), (3, "ΟΔΟΣ"), (4, "İİ I" + " x" * 9)]
    docs = [(1, ten + mark + "Β rest", "en", "s", 1), (2, mark.join(["ΑΣ"] * 10), "en", "s", 1), (3, f"a ΟΔΟΣ{mark}Α b", "en", "s", 1),
            (4, "İİ i" + " X" * 9, "en", "s", 1), (5, ten.lower(), "en", "s", 1)]
    items, kept = spark.createDataFrame(items, "item_id long, text string"), []
    got = winnowing.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), items)
    same(got, decontaminated([d[:2] for d in docs], [tuple(r) for r in items.collect()]))

def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "BETA", "gamma", "É", "x9", "7", "delta-e", "zeta"]) + str(rng.randrange(60))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, " .,- "), (None, "null id item " * 5), (103, items[0][1]), (104, "K a b c d e f g h i j")]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(0, 80))]
        if i % 3:
            t = rng.choice(items[:40])[1].split()
            a = rng.randrange(len(t))
            w[rng.randint(0, len(w)):0] = t[a:a + rng.choice([5, 9, 10, 12, 40])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).swapcase() if i % 5 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "k a b c d e f g h i j"), (503, items[4][1] * 3000), (None, items[5][1]), (None, "clean text"),
             (7, items[6][1]), (7, "nothing here"), docs[1], docs[1]]
    frame = spark.createDataFrame(more(docs), DOCS).repartition(3)
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, len int")
    same(winnowing.decontaminate(frame, bench), decontaminated(docs, items))
    assert winnowing.decontaminate(frame.limit(0), bench).count() == 0
    same(winnowing.decontaminate(frame, bench.limit(0)), decontaminated(docs, []))
    left = winnowing.remove_contaminated(frame, bench)
    assert left.columns == frame.columns
    assert sorted((r[:2] for r in left.collect()), key=key) == sorted(
        (d for d, r in zip(docs, decontaminated(docs, items)) if not r[-1]), key=key)


# -- personal data ----------------------------------------------------------

TEXTS = [None, "", "a@b.c x.y@z", "mail me: joe.doe+1@mail-x.example.com, thanks", "a@b@c.d", "a@b.c_d@e.f", "1.2.3.4.5 256.1.1.1 1.1.1.0255 01.02.03.04",
         "1.2.3 4.5.6.7", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999, +12, +1234567890123456", "é😀 +49 30 123456789 ü a@é.de",
         "9" * 20000, "1.1." * 5000, "a" * 30000 + "@", "@" * 3000 + "a.b", "+1((((((" * 800, "x" * 50000 + "@y.zz", "1-1" * 40, "79927398713 0000000000000000", "a%@b-.c-d e@f.g.h."]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_base_spans(i):
    want = private(TEXTS[i])[0] if TEXTS[i] is None or len(TEXTS[i]) < 45000 else [(0, 0, 50005)]
    assert bootstrap_pii.base_spans(TEXTS[i] or "") == want


def test_private(spark):
    rng = random.Random(1)
    cards = [c for c in (f"4{rng.randrange(10 ** 15):015d}" for _ in range(400)) if luhn(c)][:24]
    docs = [(i, t) for i, t in enumerate(TEXTS[:10])] + [(None, "ip 10.0.0.1"), (3, "x@y.zz"), (3, "x@y.zz"), (3, "other 1.2.3.4")]
    docs += [(100 + i, f"text {i} pay by card {c} please now") for i, c in enumerate(cards)]
    docs += [(200, "again pay by card 9999-8888-7777 please now"), (201, "the year 1999 was clean 9999"), (202, "by car 12345 please")]
    frame = spark.createDataFrame(more(docs), DOCS).repartition(3)
    got = bootstrap_pii.find_private(frame).collect()
    assert len(got) == len(docs)
    want = []
    for d, t in docs:
        spans, text = private(t)
        if d == 200:
            a = t.index("9999-")
            text = f"card:{a}:{a + 14}"
        want.append((d, *(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(private(t)[1].encode()).hexdigest(), text))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bootstrap_pii.find_private(frame.limit(0)).count() == 0
    clean = bootstrap_pii.redact(frame)
    assert clean.columns == frame.columns
    by_id = {r.doc_id: r.text for r in clean.where("doc_id >= 4").collect()}
    assert by_id[200] == "again pay by card <CARD> please now" and by_id[201] == docs[-2][1] and by_id[4] == "a@<EMAIL>"


def test_private_query(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op5_bootstrapped_pii"](spark, sf_small).collect()}
    for d, t in rows:
        spans, text = private(t)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[d].spans.split(","))
        assert [got[d][f"n_{k}"] for k in bootstrap_pii.KINDS] == [sum(k == i for _, k, _ in spans) for i in range(4)]


# -- url filter -------------------------------------------------------------

def test_urls(spark):
    urls = [None, "", "no", "http://a.net/", "http://A.NET/x?y#z", "https://x.example.net/en/1", "https://x.example.net/fr/1", "http://net/", "http://net",
            "http://org/fr/", "http://example.com/de/x", "http://b.example.com/de", "x://y://z/q", "http://free-bets.example.com/a", "http://e.org?x=/a",
            "http://notnet/", "http://É.Ä.net/\n/x", "://h/p", "http://" + "a" * 50000 + ".net/" + "p" * 50000]
    rows = [(i, u, "clash", i) for i, u in enumerate(urls + urls)] + [(None, "http://a.net/", None, 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, w0 int").repartition(3)
    import re
    want = []
    for i, u, _, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        best = max((r for r in oracles.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])),
                   key=lambda r: len(r[1] + r[2]), default=None)
        listed = host.startswith("free-bets.")
        want.append((i, host, path, best and best[1] + best[2], best[0] if best else "block" if listed else "allow", listed))
    same(bloom_cascade.judge(frame, F.col("key").startswith("free-bets."), oracles.RULES), want)
    assert bloom_cascade.judge(frame.limit(0), F.lit(True), oracles.RULES).count() == 0


@pytest.mark.parametrize("shard_keys", [10 ** 6, 300])
def test_cascade_is_exact(spark, shard_keys):
    keys = spark.range(4000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 5 == 0).alias("listed"))
    cascade = bloom_cascade.Cascade(keys, shard_keys)
    assert len(cascade.levels) > 1 and (cascade.shards > 1) == (shard_keys == 300)
    got = cascade.lookup(keys, "key", "in")
    assert got.where("in <> listed").count() == 0 and got.count() == 4000
    for listed in (F.lit(True), F.lit(False)):
        all_one = keys.withColumn("listed", listed)
        assert bloom_cascade.Cascade(all_one).lookup(all_one, "key", "in").where("in <> listed").count() == 0
