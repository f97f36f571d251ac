"""Prefix trie, Feistel shards and Merkle manifest against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import feistel_shards as fs
from panelcast.llm import merkle, numbering, prefix_trie

CONV = "conv_id long, turn long, role string, text string, name string, shard long, band int"
DOC = "doc_id long, text string, lang string, source string, n_chars long, tree long, part string, _at int, row int"


# ---------------------------------------------------------------- numbering

@pytest.mark.parametrize("ranges", [1, 4, 1000])
def test_numbers_of_hot_groups(spark, ranges):
    rows = [(None if i % 3 == 0 else i % 5, i // 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, o long, x long").repartition(5)
    laid, spans = numbering.laid_out(df, ["g"], ["o", "x"], ranges)
    got = numbering.with_spans(laid, spans, ["g"]).collect()
    groups = defaultdict(list)
    for g, o, x in rows:
        groups[g].append((o, x))
    order = sorted(groups, key=lambda g: (g is not None, g))
    for r in got:
        assert sorted(groups[r["g"]]).index((r["o"], r["x"])) == r["_index"]
        assert r["_size"] == len(groups[r["g"]]) and order.index(r["g"]) == r["_group"]
    assert len(got) == 200


def test_equal_rows_are_split(spark):
    df = spark.createDataFrame([(1,)] * 5000, "g long").repartition(16)
    laid, spans = numbering.laid_out(df, ["g"], [], 500)
    assert sorted(r[0] for r in numbering.with_spans(laid, spans, ["g"]).select("_index").collect()) == list(range(5000))
    assert max(r["_here"] for r in spans.collect()) < 2500


# ---------------------------------------------------------------- trie

def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), key, role, text))
    seq = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in seq.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(np.fix(c / 100)) * 100
        out[c] = tuple(seq.get(base, [])[:h] + turns[h:])
    return out


def plain_trie(rows):
    convs = rebuild(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[convs[c][:d]].append(c)
        ends[convs[c]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * (len(path[-1][1]) if path else 0)
            leaves[path[:d]] += not kids[path]
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def built(df, **how):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in prefix_trie.trie(df, **how).collect())


def talks(seed, n, long=()):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(500, n, replace=False).tolist():
        for t in range(int(rng.integers(0, 7))):
            rows.append((c - 150, t, "user" if t % 2 else "bot", "ab\U0001F600"[: int(rng.integers(0, 4))], "x", 1, 2))
    for c, size in long:
        rows += [(c, t, "user", "é" * (t % 3), "x", 1, 2) for t in range(size)]
    return rows


@pytest.mark.parametrize("shard,band,ranges", [(1, 1, 3), (2, 2, 50), (7, 3, 1000), (1024, 64, 1000)])
def test_trie_is_the_plain_one(spark, shard, band, ranges):
    rows = talks(shard, 60, [(1000, 40), (1001, 40), (1002, 23), (1100, 9)])
    df = spark.createDataFrame(rows, CONV).repartition(3)
    assert built(df, shard=shard, band=band, range_rows=ranges) == plain_trie(rows)


def test_trie_of_very_long_conversations(spark):
    """More bands than a block of bands holds, at two levels."""
    rows = talks(5, 10, [(1000, 300), (1200, 300), (1203, 299)])
    df = spark.createDataFrame(rows, CONV)
    old = prefix_trie._before_and_after
    try:
        prefix_trie._before_and_after = lambda rows, value, fold, fan, f=old: f(rows, value, fold, 4)
        assert built(df, shard=3, band=4) == plain_trie(rows)
    finally:
        prefix_trie._before_and_after = old


def test_trie_edge_cases(spark):
    rows = [(None, 0, "u", "lost", "x", 1, 2), (7, None, None, None, "x", 1, 2), (7, 0, "u", "a", "x", 1, 2), (7, 0, "u", "a", "x", 1, 2),
            (7, 0, "b", "", "x", 1, 2), (8, 5, "u", "z" * 5000, "x", 1, 2), (-3, 1, "u", "neg", "x", 1, 2), (100, 1, "", "ua", "x", 1, 2),
            (101, 1, "u", "a", "x", 1, 2)]
    df = spark.createDataFrame(rows, CONV)
    assert built(df, shard=2, band=2) == plain_trie(rows)
    # 7 has a head of its hundred's first conversation, which is absent: its own first turns go.
    assert prefix_trie.trie(df.limit(0)).collect() == []
    assert prefix_trie.trie(df.limit(0)).columns[0] == "conv_id"
    turnless = [(c, 0, "u", "a", "x", 1, 2) for c in range(201, 230) if zlib.crc32(str(c).encode()) % 6]
    assert built(spark.createDataFrame(turnless, CONV)) == plain_trie(turnless)


# ---------------------------------------------------------------- shards

@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 257, 1000, 70001])
def test_permutation_and_way_back(n):
    at = fs.places(np.arange(n), n, 7)
    assert sorted(at.tolist()) == list(range(n))
    assert fs.rows_at(at % 16, at // 16, n, 16, 7).tolist() == list(range(n))


def test_permutation_mixes():
    at = fs.places(np.arange(40000), 40000, 7)
    assert abs(np.corrcoef(at, np.arange(40000))[0, 1]) < 0.02
    assert abs(np.corrcoef(at[1:], at[:-1])[0, 1]) < 0.02
    assert (fs.places(np.arange(40000), 40000, 8) == at).mean() < 0.001
    # Neighbours in the input are spread evenly over the shards.
    for start in range(0, 40000, 4000):
        assert np.bincount(at[start:start + 4000] % 16, minlength=16).min() > 150


def test_slots_beyond_the_rows_are_refused():
    with pytest.raises(ValueError):
        fs.rows_at(np.array([3]), np.array([5]), 80, 16, 7)


def plain_shards(rows, shards, seed):
    text = [(r[1] or "").encode() for r in rows]
    keyed = sorted(((r[0] is not None, r[0] or 0), len(t) + 1, zlib.crc32(t)) for r, t in zip(rows, text))
    at = fs.places(np.arange(len(rows)), len(rows), seed)
    return sorted((-1 if not k[0][0] else k[0][1], k[1], k[2], "rows", int(p % shards), int(p // shards)) for k, p in zip(keyed, at))


def documents(spark):
    rows = [(i % 40 if i % 7 else None, None if i % 11 == 0 else "é\n" * (i % 5) + str(i % 13), "en", ["a", "é", None, "b"][i % 4] if i < 60 else "a",
             i, 1, "p", 3, 4) for i in range(120)]
    rows += [(5, "same\n", "en", "a", 5, 1, "p", 3, 4)] * 30 + [(9001, "x " * 50000, None, "long", None, 1, "p", 3, 4)]
    return rows, spark.createDataFrame(rows, DOC).repartition(4)


@pytest.mark.parametrize("shards,ranges", [(1, 10), (3, 20), (16, 100000), (500, 7)])
def test_shards(spark, shards, ranges):
    rows, df = documents(spark)
    got = fs.assign(df, shards=shards, seed=3, range_rows=ranges).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:6]) for r in got) == plain_shards(rows, shards, 3)
    assert all(r["grown_shard"] is None for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_shards_of_nothing(spark):
    _, df = documents(spark)
    assert fs.assign(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fs.assign(df, shards=0)


def test_written_shards_hold_the_documents(spark, tmp_path):
    rows, df = documents(spark)
    back = fs.write_shards(df, str(tmp_path / "shards"), shards=5, seed=3, slots_per_file=10)
    own = [c for c in back.columns if c not in df.columns]
    assert sorted(own) == ["_row", "_shard", "_slot"]
    assert back.drop(*own).select(df.columns).exceptAll(df).count() == 0 and back.count() == len(rows)
    for r in back.where("_shard = 2").collect():
        assert fs.rows_at(np.array([2]), np.array([r["_slot"]]), len(rows), 5, 3)[0] == r["_row"]
    with pytest.raises(ValueError):
        fs.write_shards(df.withColumn("_slot", F.lit(1)), str(tmp_path / "no"))


# ---------------------------------------------------------------- manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    values = [doc_id, source, lang, n_chars, text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_proofs(digests):
    """Root and, for each leaf, its (before, after) siblings up the tree of runs of three."""
    ways = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            ways[k].append((digests[run:i], digests[i + 1:run + 3]))
        digests = [H(*digests[i:i + 3]) for i in range(0, len(digests), 3)]
        at = [i // 3 for i in at]
    return digests[0], ways


def plain_manifest(rows):
    trees = defaultdict(list)
    for d, text, lang, source, n, *_ in rows:
        leaf = plain_leaf(d, text, lang, source, n)
        hit = d is not None and text is not None and zlib.crc32(str(d).encode()) % 2 == 0
        found = plain_leaf(d, text.replace("\n", ""), lang, source, n) if hit else leaf
        trees[source].append(((d is not None, d or 0), leaf, found, d))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = [(sorted(trees[s], key=lambda x: x[:2]), *plain_proofs([x[1] for x in sorted(trees[s], key=lambda x: x[:2])])) for s in order]
    root, tops = plain_proofs([m[1] for m in made])
    out = []
    for (leaves, subroot, ways), over in zip(made, tops):
        for (_, leaf, found, d), way in zip(leaves, ways):
            digest = found
            for a, z in way + over:
                digest = H(*a, digest, *z)
            proof = [x for a, z in way + over for x in a + z]
            out.append((-1 if d is None else d, leaf, subroot, root, H(*proof), digest, digest == root, proof))
    return sorted(out)


@pytest.mark.parametrize("ranges,height", [(1000, 8), (7, 1), (20, 2)])
def test_manifest(spark, ranges, height):
    rows, df = documents(spark)
    got = merkle.Manifest(df, *merkle.without_newlines(), range_rows=ranges, height=height).prove(proofs=True).collect()
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)
    assert got == plain_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_leaves_and_of_a_part(spark):
    rows, df = documents(spark)
    one = df.where("source = 'long'")
    m = merkle.Manifest(one)
    r = m.prove().collect()
    assert len(r) == 1 and r[0]["leaf"] == r[0]["subroot"] == m.root and r[0]["proof_sha256"] == H() and r[0]["verified"]
    nothing = merkle.Manifest(df.limit(0))
    assert nothing.root is None and nothing.prove().collect() == []
    whole = merkle.Manifest(df, range_rows=20)
    part = whole.prove(whole.leaves.where("idx % 9 = 4"), proofs=True).collect()
    known = {(p[0], p[1]): p[4] for p in plain_manifest(rows)}
    # Equal leaves of one source differ in place only, so each proof is checked by its fold.
    assert part and all(p["verified"] for p in part)
    assert all(H(*p["proof"]) == p["proof_sha256"] for p in part)
    single = [p for p in part if sum(1 for k in rows if plain_leaf(*k[:1], *k[1:5]) == p["leaf"]) == 1]
    assert single and all(known[-1 if p["doc_id"] is None else p["doc_id"], p["leaf"]] == p["proof_sha256"] for p in single)


def test_octopus_is_minimal():
    """What is asked for is what the paths' runs hold and no known node derives."""
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 4, 27, 28, 100, 733):
        have = set(rng.choice(size, max(1, size // 4), replace=False).tolist())
        need, derived = set(), {(0, i) for i in have}
        for i in have:
            for level, width in enumerate(merkle.widths(size)[:-1]):
                run = i // 3 * 3
                need |= {(level, j) for j in range(run, min(run + 3, width))}
                i //= 3
                derived.add((level + 1, i))
        assert set(merkle.missing(have, size)) == need - derived
