"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct ``words``-word shingles. Documents link
when their Jaccard similarity is ``percent``/100 or more; the result is one
row per document with the smallest ``doc_id`` of its component.

1. One pass hashes each text's shingles, and keeps ``T`` minwise tokens, a
   2-bit sketch of them, the set's size and a 128-bit hash of the set. Equal
   sets become one node from here on.
2. ``STAR_TREES`` trees branch once: a node is a chosen coordinate and its
   minwise token. Every member is compared with the node's least member, which
   joins dense groups by as many links as they have members.
3. ``TREES`` independent trees branch recursively: a set follows each minwise
   coordinate with probability 1/(lambda T), so a pair at the threshold meets
   in one child in the mean. Nodes whose members are one component already
   are dropped, nodes of up to ``LEAF`` sets are compared exhaustively, larger
   ones branch again, for ``DEPTH`` rounds of ``STRIDE`` levels.
4. The sets of all nodes that are larger even then are joined exactly: two
   similar sets share one of their first shingles in any common order (common
   ones last), so each such shingle is one more node. Small ones are compared
   as above, large ones block by block, but for pairs of the largest component.
5. Sketches only rule out pairs far below the threshold (over 4 standard
   deviations). A bitmap of the set, each shingle flipping one of ``BITS`` bits,
   rules out more, and without error: two bitmaps never differ in more bits than
   their sets in shingles. Every link is confirmed on the full sets.
6. Pairs are never rows. A node gives the members that still have a possible
   partner in it, these meet once more with their full sets, and each group that
   links within the node gives one link per further member.

Trees never go deeper than 3 levels, since the chance to meet falls with every
level. A pair at the threshold meets in one tree with probability 0.376 at 3
levels, and in one of ``TREES = 16`` with 0.9993 (all trees read the same
``T`` tokens, of which a binomial number agrees; 0.94 at 9 levels, 0.79 at 17).
A component needs no particular pair. What is left after that is exact.

Null, empty and wordless texts have the empty set and link with nothing, as
rows without a ``doc_id``. Rows that repeat a ``doc_id`` share its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import vec
from panelcast.llm.components import components, written
from panelcast.llm.vec import U, mix

T = 128
STAR_TREES = 4
TREES = 16
#: Rounds of branching after the roots, and levels of each: a round costs a few small jobs.
DEPTH = 1
STRIDE = 2
LEAF = 256
#: About so many sets tell which shingles are common, and so many of those are put last.
SAMPLE = 20_000
COMMON = 1 << 16
#: Standard deviations of a sketch's estimate left below the threshold.
SLACK = 4.0
#: Bits of a set's bitmap (a power of two), and shared shingles of a leaf that are counted at a time.
BITS = 1024
COLUMNS = 4096
#: Bytes of text whose shingles a task holds at a time.
SLICE_BYTES = 1 << 18

FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                      ("s0", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("s3", pa.int64()),
                      ("bits", pa.binary()), ("tokens", pa.binary())])
FEATURES_DDL = ("doc_id long, n_shingles long, h1 long, h2 long, s0 long, s1 long, s2 long, s3 long, bits binary, tokens binary")
_FACTOR = mix(np.arange(T, dtype=U), 77) | U(1)
SKETCH = ["s0", "s1", "s2", "s3"]


def shingle_sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and row offsets."""
    data, off = vec.text_bytes(batch.column("text"))
    data = vec.LOWER[data]
    start, end, row = vec.word_bounds(data, off)
    n = np.diff(row)
    spans = vec.Spans(vec.byte_spans(data).at(start, end))
    at = vec.inside_rows(row, words)
    size = np.maximum(n - words + 1, 0)
    short = np.flatnonzero((n > 0) & (n < words))
    h = np.r_[spans.at(at, at + words), mix(spans.at(row[short], row[short + 1]) ^ n[short].astype(U))]
    of = np.r_[np.repeat(np.arange(len(n)), size), short]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(n) + 1))


def bitmaps(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row, bits that are set where an odd number of the row's shingles fall."""
    rows = len(off) - 1
    place = np.repeat(np.arange(rows), np.diff(off)) * BITS + (mix(h, 9) & U(BITS - 1)).astype(np.int64)
    odd = np.zeros(rows * BITS, np.uint8)
    place.sort()
    at = vec.runs(place)
    odd[place[at]] = np.diff(np.r_[at, len(place)]) & 1
    return np.packbits(odd.reshape(rows, BITS), axis=1)


def features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.slices(batches, "text", SLICE_BYTES):
            h, off = shingle_sets(batch, words)
            size = np.diff(off)
            full = np.flatnonzero(size)
            at = off[:-1][full]
            rows = batch.num_rows
            tokens = np.zeros((rows, T), np.uint32)
            sums = np.zeros((2, rows), U)
            if len(full):
                for i in range(T):
                    tokens[full, i] = (np.minimum.reduceat(h * _FACTOR[i], at) >> U(32)).astype(np.uint32)
                for i in range(2):
                    sums[i, full] = np.add.reduceat(mix(h, i + 5), at)
            bits = (mix(tokens.astype(U) + (np.arange(T, dtype=U) << U(32)), 3) & U(3)).reshape(rows, 4, 32)
            sketch = np.bitwise_or.reduce(bits << (U(2) * np.arange(32, dtype=U)), axis=2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums),
                 *(pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(4)),
                 pa.array([b.tobytes() for b in bitmaps(h, off)], pa.binary()),
                 pa.array([t.tobytes() if n else None for t, n in zip(tokens, size)], pa.binary())], schema=FEATURES)
    return run


def _choice(node: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) pairs that the nodes choose, each with probability ``rate``."""
    draws = mix(node[:, None] + np.arange(T, dtype=U)[None, :] * U(0x632BE59BD9B4E019), 21)
    return np.nonzero(draws < U(int(rate * 2.0 ** 64)))


def _child(node: np.ndarray, at: np.ndarray, coord: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(mix(node[at], 31) ^ mix((tokens[at, coord].astype(U) << U(8)) | coord.astype(U), 32))


def _tokens(batch: pa.RecordBatch) -> np.ndarray:
    data, off = vec.text_bytes(batch.column("tokens"))
    return np.frombuffer(data.tobytes(), np.uint32).reshape(-1, T)


PATHS = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("comp", pa.int64())])
PATHS_DDL = "node long, doc_id long, comp long"


def roots(first: int, trees: int, rate: float):
    """The children that each set takes at the roots of the trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                tokens = _tokens(part)
                docs = part.column("doc_id").to_numpy()
                for tree in range(first, first + trees):
                    root = mix(np.array([tree], U), 41)
                    _, coord = _choice(root, rate)
                    at = np.repeat(np.arange(len(docs)), len(coord))
                    node = _child(np.repeat(root, len(docs)), at, np.tile(coord, len(docs)), tokens)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(docs[at]),
                                                      pa.array(part.column("comp").to_numpy()[at])], schema=PATHS)
    return run


def branch(rate: float):
    """The children that each (node, set) takes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                node, tokens, at = part.column("node").to_numpy().view(U), _tokens(part), np.arange(part.num_rows)
                for _ in range(STRIDE):
                    up, coord = _choice(node, rate)
                    node, at = _child(node, up, coord, tokens[at]), at[up]
                child = node
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), pa.array(part.column("doc_id").to_numpy()[at]),
                     pa.array(part.column("comp").to_numpy()[at])], schema=PATHS)
    return run


def _limit(percent: int) -> int:
    """Most 2-bit sketch places that a linked pair may differ in, but for chance."""
    j = percent / 100
    agree = j + (1 - j) / 4
    return int(T * (1 - agree) + SLACK * (T * agree * (1 - agree)) ** 0.5)


def _differ(p: str, q: str):
    """Sketch places in which two rows differ (Spark columns)."""
    total = None
    for s in SKETCH:
        x = F.expr(f"{p}.{s} ^ {q}.{s}")
        n = F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        total = n if total is None else total + n
    return total


def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by ``node``, in tables of whole leaves, and where each leaf starts and the last ends."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        node = table.column("node").to_numpy()
        before = np.flatnonzero(node != node[-1])
        last = int(before[-1]) + 1 if len(before) else 0  # the last leaf may go on
        rest = table.slice(last)
        if last:
            yield table.slice(0, last).combine_chunks(), np.r_[vec.runs(node[:last]), last]
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


MEMBERS = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("comp", pa.int64())])
MEMBERS_DDL = "node long, doc_id long, comp long"


def partnered(limit: int, percent: int):
    """The members of each leaf that may link with one of another component, by size, sketch and bitmap; rows come sorted by leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in by_leaf(batches):
            comp, size = table.column("comp").to_numpy(), table.column("n_shingles").to_numpy()
            sketch = np.stack([table.column(c).to_numpy().view(U) for c in SKETCH], 1)
            bits = np.frombuffer(vec.text_bytes(table.column("bits").chunk(0))[0].tobytes(), U).reshape(len(size), -1)
            used = np.zeros(len(size), bool)
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                if y - x < 2:
                    continue
                i, j = np.triu_indices(y - x, 1)
                i, j = i + x, j + x
                low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
                fit = (comp[i] != comp[j]) & (100 * low >= percent * high)
                i, j = i[fit], j[fit]
                z = sketch[i] ^ sketch[j]
                fit = np.bitwise_count((z | (z >> U(1))) & U(0x5555555555555555)).sum(axis=1) <= limit
                i, j = i[fit], j[fit]
                # Similar sets share p (x + y) / (100 + p) shingles or more, so they differ in few.
                fit = (100 + percent) * np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (size[i] + size[j])
                used[i[fit]] = used[j[fit]] = True
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[at]) for c in MEMBERS.names], schema=MEMBERS)
    return run


def shared(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many shingles every two of the sets share."""
    rows = len(off) - 1
    both = np.zeros((rows, rows), np.int64)
    row = np.repeat(np.arange(rows), np.diff(off))
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    at = vec.runs(h)
    often = np.diff(np.r_[at, len(h)])
    keep = np.repeat(often > 1, often)
    row, column = row[keep], np.repeat(np.arange((often > 1).sum()), often[often > 1])
    cut = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for k, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        part = np.zeros((rows, column[y - 1] - k * COLUMNS + 1), np.float32)  # sums of up to COLUMNS ones are exact
        part[row[x:y], column[x:y] - k * COLUMNS] = 1
        both += (part @ part.T).astype(np.int64)
    return both


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def linked(percent: int):
    """(least, other) of every group of a leaf's sets that links, over full sets; rows come sorted by leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in by_leaf(batches):
            doc, comp = table.column("doc_id").to_numpy(), table.column("comp").to_numpy()
            sets = table.column("shingles").chunk(0)
            off, h = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy().view(U)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                if y - x < 2:
                    continue
                both = shared(h[off[x]:off[y]], off[x:y + 1] - off[x])
                size = np.diff(off[x:y + 1])
                near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
                i, j = np.nonzero(np.triu(near & (comp[x:y, None] != comp[None, x:y]), 1))
                least, was = doc[x:y].copy(), None
                while was is None or (least != was).any():
                    was = least.copy()
                    np.minimum.at(least, i, was[j])
                    np.minimum.at(least, j, was[i])
                other = least != doc[x:y]
                a.append(least[other])
                b.append(doc[x:y][other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b)], schema=LINKS)
    return run


def sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.slices(batches, "text", SLICE_BYTES):
            h, off = shingle_sets(batch, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))],
                ["doc_id", "shingles"])
    return run


PREFIXES = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("comp", pa.int64()), ("active", pa.bool_())])
PREFIXES_DDL = "node long, doc_id long, comp long, active boolean"


def prefixes(words: int, percent: int, common: np.ndarray, count: np.ndarray):
    """The first shingles of every set, by (count, hash); the sorted ``common`` have a count, others 0.

    Of two similar sets, the first shingle they share is among the ``active`` of
    the smaller set and among the given ones of the larger, whatever the order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.slices(batches, "text", SLICE_BYTES):
            h, off = shingle_sets(batch, words)
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            often = np.zeros(len(h), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                often = np.where(common[at] == h, count[at], 0)
            h = h[np.lexsort((h, often, row))]
            n, place = size[row], np.arange(len(h)) - off[row]
            given = np.flatnonzero(place <= n + (-percent * n) // 100)
            active = place <= n + (-2 * percent * n) // (100 + percent)
            row = row[given]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[given].view(np.int64)), batch.column("doc_id").take(pa.array(row)),
                 batch.column("comp").take(pa.array(row)), pa.array(active[given])], schema=PREFIXES)
    return run


def _blocks(large: DataFrame) -> DataFrame:
    """(node, doc_id) of leaves that hold every pair of a large node that may link.

    Its sets are active or not, and of its largest component or not; pairs of two
    sets that aren't active or of two of that component are left out. Each of the
    four kinds is cut into blocks, and two blocks make a leaf.
    """
    by_comp = large.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("a"))
    kinds = (by_comp.groupBy("node").agg(F.max(F.struct("n", "comp", "a")).alias("top"), F.sum("n").alias("n"), F.sum("a").alias("a"))
             .select("node", F.col("top.comp").alias("main"), F.expr("a - top.a").alias("c0"), F.expr("top.a").alias("c1"),
                     F.expr("n - a - (top.n - top.a)").alias("c2"), F.expr("top.n - top.a").alias("c3")))
    for i in range(4):
        kinds = kinds.withColumn(f"k{i}", F.ceil(F.col(f"c{i}") / LEAF).cast("int"))
    rows = (large.join(kinds, "node").withColumn("kind", F.expr("IF(comp = main, 1, 0) + IF(active, 0, 2)"))
            .withColumn("b", F.expr("CAST(pmod(xxhash64(doc_id, node), element_at(array(k0, k1, k2, k3), kind + 1)) AS INT)")))
    def with_blocks(kind, key):
        return f"transform(slice(sequence(0, k{kind}), 1, k{kind}), x -> xxhash64(node, {key}))"
    mine = [["0, least(b, x), greatest(b, x)", "1, b, x", "2, b, x", "3, b, x"], ["1, x, b", None, "4, b, x"],
            ["2, x, b", "4, x, b"], ["3, x, b"]]
    keys = "CASE kind " + " ".join(
        f"WHEN {i} THEN concat({', '.join(with_blocks(j, k) for j, k in enumerate(of) if k)})" for i, of in enumerate(mine)) + " END"
    return rows.select(F.explode(F.expr(keys)).alias("node"), "doc_id")


def exact_leaves(rest: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, doc_id) of leaves in which all similar pairs of ``rest(doc_id, comp)`` meet."""
    held = texts.join(rest, "doc_id")
    share = max(1, rest.count() // SAMPLE)
    seen = held.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).mapInArrow(sets_of(words), "doc_id long, shingles array<long>")
    often = (seen.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .orderBy(F.desc("n"), "h").limit(COMMON).toArrow())
    common, count = often.column("h").to_numpy().view(U), often.column("n").to_numpy()
    order = np.argsort(common)
    paths = written(held.mapInArrow(prefixes(words, percent, common[order], count[order]), PREFIXES_DDL))
    sizes = (paths.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                       F.max("active").alias("any"))
             .where("c > 1 AND lo <> hi AND any").select("node", "c"))
    mixed = written(paths.join(sizes, "node"))
    return mixed.where(F.col("c") <= LEAF).select("node", "doc_id").unionByName(_blocks(mixed.where(F.col("c") > LEAF)))


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(sets_of(words), "doc_id long, shingles array<long>")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(right, "b").join(left, "a")
            .where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = written(docs.mapInArrow(features(words), FEATURES_DDL))
    keyed = all_rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # A repeated doc_id may hold several sets; each node below is one (set, least doc_id).
    head = keyed.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("head"))
    members = keyed.join(head, ["h1", "h2", "n_shingles"])
    same = members.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    nodes = written(members.where("doc_id = head").drop("head").dropDuplicates(["doc_id", "h1", "h2"]))
    texts = docs.where("doc_id IS NOT NULL")
    rate = 100 / (percent * T)
    limit = _limit(percent)
    slim = nodes.drop("tokens", "bits", "h1", "h2")

    # Stars: each member of a node against its least member.
    paths = (nodes.select("doc_id", F.col("doc_id").alias("comp"), "tokens")
             .mapInArrow(roots(0, STAR_TREES, rate), PATHS_DDL))
    least = paths.groupBy("node").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
    star = paths.join(least, "node").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    star = written(_near(star, slim, limit, percent))
    links = written(confirm(star, texts, words, percent))
    known = components(links)

    # Recursive trees over what isn't one component yet.
    comp = written(nodes.join(known.withColumnRenamed("u", "doc_id"), "doc_id", "left")
                        .withColumn("comp", F.coalesce("root", "doc_id")).drop("root", "h1", "h2"))
    light = comp.drop("tokens")
    paths = comp.select("doc_id", "comp", "tokens").mapInArrow(roots(STAR_TREES, TREES, rate), PATHS_DDL)
    leaves = []
    for level in range(DEPTH + 1):
        sizes = (paths.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("c > 1 AND lo <> hi").select("node", "c"))
        mixed = written(paths.join(sizes, "node"))
        leaves.append(mixed.where(F.col("c") <= LEAF).select("node", "doc_id"))
        large = mixed.where(F.col("c") > LEAF).select("node", "doc_id", "comp")
        if large.isEmpty():
            break
        if level == DEPTH:
            leaves.append(exact_leaves(written(large.select("doc_id", "comp").distinct()), texts, words, percent))
            break
        paths = written(large.join(comp.select("doc_id", "tokens"), "doc_id").mapInArrow(branch(rate), PATHS_DDL))
    ready = leaves[0]
    for more in leaves[1:]:
        ready = ready.unionByName(more)
    ready = (ready.join(light, "doc_id").select("node", "doc_id", "comp", "n_shingles", *SKETCH, "bits")
             .repartition("node").sortWithinPartitions("node"))
    near = written(ready.mapInArrow(partnered(limit, percent), MEMBERS_DDL).distinct())
    sets = texts.join(near.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(sets_of(words), "doc_id long, shingles array<long>")
    meet = near.join(sets, "doc_id").select("node", "doc_id", "comp", "shingles").repartition("node").sortWithinPartitions("node")
    late = meet.mapInArrow(linked(percent), "a long, b long").distinct()
    root = components(links.unionByName(late).unionByName(same)).withColumnRenamed("u", "doc_id")
    return (all_rows.select("doc_id", "n_shingles").join(root, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _near(pairs: DataFrame, slim: DataFrame, limit: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    p, q = slim.alias("p"), slim.alias("q")
    low, high = F.least("p.n_shingles", "q.n_shingles"), F.greatest("p.n_shingles", "q.n_shingles")
    return (pairs.join(p, F.col("a") == F.col("p.doc_id")).join(q, F.col("b") == F.col("q.doc_id"))
            .where((100 * low >= percent * high) & (_differ("p", "q") <= limit)).select("a", "b").distinct())
