"""Merkle manifest of a dataset with octopus multiproofs.

Every document is a leaf; the leaves of a source, by id, make a tree of runs of three,
and the sources' roots, by source, make the tree above. The trees are built in blocks:
a task gets the nodes under one ancestor of ``HEIGHT`` levels and hashes all levels
between; the blocks' tops are the next round's nodes, so a source of a third of all
rows is many blocks.

Proofs are made per leaf partition (a range of consecutive leaves). A partition first
works out the octopus: the union of the nodes that its leaves' paths need and that
can't be derived from the leaves themselves, a few per level whatever its size. These
coordinates are fetched in one join; then the partition derives the interior nodes that
its leaves share, expands each leaf's own proof from its parent's, and folds it up to
the root.

Defined cases: nulls hash as ``-``; empty texts as ``0:``; equal ids of one source are
ordered by leaf, and equal leaves are equal in all results; a null id is a leaf like
others (first) and is never tampered with; an empty table has no rows and no root; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import numbering
from panelcast.llm.components import written

#: Children of a node, levels of a block, and the tree over the sources.
FAN = 3
HEIGHT = 8
SOURCES = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, level int, idx long, digest string, size long, top boolean"
SPOT = "part long, tree long, level int, idx long"


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row of ``documents``; ``text`` takes the place of its text."""
    cols = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*[_field(c) for c in cols]), 256)


def without_newlines() -> tuple[Column, Column]:
    """Which rows are tampered with, and their text then."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return hit, F.replace("text", F.lit("\n"), F.lit(""))


def _up(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests)).hexdigest().encode()


def widths(size: int) -> list[int]:
    """Nodes of each level, leaves first, down to one."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


# ---------------------------------------------------------------- building

def _block(table: pa.Table, height: int) -> pa.Table:
    """All nodes above one block's rows, up to ``height`` levels or the tree's top."""
    tree, level, size = (table[c][0].as_py() for c in ("tree", "level", "size"))
    nodes = dict(zip(table["idx"].to_pylist(), (d.encode() for d in table["digest"].to_pylist())))
    wide = widths(size)
    out: list[tuple] = []
    for up in range(level + 1, min(level + height, len(wide) - 1) + 1):
        runs: dict[int, list[bytes]] = {}
        for i in sorted(nodes):
            runs.setdefault(i // FAN, []).append(nodes[i])
        nodes = {i: _up(ds) for i, ds in runs.items()}
        out += [(tree, up, i, d.decode(), size, up == len(wide) - 1) for i, d in nodes.items()]
    names = [f.split()[0] for f in NODE.split(", ")]
    return pa.table({n: list(v) for n, v in zip(names, zip(*out))} if out else {n: [] for n in names}, schema=_NODE)


_NODE = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()),
                   ("size", pa.int64()), ("top", pa.bool_())])
_SPOT = pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64())])


def build(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Nodes above ``leaves(tree, idx, digest, size)``; one round per ``height`` levels."""
    rows = leaves.select("tree", F.lit(0).cast("int").alias("level"), "idx", "digest", "size").where("size > 1")
    largest = rows.agg(F.max("size")).first()[0] or 1
    nodes = None
    for level in range(0, len(widths(largest)) - 1, height):
        blocks = rows.groupBy("tree", F.expr(f"idx div {FAN ** height}").alias("block"))
        made = written(blocks.applyInArrow(lambda t: _block(t, height), NODE))
        nodes = made if nodes is None else nodes.unionByName(made)
        rows = made.where((F.col("level") == level + height) & ~F.col("top")).drop("top")
    return nodes if nodes is not None else leaves.sparkSession.createDataFrame([], NODE)


class Manifest:
    """Leaves, nodes and root of a table of documents."""

    def __init__(self, docs: DataFrame, tampered: Column | None = None, text: Column | None = None,
                 range_rows: int = numbering.RANGE_ROWS, height: int = HEIGHT):
        digest = leaf_digest()
        other = digest if tampered is None else F.when(tampered & F.col("text").isNotNull(), leaf_digest(text)).otherwise(digest)
        slim = docs.select(*FIELDS).select("doc_id", "source", digest.alias("leaf"), other.alias("found"))
        slim = written(slim.withColumn("found", F.when(F.col("found") != F.col("leaf"), F.col("found"))))
        rows, spans = numbering.laid_out(slim, ["source"], ["doc_id", "leaf", "found"], range_rows)
        self.n_trees = (spans.agg(F.max("_group")).first()[0] or 0) + 1
        self.leaves = written(numbering.with_spans(rows, spans, ["source"]).select(
            F.col("_part").alias("part"), F.col("_group").alias("tree"), F.col("_index").alias("idx"), F.col("_size").alias("size"),
            "doc_id", "leaf", "found"))
        bottom = self.leaves.select("tree", "idx", F.col("leaf").alias("digest"), "size")
        nodes = build(bottom, height)
        tops = nodes.where("top").select("tree", "digest").unionByName(bottom.where("size = 1").select("tree", "digest"))
        roots = written(tops.select(F.lit(SOURCES).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest",
                                    F.lit(self.n_trees).cast("long").alias("size")))
        above = build(roots, height)
        last = above.where("top") if self.n_trees > 1 else roots
        found = last.select("digest").first()
        self.root = found[0] if found else None
        own = ["tree", "level", "idx", "digest"]
        zero = F.lit(0).cast("int").alias("level")
        self.nodes = (nodes.select(own).unionByName(above.select(own)).unionByName(roots.select("tree", zero, "idx", "digest"))
                      .unionByName(bottom.select("tree", zero, "idx", "digest")))

    def prove(self, wanted: DataFrame | None = None, proofs: bool = False) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; with ``proofs`` also the siblings.

        ``wanted`` is a part of ``leaves``, all by default.
        """
        leaves = self.leaves if wanted is None else wanted
        n_trees = self.n_trees
        spots = written(leaves.select("part", "tree", "idx", "size").groupBy("part")
                        .applyInArrow(lambda t: _octopus(t, n_trees), SPOT))
        fetched = written(spots.join(self.nodes, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest"))
        kinds = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string" + (
            ", proof array<string>" if proofs else "")
        made = leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(
            lambda a, b: _expand(a, b, n_trees, proofs), kinds)
        return made.select("doc_id", "leaf", "subroot", F.lit(self.root).alias("root"), "proof_sha256", "folded_root",
                           (F.col("folded_root") == F.lit(self.root)).alias("verified"), *(["proof"] if proofs else []))


# ---------------------------------------------------------------- proving

def missing(have: set[int], size: int) -> Iterator[tuple[int, int]]:
    """(level, idx) that the paths of the leaves ``have`` need and can't derive, level by level."""
    for level, width in enumerate(widths(size)[:-1]):
        up = {i // FAN for i in have}
        for p in up:
            for i in range(p * FAN, min(p * FAN + FAN, width)):
                if i not in have:
                    yield level, i
        have = up


def _trees(table: pa.Table) -> dict[int, tuple[int, list[int]]]:
    """Rows of each tree: its size and the row numbers."""
    out: dict[int, tuple[int, list[int]]] = {}
    for row, (tree, size) in enumerate(zip(table["tree"].to_pylist(), table["size"].to_pylist())):
        out.setdefault(tree, (size, []))[1].append(row)
    return out


def _octopus(table: pa.Table, n_trees: int) -> pa.Table:
    if not table.num_rows:
        return _SPOT.empty_table()
    part, idx = table["part"][0].as_py(), table["idx"].to_pylist()
    trees = _trees(table)
    spots = [(part, tree, level, i) for tree, (size, rows) in trees.items()
             for level, i in missing({idx[r] for r in rows}, size)]
    spots += [(part, SOURCES, level, i) for level, i in missing(set(trees), n_trees)]
    return pa.table({n: list(v) for n, v in zip(_SPOT.names, zip(*spots))} if spots else {n: [] for n in _SPOT.names}, schema=_SPOT)


class _Paths:
    """One tree's known nodes by level: derived from the leaves and the fetched nodes."""

    def __init__(self, size: int, leaves: dict[int, bytes], fetched: dict[tuple[int, int], bytes]):
        wide = widths(size)
        self.sides: list[dict[int, tuple[bytes, bytes]]] = []
        known = dict(leaves)
        given: dict[int, dict[int, bytes]] = {}
        for (level, i), d in fetched.items():
            given.setdefault(level, {})[i] = d
        for level, width in enumerate(wide[:-1]):
            ours = list(known)
            known.update(given.get(level, {}))
            up: dict[int, bytes] = {}
            sides = {}
            for i in ours:
                p = i // FAN
                run = [known[j] for j in range(p * FAN, min(p * FAN + FAN, width))]
                sides[i] = b"".join(run[:i - p * FAN]), b"".join(run[i - p * FAN + 1:])
                if p not in up:
                    up[p] = _up(run)
            self.sides.append(sides)
            known = up
        self.top = known.get(0)

    def tails(self, above: bytes) -> dict[int, bytes]:
        """Each leaf's proof: its siblings, its parent's, and so on up to ``above``."""
        tails = {0: above}
        for sides in reversed(self.sides):
            tails = {i: left + right + tails[i // FAN] for i, (left, right) in sides.items()}
        return tails

    def fold(self, i: int, digest: bytes) -> bytes:
        for sides in self.sides:
            left, right = sides[i]
            digest, i = sha256(left + digest + right).hexdigest().encode(), i // FAN
        return digest


def _expand(leaves: pa.Table, fetched: pa.Table, n_trees: int, proofs: bool) -> pa.Table:
    idx = leaves["idx"].to_pylist()
    digest = [d.encode() for d in leaves["leaf"].to_pylist()]
    found = [d.encode() if d is not None else None for d in leaves["found"].to_pylist()]
    given: dict[int, dict[tuple[int, int], bytes]] = {}
    for tree, level, i, d in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "idx", "digest"))):
        given.setdefault(tree, {})[level, i] = d.encode()
    trees = _trees(leaves)
    paths = {t: _Paths(size, {idx[r]: digest[r] for r in rows}, given.get(t, {})) for t, (size, rows) in trees.items()}
    over = _Paths(n_trees, {t: p.top for t, p in paths.items()}, given.get(SOURCES, {}))
    above = over.tails(b"")
    n = leaves.num_rows
    sub, proof, folded = [""] * n, [b""] * n, [""] * n
    for t, (_, rows) in trees.items():
        own, tails = paths[t], paths[t].tails(above[t])
        for r in rows:
            sub[r], proof[r] = own.top.decode(), tails[idx[r]]
            folded[r] = over.fold(t, own.fold(idx[r], found[r] or digest[r])).decode()
    out = {"doc_id": leaves["doc_id"], "leaf": leaves["leaf"], "subroot": pa.array(sub, pa.string()),
           "proof_sha256": pa.array([sha256(p).hexdigest() for p in proof], pa.string()), "folded_root": pa.array(folded, pa.string())}
    if proofs:
        out["proof"] = pa.array([[p[k:k + 64].decode() for k in range(0, len(p), 64)] for p in proof], pa.list_(pa.string()))
    return pa.table(out)
