"""Prefix trie of rebuilt conversations by vertical bitmaps.

Conversations are numbered by id and dealt to shards of ``SHARD`` neighbours; their
turns are cut into bands of ``BAND`` positions, so a conversation of any length is many
rows and a task's group is at most ``SHARD`` times ``BAND`` turns. A shard's index maps
(position, turn) to a bitset over the shard's conversations. Depth first, a node's
children are the intersections of its bitset with the postings at the next position;
popcounts are its members, the bits that have no next turn its end list. Nodes of
different shards are one if their paths are: a node's name is a digest of the path
(128 bits of SHA-256), and the shards' counts add up.

Two walks are made. The first gives members, children and end lists. A conversation
then knows how many of its turns it shares with a smaller conversation, and whether it
owns a childless node; with that, the second walk sums popcounts upwards: the saved
tokens of a node are, over its members, the code points of their shared turns from the
node's depth on, and its leaves are the members that own one.

Defined cases: rows without conv_id belong to no conversation; null role and text are
empty; turns of equal number are ordered by the digest of role and text; repeated rows
are turns of their own; conversations may end up turnless (members of the root alone); without
conversations there are no nodes; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import numbering
from panelcast.llm.components import written

#: Conversations of a shard and turns of a band.
SHARD = 1024
BAND = 64
#: The contract's rebuilding: the head comes from the first conversation of each hundred.
HUNDRED = 100
HEADS = 6
NAME = 16

NODE = "name binary, parent binary, depth long, shard long, conv_id long, n_convs long, points long, ends string"
SUM = "name binary, n_leaves long, saved_tokens long"
_NODE = pa.schema([("name", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("shard", pa.int64()), ("conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("points", pa.int64()), ("ends", pa.string())])
_SUM = pa.schema([("name", pa.binary()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def _digest(c: Column) -> Column:
    return F.substring(F.unhex(F.sha2(c, 256)), 1, NAME)


def head_length(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS))


# ---------------------------------------------------------------- rebuilding

def rebuilt(conversations: DataFrame, band: int, shard: int, range_rows: int) -> DataFrame:
    """One row per conversation and band: (nth, conv_id, length, band, turns, points); turnless ones have band 0.

    ``turns`` holds the digests of the band's turns in order, ``points`` their code points.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    slim = written(conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        token.alias("token"), F.char_length(text).cast("long").alias("points")))
    rows, spans = numbering.laid_out(slim, ["conv_id"], ["turn", "token"], range_rows)
    c, base = F.col("conv_id"), F.col("conv_id") - F.col("conv_id") % HUNDRED
    own = numbering.with_spans(rows, spans, ["conv_id"])
    first = (own.where((c == base) & (F.col("_index") < HEADS - 1)).groupBy(c.alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("_index", "token", "points"))).alias("head")))
    known = spans.withColumn("h", head_length(c)).withColumn("base", base).join(first, "base", "left")
    known = written(known.withColumn("head", F.slice(F.coalesce("head", F.array().cast(first.schema["head"].dataType)), 1, F.col("h").cast("int")))
                    .withColumn("kept", F.size("head").cast("long")))
    length = F.col("kept") + F.greatest(F.col("_size") - F.col("h"), F.lit(0))
    heads = known.where("_before = 0").select(F.col("_group").alias("nth"), "conv_id", length.alias("length"), F.explode_outer("head").alias("t")).select(
        "nth", "conv_id", "length", F.coalesce("t._index", F.lit(0)).alias("pos"), "t.token", "t.points")
    tails = (numbering.with_spans(rows, known, ["conv_id"]).where("_index >= h")
             .select(F.col("_group").alias("nth"), "conv_id", length.alias("length"), (F.col("kept") + F.col("_index") - F.col("h")).alias("pos"), "token", "points"))
    bands = (heads.unionByName(tails).groupBy("nth", "conv_id", "length", F.expr(f"pos div {int(band)}").alias("band"))
             .agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token", "points")))).alias("t")))
    return written(bands.select(F.expr(f"nth div {int(shard)}").alias("shard"), (F.col("nth") % shard).cast("int").alias("bit"), "conv_id", "length", "band",
                                F.col("t.token").alias("turns"), F.col("t.points").alias("points")))


def _before_and_after(rows: DataFrame, value: str, fold, fan: int) -> DataFrame:
    """Per (conv_id, band): ``fold`` of ``value`` over all earlier bands, in blocks of ``fan`` bands.

    Blocks of bands are folded first, then the blocks before them by the same rule, so no
    window holds more than ``fan`` rows whatever a conversation's length. Adds ``sofar``.
    """
    block = F.expr(f"band div {fan}")
    w = Window.partitionBy("conv_id", block).orderBy("band")
    inside = rows.withColumn("_in", fold(F.collect_list(value).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    if not inside.where(f"band >= {fan}").limit(1).count():
        return inside.withColumn("sofar", F.col("_in")).drop("_in")
    blocks = rows.groupBy("conv_id", block.alias("band")).agg(
        fold(F.transform(F.array_sort(F.collect_list(F.struct("band", value))), lambda s: s[value])).alias(value))
    up = _before_and_after(written(blocks), value, fold, fan).select("conv_id", F.col("band").alias("_up"), F.col("sofar").alias("_over"))
    return (inside.withColumn("_up", block).join(up, ["conv_id", "_up"])
            .withColumn("sofar", fold(F.array("_over", "_in"))).drop("_in", "_up", "_over"))


def with_starts(bands: DataFrame, band: int, fan: int = 64) -> DataFrame:
    """Adds ``start``, the name of the node at which the band begins, and ``end``, that at which a full band ends."""
    long = bands.where(F.col("length") >= band)
    if not long.limit(1).count():
        return bands.withColumns({"start": F.when(F.lit(False), F.lit(b"")), "end": F.when(F.lit(False), F.lit(b""))})
    def fold(parts):
        return _digest(F.concat_ws("", F.transform(parts, F.hex)))
    # A band's digest, and a last empty one behind a conversation's last full band.
    digests = written(long.where(F.size("turns") == band).select("conv_id", "band", fold(F.col("turns")).alias("d")))
    behind = digests.groupBy("conv_id").agg(F.max("band").alias("band")).select("conv_id", (F.col("band") + 1).alias("band"), F.lit(b"").alias("d"))
    so = written(_before_and_after(digests.unionByName(behind), "d", fold, fan).select("conv_id", "band", "sofar"))
    start = so.where("band > 0").select("conv_id", "band", F.col("sofar").alias("start"))
    end = so.where("band > 0").select("conv_id", (F.col("band") - 1).alias("band"), F.col("sofar").alias("end"))
    return written(bands.join(start, ["conv_id", "band"], "left").join(end, ["conv_id", "band"], "left"))


# ---------------------------------------------------------------- walking

ROOT = sha256(b"").digest()[:NAME]


class _Index:
    """Vertical bitmaps of one shard's band: postings of (position, turn), and who has a turn there."""

    def __init__(self, t: pa.Table, band: int):
        self.band = t["band"][0].as_py()
        self.base = self.band * band
        self.turns, self.points = {}, {}
        self.convs = dict(zip(t["bit"].to_pylist(), t["conv_id"].to_pylist()))
        self.lengths = dict(zip(t["bit"].to_pylist(), t["length"].to_pylist()))
        self.starts = dict(zip(t["bit"].to_pylist(), t["start"].to_pylist()))
        self.stops = dict(zip(t["bit"].to_pylist(), t["end"].to_pylist()))
        self.postings: dict[tuple[int, bytes], int] = {}
        self.alive: dict[int, int] = {}
        for bit, turns, points in zip(t["bit"].to_pylist(), t["turns"].to_pylist(), t["points"].to_pylist()):
            self.turns[bit], self.points[bit] = turns, points
            one = 1 << bit
            for k, turn in enumerate(turns):
                self.postings[k, turn] = self.postings.get((k, turn), 0) | one
                self.alive[k] = self.alive.get(k, 0) | one

    def tops(self) -> Iterator[tuple[bytes, int]]:
        """The nodes at which the band begins, with their bitsets."""
        groups: dict[bytes, int] = {}
        for bit in self.convs:
            name = self.starts[bit] if self.band else ROOT
            groups[name] = groups.get(name, 0) | 1 << bit
        yield from groups.items()

    def children(self, members: int, k: int) -> Iterator[tuple[int, int]]:
        """A conversation of each child at local depth ``k + 1``, and the child's bitset."""
        rest = members & self.alive.get(k, 0)
        while rest:
            bit = (rest & -rest).bit_length() - 1
            both = members & self.postings[k, self.turns[bit][k]]
            yield bit, both
            rest &= ~both

    def walk(self, band: int) -> Iterator[tuple[bytes, bytes | None, int, int, int, int]]:
        """(name, parent, local depth, least bit, bitset, index of parent) of all nodes, parents first.

        A band's first node is the last band's and comes only where the band is the first.
        """
        count = 0
        for top, members in self.tops():
            least = (members & -members).bit_length() - 1
            at = -1
            if not self.band:
                yield top, None, 0, least, members, -1
                at, count = count, count + 1
            todo = [(top, sha256(top), members, 0, at)]
            while todo:
                name, state, members, k, at = todo.pop()
                for bit, both in self.children(members, k):
                    below = state.copy()
                    below.update(self.turns[bit][k])
                    child = self.stops[bit] if k + 1 == band else below.digest()[:NAME]
                    yield child, name, k + 1, bit, both, at
                    if k + 1 < band:
                        todo.append((child, below, both, k + 1, count))
                    count += 1


def _bits(members: int) -> Iterator[int]:
    while members:
        low = members & -members
        yield low.bit_length() - 1
        members ^= low


def _nodes(t: pa.Table, band: int) -> pa.Table:
    """First walk: members, least member, and the end list of each node of the shard."""
    ix = _Index(t, band)
    shard = t["shard"][0].as_py()
    out: list[tuple] = []
    for name, parent, k, bit, members, _ in ix.walk(band):
        over = members & ~ix.alive.get(k, 0)
        if k == band:
            over = sum(1 << b for b in _bits(members) if ix.lengths[b] == ix.base + k)
        ends = ",".join(str(ix.convs[b]) for b in _bits(over)) if over else None
        out.append((name, parent, ix.base + k, shard, ix.convs[bit], members.bit_count(), ix.points[bit][k - 1] if k else 0, ends))
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*out), _NODE)] if out else [[] for _ in _NODE], schema=_NODE)


def _sums(t: pa.Table, band: int) -> pa.Table:
    """Second walk: popcounts of the members that share a node, summed upwards, and of the leaves' owners."""
    ix = _Index(t, band)
    shared = dict(zip(t["bit"].to_pylist(), t["shared"].to_pylist()))
    carry = dict(zip(t["bit"].to_pylist(), t["later"].to_pylist()))
    owners = sum(1 << b for b, leaf in zip(t["bit"].to_pylist(), t["leaf"].to_pylist()) if leaf)
    carrying = sum(1 << b for b, c in carry.items() if c)
    sharing: dict[int, int] = {}
    for b, upto in shared.items():
        for k in range(1, min(upto - ix.base, len(ix.turns[b])) + 1):
            sharing[k] = sharing.get(k, 0) | 1 << b
    names, leaves, saved, parents = [], [], [], []
    for name, _, k, bit, members, at in ix.walk(band):
        names.append(name)
        parents.append(at)
        leaves.append((members & owners).bit_count())
        own = (members & sharing.get(k, 0)).bit_count() * ix.points[bit][k - 1] if k else 0
        if k == band:
            own += sum(carry[b] for b in _bits(members & carrying))
        saved.append(own)
    for i in range(len(names) - 1, -1, -1):
        if parents[i] >= 0:
            saved[parents[i]] += saved[i]
    return pa.table({"name": pa.array(names, pa.binary()), "n_leaves": pa.array(leaves, pa.int64()), "saved_tokens": pa.array(saved, pa.int64())})


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end lists, joined in shard order; a list is a row per shard, in order."""
    now, state = None, None
    for batch in batches:
        names, digests = [], []
        for name, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == now:
                state.update(b"," + ends.encode())
                continue
            if now is not None:
                names.append(now)
                digests.append(state.hexdigest())
            now, state = name, sha256(ends.encode())
        yield pa.record_batch({"name": pa.array(names, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
    if now is not None:
        yield pa.record_batch({"name": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


# ---------------------------------------------------------------- the trie

def trie(conversations: DataFrame, shard: int = SHARD, band: int = BAND,
         range_rows: int = numbering.RANGE_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    if shard < 1 or band < 1:
        raise ValueError("a shard holds a conversation and a band a turn at least")
    bands = with_starts(rebuilt(conversations, band, shard, range_rows), band)
    found = written(bands.groupBy("shard", "band").applyInArrow(lambda t: _nodes(t, band), NODE))
    nodes = written(found.groupBy("name").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs")))
    fans = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(fans, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    ends = (found.where("ends IS NOT NULL").select("name", "ends", "shard").repartition("name").sortWithinPartitions("name", "shard")
            .select("name", "ends").mapInArrow(_end_digests, "name binary, ends_sha256 string"))
    sums = (_with_shares(bands, nodes, band).groupBy("shard", "band").applyInArrow(lambda t: _sums(t, band), SUM)
            .groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    over = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(sums, "name").join(ends, "name", "left").join(over, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256")))


def _with_shares(bands: DataFrame, nodes: DataFrame, band: int) -> DataFrame:
    """Adds ``shared`` (turns that a smaller conversation begins with too), ``leaf`` (owns a
    childless node) and ``later`` (code points of shared turns in later bands)."""
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max(F.col("n_children") == 0).alias("leaf"))
    got = bands.join(owned, "conv_id", "left").withColumns({
        "shared": F.coalesce(F.col("top") - 1, F.col("length")), "leaf": F.coalesce("leaf", F.lit(False))}).drop("top")
    here = F.aggregate(F.slice("points", F.lit(1), F.greatest(F.lit(0), F.least(F.lit(band), F.col("shared") - F.col("band") * band)).cast("int")),
                       F.lit(0).cast("long"), lambda a, x: a + x)
    long = written(got.where((F.col("shared") > band) & (F.size("turns") > 0)).select("conv_id", "band", "shared", here.alias("v"))
                   .where(F.col("band") * band < F.col("shared")).drop("shared"))
    if not long.limit(1).count():
        return got.withColumn("later", F.lit(0).cast("long"))
    def total(parts):
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    # What comes later is what comes earlier in bands counted from behind.
    turned = long.select("conv_id", "v", F.col("band").alias("b"))
    last = turned.groupBy("conv_id").agg(F.max("b").alias("last"))
    turned = written(turned.join(last, "conv_id").select("conv_id", (F.col("last") - F.col("b")).alias("band"), "v", "last"))
    later = _before_and_after(turned.select("conv_id", "band", "v"), "v", total, 64).join(last, "conv_id").select(
        "conv_id", (F.col("last") - F.col("band")).alias("band"), F.col("sofar").alias("later"))
    return got.join(written(later), ["conv_id", "band"], "left").withColumn("later", F.coalesce("later", F.lit(0)))
