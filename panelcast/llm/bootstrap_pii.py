"""Personal data: base patterns, and bootstrapped contextual extraction beyond them.

``mentions`` finds e-mail addresses, IPv4 addresses, payment cards and phone numbers
by fixed patterns in whole texts, and beside them the other identifier-like
tokens (with a digit or ``@``) as candidates. A mention's contexts, the two words
before it and the words around it, are lexical patterns. Spark scores the
graph of patterns and instances (distinct values) in ``ROUNDS`` rounds:

* a pattern's confidence is the summed score of its instances of one kind,
  divided by the number of all its instances and ``SMOOTH``; it is kept with
  ``MIN_SEEDS`` scored instances and a confidence of ``MIN_PATTERN``,
* a candidate's score is one minus the product of what its kept patterns leave
  open; from ``MIN_INSTANCE`` it is an instance of that kind in the next round.

Candidates kept after the last round that stand in a kept pattern are spans
too. Base spans always stay. Counts and ``base_sha256`` tell of base spans only.

Null text is empty. Offsets are code points. Rows are told apart by ``doc_id``
(null is a value like any other) and a hash of the text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import vec
from panelcast.llm.components import written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SMOOTH = 1.0
MIN_SEEDS = 5
MIN_PATTERN = 0.8
MIN_INSTANCE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: what follows the run is the same.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NEAR_ID = re.compile(r"[^\s]*[0-9@][^\s]*")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, in linear time on any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _word(text: str) -> str:
    return text.lower()[-24:].strip(".,;:!?\"'")


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a mention: two words before it; one word on each side."""
    before = text[max(0, start - 80):start].split()[-2:]
    after = text[end:end + 40].split()[:1]
    left = _word(before[-1]) if before else "^"
    out = [f"{left} _ {_word(after[0]) if after else '$'}"]
    if len(before) == 2:
        out.append(f"{_word(before[0])} {left} _")
    return out


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Base mentions and candidates with their contexts."""
    found = list(spans)
    taken = sorted((a, b) for a, _, b in spans)
    i = 0
    if "@" in text or _DIGIT.search(text):
        for m in _NEAR_ID.finditer(text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if i < len(taken) and taken[i][0] < m.end():
                continue
            a, b = m.start(), m.end()
            while a < b and text[a] in "\"'([{<=.,;:!?*#%&$|":
                a += 1
            while b > a and text[b - 1] in "\"')]}>=.,;:!?*#%&$|":
                b -= 1
            if b > a:
                found.append((a, -1, b))
    return [{"start": a, "stop": b, "kind": k, "value": hashlib.sha1(text[a:b].lower().encode("utf-8", "replace")).hexdigest()[:20],
             "patterns": contexts(text, a, b)} for a, k, b in found]


MENTION = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("value", pa.string()),
                              ("patterns", pa.list_(pa.string()))]))
MENTION_DDL = "array<struct<start:long,stop:long,kind:int,value:string,patterns:array<string>>>"


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in vec.slices(batches, "text", 1 << 23):
        counts = [[] for _ in KINDS]
        digest, near = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            for i, c in enumerate(counts):
                c.append(sum(k == i for _, k, _ in spans))
            digest.append(hashlib.sha256(joined(spans).encode()).hexdigest())
            near.append(mentions(text, spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()),
             pa.array(near, MENTION)], ["doc_id", "mark", *(f"n_{k}" for k in KINDS), "base_sha256", "mentions"])


def bootstrap(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept patterns (pattern, kind, conf) and instances (value, kind, score) of a pattern-instance
    graph ``edges(pattern, value, kind)``, whose seeds have a kind of 0 or more."""
    edges = written(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    scored = edges.where("kind >= 0").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    size = written(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SEEDS))
    links = edges.join(size, "pattern")
    open_links = edges.where("kind < 0").select("pattern", "value")
    for _ in range(ROUNDS):
        support = (links.drop("kind").join(scored, "value").groupBy("pattern", "n", "kind")
                   .agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("seeds")))
        patterns = (support.withColumn("conf", F.col("s") / (F.col("n") + SMOOTH))
                    .where((F.col("seeds") >= MIN_SEEDS) & (F.col("conf") >= MIN_PATTERN))
                    .groupBy("pattern").agg(F.max(F.struct("conf", "kind")).alias("best"))
                    .select("pattern", "best.kind", "best.conf"))
        patterns = written(patterns)
        found = (open_links.join(patterns, "pattern").groupBy("value", "kind")
                 .agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score"))
                 .groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best"))
                 .select("value", "best.kind", "best.score").where(F.col("score") >= MIN_INSTANCE))
        found = written(found)
        scored = edges.where("kind >= 0").select("value", "kind", F.lit(1.0).alias("score")).distinct().unionByName(found)
    return patterns, found


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``docs(doc_id, text)``."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    return private_spans(docs).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.array_join(text, ",").alias("spans"))


def _bootstrapped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts, digest and mentions of every row; (doc_id, mark, more) of the rows in which the method found spans."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.mapInArrow(extract, f"doc_id {kind}, mark long, " + ", ".join(f"n_{k} long" for k in KINDS)
                                   + f", base_sha256 string, mentions {MENTION_DDL}"))
    near = rows.where(F.size("mentions") > 0).select("doc_id", "mark", F.explode("mentions").alias("m")).select("doc_id", "mark", "m.*")
    edges = near.select(F.explode("patterns").alias("pattern"), "value", "kind")
    patterns, found = bootstrap(edges)
    open_near = near.where("kind < 0").drop("kind").withColumn("pattern", F.explode("patterns"))
    more = (open_near.join(patterns.select("pattern", "kind"), "pattern").join(found.select("value", "kind"), ["value", "kind"])
            .groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("more")))
    return rows, more


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), counts, base_sha256 and the sorted spans (start, kind, stop) of every row."""
    rows, more = _bootstrapped(docs)
    same = F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & F.col("r.mark").eqNullSafe(F.col("x.mark"))
    base = F.transform(F.filter("mentions", lambda m: m["kind"] >= 0),
                       lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["stop"].alias("stop")))
    none = F.array().cast("array<struct<start:long,kind:int,stop:long>>")
    return (rows.alias("r").join(more.alias("x"), same, "left")
            .select("r.doc_id", "r.mark", *(f"n_{k}" for k in KINDS), "base_sha256",
                    F.sort_array(F.array_union(base, F.coalesce("more", none))).alias("spans")))


#: Bits that tell which rows may hold spans beyond the base ones: a fixed size, whatever the corpus.
ROW_BITS = 1 << 23


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (start, kind, stop) replaced by its kind in brackets; of overlapping ones the first counts."""
    out, at = [], 0
    for start, kind, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, ...)``, each span replaced by its kind in brackets.

    Base spans are found anew and masked in one map pass, without a join. Rows that may
    hold more, by a bitmap of their hashes, keep their text in that pass; they alone meet
    the found spans in a join, so texts aren't shuffled for the few that need it.
    """
    _, more = _bootstrapped(docs.select("doc_id", F.col(text).alias("text")))
    more = written(more)
    place = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(ROW_BITS))
    words = (more.select(F.shiftright(place, 5).alias("w"), F.expr("1L").alias("one"), (place % 32).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.call_function("shiftleft", "one", F.col("b"))).alias("v")).collect())  # at most ROW_BITS / 32 rows
    bits = np.zeros(ROW_BITS // 32, np.uint32)
    for w, v in words:
        bits[w] = v
    table, names = docs.sparkSession.sparkContext.broadcast(bits), docs.columns
    # Names that no column of the caller's has.
    own = next(p for p in ("_", "__", "___", "____") if not {f"{p}{n}".lower() for n in ("at", "open")} & {c.lower() for c in names})
    at, is_open = f"{own}at", f"{own}open"
    mark = F.xxhash64(F.col(f"`{text}`"))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.slices(batches, text, 1 << 23):
            p = batch.column(at).to_numpy(zero_copy_only=False)
            may = (table.value[p >> 5] >> (p & 31).astype(np.uint32) & 1).astype(bool)
            texts = [t if t is None or m else masked(t, base_spans(t)) for t, m in zip(batch.column(text).to_pylist(), may.tolist())]
            columns = [pa.array(texts, batch.schema.field(text).type) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(may)], names=[*names, is_open])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{is_open}` boolean"])
    done = written(docs.withColumn(at, F.pmod(F.xxhash64("doc_id", mark), F.lit(ROW_BITS))).mapInArrow(mask, ddl))
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & F.xxhash64(F.col(f"d.`{text}`")).eqNullSafe(F.col("x.mark"))

    def mask_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.slices(batches, text, 1 << 23):
            more_spans = batch.column(is_open).to_pylist()
            texts = [t if t is None else masked(t, [*base_spans(t), *((r["start"], r["kind"], r["stop"]) for r in m or ())])
                     for t, m in zip(batch.column(text).to_pylist(), more_spans)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(text).type) if n == text else batch.column(n) for n in names], names=names)

    rest = done.where(F.col(f"`{is_open}`")).alias("d").join(more.alias("x"), same, "left")
    rest = rest.select(*[F.col(f"d.`{c}`") for c in names], F.col("x.more").alias(is_open)).mapInArrow(
        mask_all, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return done.where(~F.col(f"`{is_open}`")).select(*[F.col(f"`{c}`") for c in names]).unionByName(rest)
