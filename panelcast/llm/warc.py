"""WARC archives of web pages, and their merged capture index.

``write_archives`` writes one WARC record per page with Spark's text writer
(one gzip archive per task, committed by Spark, on any file system). Of pages
with equal payloads of at least ``min_bytes``, the one of the smallest id is a
response, the others revisit it and hold no payload; their headers keep the
payload's size and digest.

``read_archives`` parses the archives as a stream and checks every payload
against its digest. ``capture_history`` is an external merge: each archive's
captures form locally sorted runs of ``RUN`` entries, cut into blocks at the range
bounds; a range's blocks, in order of their first key, feed a loser tree that
merges the runs by URL key, time and id. At most one block per run is open.

A null payload is empty. Null ids come last: such a page revisits if a page
with an id has its payload, else it is a response. Rows that repeat the id and
payload of a response are responses too. Null urls have an empty key.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.components import written
from panelcast.session import ensure_checkpoint_dir

RUN = 200_000
BLOCK = 1024
#: Keys drawn per range to find the bounds.
SAMPLE = 64

CAPTURE = pa.schema([("urlkey", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string())])
CAPTURE_DDL = ("urlkey string, time string, page_id long, payload_bytes long, payload_digest string, record_type string, "
               "refers_to long, archive string")


def base32(hex_digest: Column) -> Column:
    """Base32 of a 40-digit hex string: five hex digits are four base32 ones."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record): every page as the text of a WARC record, without its last line feed.

    ``pages`` holds page_id, url, payload (string or null) and time (``yyyy-MM-ddTHH:mm:ssZ``)."""
    rows = pages.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    slim = written(rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "sha").distinct())
    first = slim.groupBy("sha").agg(F.min("page_id").alias("first"))
    marks = slim.join(first, "sha").where("first IS NOT NULL AND NOT page_id <=> first")
    key = F.col("p.page_id").eqNullSafe(F.col("m.page_id")) & (F.col("p.sha") == F.col("m.sha"))
    told = rows.alias("p").join(marks.alias("m"), key, "left").select("p.*", "m.first")
    digest = base32(F.col("sha"))
    size = F.octet_length("payload").cast("string")
    again = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    body = F.concat(http, F.when(again, "").otherwise(F.col("payload")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("sha"))), line("WARC-Target-URI", url),
        line("WARC-Date", F.col("time")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                               line("WARC-Refers-To", _record_id(F.col("first"), F.col("sha"))))).otherwise(""),
        line("X-Page-ID", F.col("page_id").cast("string")), line("X-Refers-To-ID", F.col("first").cast("string")),
        line("X-Payload-Length", size), F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return told.select(F.concat(head, body, F.lit("\r\n\r")).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    records(pages, min_bytes).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def url_key(url: str | None) -> str:
    """Sort key of a url: host labels reversed, then the rest."""
    if not url or "://" not in url:
        return url or ""
    host, rest = re.match(r"([^/?#]*)(.*)", url.split("://", 1)[1], re.S).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + (rest or "/")


def _capture(head: bytes, block: bytes, archive: str) -> tuple:
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    kind, n = fields["WARC-Type"], int(fields["X-Payload-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{archive}: payload of {fields['WARC-Record-ID']} is damaged")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-ID")
    return (url_key(fields.get("WARC-Target-URI")), fields.get("WARC-Date", ""), page and int(page), n, digest, kind,
            int(refers) if kind == "revisit" and refers else None, archive)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), CAPTURE)], schema=CAPTURE)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures of archives given as lines in order; a gzip archive is never split."""
    rest, name = b"", ""
    for batch in batches:
        lines = batch.column("line").to_pylist()
        names = batch.column("archive")
        name = names[0].as_py()
        data = rest + b"\n".join(lines) + b"\n"
        at, rows = 0, []
        while (cut := data.find(b"\r\n\r\n", at)) >= 0:
            head = data[at:cut]
            size = int(head[head.rindex(b"Content-Length: ") + 16:].split(b"\r\n")[0])
            end = cut + 4 + size
            if end + 4 > len(data):
                break
            rows.append(_capture(head, data[cut + 4:end], name))
            at = end + 4
        rest = data[at:]
        if rows:
            yield _batch(rows)
    if rest.strip():
        raise ValueError(f"{name} ends within a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives in a folder, in the order of the records of each."""
    lines = (spark.read.option("lineSep", "\n").schema("value string").text(path)
             .select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_name").alias("archive")))
    return lines.mapInArrow(parse, CAPTURE_DDL)


def _key(row: tuple) -> bytes:
    """The capture order as bytes, in which Spark and Python compare alike; null ids last."""
    page = b"1" if row[2] is None else b"0" + (row[2] + (1 << 63)).to_bytes(8, "big")
    return b"\0".join((row[0].encode(), row[1].encode(), page))


RUN_DDL = "run string, seq long, " + CAPTURE_DDL
RUN_SCHEMA = pa.schema([("run", pa.string()), ("seq", pa.int64()), *CAPTURE])


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Locally sorted runs of up to ``RUN`` captures."""
    held: list[tuple] = []

    def out():
        held.sort(key=_key)
        name = uuid.uuid4().hex
        rows = [(name, i, *r) for i, r in enumerate(held)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), RUN_SCHEMA)], schema=RUN_SCHEMA)

    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) >= RUN:
            yield out()
    if held:
        yield out()


BLOCK_SCHEMA = pa.schema([("range", pa.int32()), ("run", pa.string()), ("first", pa.binary()), ("captures", pa.binary())])


def cut_blocks(bounds: list[bytes]):
    """Sorted runs as blocks that don't cross the range bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            made, at = [], 0
            while at < len(rows):
                part = bisect.bisect_right(bounds, _key(rows[at][2:]))
                end = at + 1
                while (end < len(rows) and end - at < BLOCK and rows[end][0] == rows[at][0]
                       and (part == len(bounds) or _key(rows[end][2:]) < bounds[part])):
                    end += 1
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, CAPTURE) as w:
                    w.write_batch(_batch([r[2:] for r in rows[at:end]]))
                made.append((part, rows[at][0], _key(rows[at][2:]), sink.getvalue().to_pybytes()))
                at = end
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made), BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)
    return run


class LoserTree:
    """Tournament over the heads of sorted iterators: each inner node keeps the loser of its match."""

    def __init__(self, runs: list):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.n = len(runs)
        self.losers = [-1] * self.n
        self.winner = self._build(1) if self.n else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[0] <= y[0])

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def head(self):
        return self.heads[self.winner] if self.n else None

    def pop(self):
        """The least head; its run moves on and plays up to the root."""
        win = self.winner
        out = self.heads[win]
        self.heads[win] = next(self.runs[win], None)
        node = (win + self.n) // 2
        while node:
            if not self._less(win, self.losers[node]):
                win, self.losers[node] = self.losers[node], win
            node //= 2
        self.winner = win
        return out


def _open(block: bytes):
    for row in zip(*(c.to_pylist() for c in pa.ipc.open_stream(block).read_all().columns)):
        yield _key(row), row


def _rest(tree: LoserTree | None) -> list:
    """The runs of a tree that aren't at their end, with their heads."""
    def again(head, run):
        yield head
        yield from run
    return [] if tree is None else [again(h, r) for h, r in zip(tree.heads, tree.runs) if h is not None]


HISTORY_DDL = "part int, pos long, " + CAPTURE_DDL
HISTORY = pa.schema([("part", pa.int32()), ("pos", pa.int64()), *CAPTURE])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged captures of each range, from its blocks in order of range and first key."""
    tree, part, pos, out = None, None, 0, []

    def drain(limit):
        nonlocal pos
        while tree is not None and (head := tree.head()) is not None and (limit is None or head[0] < limit):
            out.append((part, pos, *tree.pop()[1]))
            pos += 1

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), HISTORY)], schema=HISTORY)
        out.clear()
        return rows

    for batch in batches:
        for block in batch.to_pylist():
            if block["range"] != part:
                drain(None)
                tree, part, pos = None, block["range"], 0
            # Blocks not read yet begin at this one's first key or later.
            drain(block["first"])
            tree = LoserTree([*_rest(tree), _open(block["captures"])])
            if len(out) >= BLOCK:
                yield flush()
    drain(None)
    if out:
        yield flush()


def capture_history(captures: DataFrame) -> DataFrame:
    """All captures with ``part`` and ``pos``: ordered by them, they are ordered by URL key, time and id."""
    spark = captures.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = written(captures.mapInArrow(sorted_runs, RUN_DDL))
    stride = max(1, runs.count() // (SAMPLE * parts))
    drawn = runs.where(F.pmod(F.xxhash64("urlkey", "time", "page_id"), F.lit(stride)) == 0)
    keys = sorted(_key(tuple(r)) for r in drawn.select("urlkey", "time", "page_id").collect())
    bounds = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    bounds = sorted(set(bounds))
    blocks = runs.mapInArrow(cut_blocks(bounds), "range int, run string, first binary, captures binary")
    return blocks.repartition(parts, "range").sortWithinPartitions("range", "first").mapInArrow(merge, HISTORY_DDL)


def archive_and_index(pages: DataFrame) -> DataFrame:
    """Write the archives into the shared folder, read them back, and merge the index."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return capture_history(read_archives(spark, path))
