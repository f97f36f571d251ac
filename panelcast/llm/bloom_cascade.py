"""URL filter: exact membership of listed hosts by a Bloom filter cascade, and rules.

Level 1 encodes the listed keys. Level 2 encodes those unlisted keys of the
universe (all distinct hosts of the corpus) that pass level 1, level 3 the listed
keys that pass level 2, and so on until no key is left; membership is then exact
for every key of the universe. A url is tested by bit lookups in the levels'
arrays, without a join. Above ``SHARD_KEYS`` listed keys the key space is split
by hash, and each shard's levels reach the urls by one equi-join on the shard.

DataFrame functions alone. Null urls and urls without ``://`` have an empty host
and path, which no rule fits and no list holds. Repeated rows are judged alike;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import written

BITS_PER_KEY = 8
HASHES = 4
SHARD_KEYS = 4_000_000
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    rest = F.coalesce(F.regexp_substr(F.col(url), F.lit(r"(?s)://.*")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^://[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (verdict, host, path) rule that fits, as a struct of rule and verdict; null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _places(key: Column, level: int, n_bits: Column | int) -> list[Column]:
    """Bit places of a key in a level's filter, by double hashing."""
    a = F.xxhash64(key, F.lit(2 * level))
    b = F.xxhash64(key, F.lit(2 * level + 1)).bitwiseOR(F.lit(1))
    bits = F.lit(n_bits) if isinstance(n_bits, int) else n_bits
    return [F.pmod(F.pmod(a, bits) + i * F.pmod(b, bits), bits) for i in range(HASHES)]


def _in(words: Column, key: Column, level: int) -> Column:
    """Whether a level's filter, as an array of 64-bit words, holds the key."""
    n_bits = (F.size(words) * 64).cast("long")
    out = F.lit(True)
    for p in _places(key, level, n_bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        out = out & (F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def _filter(keys: DataFrame, level: int, shards: int, most: int) -> DataFrame:
    """(shard, words): one filter per shard over ``keys(key, shard)``; all have one size, set by the fullest."""
    n_words = max(1, -(-most * BITS_PER_KEY // 64))
    spark = keys.sparkSession
    places = keys.select("shard", F.explode(F.array(*_places(F.col("key"), level, 64 * n_words))).alias("p"))
    bits = places.select("shard", F.shiftright("p", 6).alias("word"),
                         F.expr("shiftleft(1L, cast(p & 63 AS int))").alias("bit"))
    blank = (spark.range(shards * n_words)
             .select((F.col("id") / n_words).cast("long").alias("shard"), (F.col("id") % n_words).alias("word"), F.lit(0).cast("long").alias("bit")))
    whole = bits.unionByName(blank).groupBy("shard", "word").agg(F.bit_or("bit").alias("bits"))
    return (whole.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
            .select("shard", F.col("w.bits").alias("words")))


class Cascade:
    """Levels of a cascade over ``universe(key, listed)``, with distinct keys."""

    def __init__(self, universe: DataFrame, shard_keys: int = SHARD_KEYS):
        listed = universe.where("listed").count()
        self.shards = max(1, -(-listed // shard_keys))
        keys = written(universe.select("key", "listed", F.pmod(F.xxhash64("key"), F.lit(self.shards)).alias("shard")))
        self.levels: list[DataFrame] = []
        left, turn = keys, True
        while True:
            encode = left.where(F.col("listed") == turn)
            most = encode.groupBy("shard").count().agg(F.max("count")).first()[0]
            if not most:
                break
            if len(self.levels) == MAX_LEVELS:
                raise ValueError("the cascade doesn't end: are the keys distinct?")
            self.levels.append(written(_filter(encode, len(self.levels), self.shards, most)))
            # All that this level encodes stays; of the others what passes by mistake.
            other = self._join(left.where(F.col("listed") != turn), [self.levels[-1]])
            level = len(self.levels) - 1
            passed = other.where(_in(F.col("w0"), F.col("key"), level)).drop("w0")
            left = written(passed.select("key", "listed", "shard").unionByName(encode.select("key", "listed", "shard")))
            turn = not turn

    def _join(self, rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
        for i, words in enumerate(levels):
            if self.shards == 1:
                rows = rows.withColumn(f"w{i}", words.select("words").scalar())
            else:
                rows = rows.join(words.withColumnRenamed("words", f"w{i}"), "shard")
        return rows

    def lookup(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        """``rows`` with ``out``: whether the key, which must be of the universe, is listed."""
        keep = [F.col(c) for c in rows.columns]
        rows = self._join(rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(self.shards))), self.levels)
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~_in(F.col(f"w{i}"), F.col(key), i), F.lit(i % 2 == 1)).otherwise(answer)
        return rows.select(*keep, answer.alias(out))


def judge(pages: DataFrame, listed: Column, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of ``pages(page_id, url)``.

    ``listed`` tells from the column ``key`` (a distinct host) whether it is on the block list."""
    host, path = url_parts("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    universe = rows.select(F.col("host").alias("key")).distinct().withColumn("listed", F.coalesce(listed, F.lit(False)))
    seen = Cascade(universe).lookup(rows, "host", "listed")
    ruled = seen.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                        F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
