"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's words are lower-cased (A-Z) runs outside the ASCII characters that are
neither digits nor letters. A window is ``span`` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window.

Fingerprints: of each run of ``span - k + 1`` neighbouring ``k``-grams the least
hash is kept, with its place, on both sides; so every shared span of ``span`` words
has a fingerprint in common at the same offset. The join of document and
benchmark fingerprints gives hits; each hit is extended to all windows around
it, and the windows' words are compared in full. Items shorter than a window
are looked up by all grams of their length (there are ``span - 1`` lengths at most).

The fingerprint and window tables are written first, so the planner broadcasts
them only if their size on disk is below its limit and sorts and merges otherwise.

Null texts have no words; null item ids count as no item. Rows are told apart
by ``doc_id`` (null is a value like any other) and a hash of the text, so rows
that repeat a ``doc_id`` get their own results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import written

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1


def normal(text: str | Column) -> Column:
    """Words joined by one space, A-Z lower-cased letter by letter: full lower-casing looks at a
    letter's neighbours, which would make equal windows differ."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " "))


def grams(norm: Column, n: int) -> Column:
    """All n-grams of words, by place."""
    return F.regexp_extract_all(norm, F.lit(r"(?<![^ ])(?=([^ ]++(?: [^ ]++){%d}))" % (n - 1)), F.lit(1))


def hashed(gram: Column) -> Column:
    return F.xxhash64(gram).bitwiseAND(F.lit(~PLACES))


def fingerprints(rows: DataFrame, k: int, span: int) -> DataFrame:
    """``rows(norm, …)`` exploded to ``f``: the distinct least (hash, place) of the windows, packed into longs.

    Each halving of the windows is a projection of its own: as one expression the
    arrays would be computed anew wherever they occur."""
    keep = [c for c in rows.columns if c != "norm"]
    packed = F.transform(grams(F.col("norm"), k), lambda g, i: hashed(g).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACES))))
    rows = rows.select(*keep, packed.alias("low"))
    have, width = 1, span - k + 1
    while have < width:
        step = min(have, width - have)
        later = F.slice("low", step + 1, F.greatest(F.size("low"), F.lit(1)))
        rows = rows.select(*keep, F.zip_with("low", later, lambda x, y: F.least(x, y)).alias("low"))
        have += step
    return rows.select(*keep, F.explode(F.array_distinct("low")).alias("f"))


def windows_of(items: DataFrame, span: int) -> DataFrame:
    """(item_id, gram, len): all windows of the benchmark items."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    base = items.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", words.alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(span))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    gram = F.transform(starts, lambda s: F.array_join(F.slice("w", s, size), " "))
    return base.select("item_id", size.alias("len"), F.explode(gram).alias("gram")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs(doc_id, text)``."""
    result, docs, same_row = covered_words(docs, items, span, k)
    counted = docs.select("doc_id", "mark", F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return (counted.alias("d").join(result.alias("r"), same_row, "left")
            .select("d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")))


def remove_contaminated(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window."""
    hit = written(covered_words(docs.select("doc_id", "text"), items, span, k)[0].select("doc_id", "mark"))
    same_row = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("r.mark"))
    return docs.alias("d").join(hit.alias("r"), same_row, "left_anti")


def covered_words(docs: DataFrame, items: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame, Column]:
    """(doc_id, mark, n_hit, items) of the rows with windows; the rows with their marks; how both join."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    windows = written(windows_of(items.select("item_id", "text"), span))
    prints = written(fingerprints(items.where("text IS NOT NULL").select(normal("text").alias("norm")), k, span)
                     .select(F.shiftright("f", PLACE_BITS).alias("h")).distinct())
    norm = docs.where("text IS NOT NULL").select("doc_id", "mark", normal("text").alias("norm"))

    # Hits, each extended to the windows that hold it.
    found = (fingerprints(norm, k, span)
             .select("doc_id", "mark", F.shiftright("f", PLACE_BITS).alias("h"), F.col("f").bitwiseAND(F.lit(PLACES)).alias("at"))
             .join(prints, "h").select("doc_id", "mark", "at", F.lit(span).alias("len")))
    hits = found
    lengths = [r.len for r in windows.where(F.col("len") < span).select("len").distinct().limit(span).collect()]
    for n in sorted(lengths):
        short = windows.where(F.col("len") == n).select(F.shiftright(hashed(F.col("gram")), PLACE_BITS).alias("h")).distinct()
        hits = hits.unionByName(
            norm.select("doc_id", "mark", F.posexplode(grams(F.col("norm"), n)).alias("at", "g"))
            .select("doc_id", "mark", F.col("at").cast("long").bitwiseAND(F.lit(PLACES)).alias("at"),
                    F.shiftright(hashed(F.col("g")), PLACE_BITS).alias("h"), F.lit(n).alias("len")).join(short, "h").drop("h"))
    hits = written(hits.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "len")).alias("hits")))

    same_row = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("d.mark").eqNullSafe(F.col("r.mark"))
    words = F.regexp_extract_all("text", F.lit("(" + WORD_ANY_CASE + ")"), F.lit(1))
    held = (docs.alias("d").join(hits.alias("r"), same_row).select("d.doc_id", "d.mark", "text", "hits")
            .dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", words.alias("w"), "hits"))
    # A place is known up to 2**24; longer texts are looked at in all of them.
    around = F.transform("hits", lambda h: F.transform(
        F.sequence(h["at"], F.greatest(h["at"], F.size("w").cast("long")), F.lit(PLACES + 1)),
        lambda p: F.struct(F.greatest(F.when(h["len"] == span, p - (span - k)).otherwise(p), F.lit(0)).alias("lo"),
                           F.least(p, F.size("w") - h["len"]).alias("hi"), h["len"].alias("len"))))
    starts = F.array_distinct(F.flatten(F.transform(
        F.filter(F.flatten(around), lambda x: x["lo"] <= x["hi"]),
        lambda x: F.transform(F.sequence(x["lo"], x["hi"]), lambda s: F.struct(s.alias("at"), x["len"].alias("len"))))))
    tried = (held.select("doc_id", "mark", "w", F.explode(starts).alias("s"))
             .select("doc_id", "mark", "s.at", "s.len",
                     F.translate(F.array_join(F.slice("w", (F.col("s.at") + 1).cast("int"), F.col("s.len")), " "), UPPER, LOWER).alias("gram")))
    exact = tried.join(windows, ["gram", "len"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        F.collect_set(F.struct("at", "len")), lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))))
    result = exact.groupBy("doc_id", "mark").agg(
        covered.cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return result, docs, same_row
