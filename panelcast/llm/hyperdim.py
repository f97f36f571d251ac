"""Language identification by hyperdimensional n-gram profiles.

Every letter has a random vector of ``DIMS`` signs. A trigram binds its
letters' vectors (rotated by place, multiplied), a text bundles (adds) its
trigrams' vectors, and a language's prototype bundles its training texts. A
text gets the language whose prototype has the largest cosine.

Letters are lower-cased; any run of other characters is one separator, which
also stands at both ends, so a text of one letter has a trigram. Every letter is
a symbol of its own. The vectors of ``a``-``z`` and the separator are drawn and
their trigrams kept in a table; those of all other letters are the bits of a
hash of the letter, and their trigrams are bound as they occur. Bundles are
integer sums, so prototypes don't depend on partitioning or order. Prototypes
cover all training texts; there are at most ``MAX_LANGS`` languages (checked),
whence the driver holds little.

Null texts and texts without a letter are ``und`` with score 0, as is
everything when there is nothing to learn from. Ties go to the language that
sorts first. Extra columns are ignored; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import vec
from panelcast.llm.vec import U

DIMS = 1024
#: Symbols in the table of trigrams: the separator and a-z. Other letters follow by code point.
SYMBOLS = 27
#: Bits of a symbol in the code of a trigram that isn't in the table.
WIDE = 21
#: Trigrams whose vectors are held at a time, and bytes and rows of text: a row holds ``DIMS`` sums.
BLOCK = 512
SLICE_BYTES = 1 << 17
ROWS = 512
MAX_LANGS = 2000
UNKNOWN = "und"


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of every code point: 0 for all that are no letters."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()[0]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else SYMBOLS + ord(low)
    return out


@lru_cache(1)
def _plain() -> np.ndarray:
    return np.random.default_rng(2024).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMS))


def letter_vectors(symbol: np.ndarray) -> np.ndarray:
    """Vectors of the given symbols."""
    words = vec.mix(symbol.astype(U)[:, None] * U(DIMS // 64) + np.arange(DIMS // 64, dtype=U), 2024)
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1).astype(np.int8)
    out = 2 * bits - np.int8(1)
    plain = np.flatnonzero(symbol < SYMBOLS)
    out[plain] = _plain()[symbol[plain]]
    return out


def wide_sums(code: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Per group, the sum of the bound vectors of trigrams that aren't in the table."""
    out = np.zeros((groups, DIMS), np.int64)
    order = np.lexsort((code, group))
    code, group = code[order], group[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(code)])
    code, group = code[at], group[at]
    for a in range(0, len(code), BLOCK):
        c, g = code[a:a + BLOCK], group[a:a + BLOCK]
        places = [c >> (2 * WIDE), (c >> WIDE) & ((1 << WIDE) - 1), c & ((1 << WIDE) - 1)]
        symbol, of = np.unique(np.concatenate(places), return_inverse=True)
        letters = letter_vectors(symbol)
        x, y, z = of.reshape(3, -1)
        bound = np.roll(letters, 2, 1)[x] * np.roll(letters, 1, 1)[y] * letters[z]
        first = vec.runs(g)
        out[g[first]] += np.add.reduceat(bound * count[a:a + BLOCK, None].astype(np.int32), first, axis=0)
    return out


@lru_cache(1)
def trigram_vectors() -> np.ndarray:
    """Bound vectors of the trigrams in the table, by code."""
    letters = _plain()
    two = np.roll(letters, 2, 1)[:, None, :] * np.roll(letters, 1, 1)[None, :, :]
    return (two.reshape(-1, 1, DIMS) * letters[None, :, :]).reshape(-1, DIMS)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``SLICE_BYTES`` of text and at most ``ROWS`` rows, so that a task's memory doesn't follow from how short texts are."""
    for batch in vec.slices(batches, "text", SLICE_BYTES):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all rows, row offsets, and whether a row has a letter."""
    data, _ = vec.text_bytes(col)
    size = pc.fill_null(pc.utf8_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    off = np.r_[0, np.cumsum(size)]
    rows = len(size)
    wide = off + 2 * np.arange(rows + 1)
    s = np.zeros(wide[-1], np.int32)
    s[np.arange(len(points)) + np.repeat(2 * np.arange(rows) + 1, size)] = _symbols()[points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    keep[wide[:-1]] = True
    off = np.r_[0, np.cumsum(keep)][wide]
    s = s[keep].astype(np.int64)
    x, y, z = s[:-2], s[1:-1], s[2:]
    plain = np.maximum(np.maximum(x, y), z) < SYMBOLS
    # No trigram within a row has two separators in front, so the others' codes are larger than the table's.
    code = np.where(plain, (x * SYMBOLS + y) * SYMBOLS + z, (x << (2 * WIDE)) | (y << WIDE) | z) if len(s) > 2 else s[:0]
    at = vec.inside_rows(off, 3)
    letters = np.diff(np.r_[0, np.cumsum(s > 0)][off]) > 0
    return code[at], np.searchsorted(at, off), letters


def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language, the sum of its texts' vectors."""
    counts: dict[str, np.ndarray] = {}
    others: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        code, off, _ = trigrams(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        kind = np.repeat(langs.indices.to_numpy(), np.diff(off))
        n = SYMBOLS ** 3
        wide = code >= n
        sums = wide_sums(code[wide], kind[wide], len(langs.dictionary))
        code, kind = code[~wide], kind[~wide]
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            counts[lang] = counts.get(lang, 0) + np.bincount(code[kind == i], minlength=n)
            others[lang] = others.get(lang, 0) + sums[i]
        if len(counts) > MAX_LANGS:
            raise ValueError(f"over {MAX_LANGS} languages")
    for lang, c in counts.items():
        used = np.flatnonzero(c)
        total = others[lang]
        for a in range(0, len(used), BLOCK):
            x = used[a:a + BLOCK]
            total = total + c[x].astype(np.int64) @ trigram_vectors()[x].astype(np.int64)
        yield pa.RecordBatch.from_pydict({"lang": [lang], "bundle": pa.array([total], pa.list_(pa.int64()))})


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of every language in ``labelled(text, lang)``; null languages are left out."""
    parts = labelled.where("lang IS NOT NULL").select("text", "lang").mapInArrow(bundles, "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle").alias("dim", "v")).groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    rows = (sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("p"))
            .select("lang", F.col("p.v").alias("p")).orderBy("lang").limit(MAX_LANGS + 1).collect())
    if len(rows) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    return {r.lang: np.array(r.p, np.float64) for r in rows}


def predict(models: dict[str, np.ndarray], keep_text: bool = False):
    langs = list(models)
    table = np.stack([models[x] for x in langs]) if langs else np.zeros((0, DIMS))
    table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = trigram_vectors()
        for batch in slices(batches):
            code, off, letters = trigrams(batch.column("text"))
            wide = code >= len(vectors)
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))
            bundle = wide_sums(code[wide], row[wide], batch.num_rows).astype(np.float32)
            code, off = code[~wide], np.r_[0, np.cumsum(~wide)][off]
            for i in np.flatnonzero(letters).tolist():
                c = np.bincount(code[off[i]:off[i + 1]])
                used = np.flatnonzero(c)
                for a in range(0, len(used), BLOCK):
                    x = used[a:a + BLOCK]
                    bundle[i] += c[x].astype(np.float32) @ vectors[x].astype(np.float32)
            pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if langs:
                whole = bundle.astype(np.float64)
                norm = np.maximum(np.linalg.norm(whole, axis=1), 1e-300)
                cos = whole @ table.T / norm[:, None]
                best = cos.argmax(1)
                ok = np.flatnonzero(letters)
                for i in ok.tolist():
                    pred[i] = langs[best[i]]
                score[ok] = np.clip(cos[ok, best[ok]], 0, 1)
            names = [n for n in batch.schema.names if keep_text or n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(pred), pa.array(score)],
                                             [*names, "lang_pred", "score"])
    return run


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls into the fold that isn't learned from; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def with_language(docs: DataFrame, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, lang, ...)`` with the predicted language and its score."""
    train = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    done = docs.mapInArrow(predict(prototypes(train), keep_text=True), ", ".join([*kinds, "_lang_pred string, _lang_score double"]))
    return done.withColumnsRenamed({"_lang_pred": pred, "_lang_score": score})


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows outside the held-out fold."""
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), held_out().alias("held_out"))
    models = prototypes(docs.where("NOT held_out AND doc_id IS NOT NULL"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        predict(models), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
