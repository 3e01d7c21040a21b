"""Language identification with a blended-spectrum string kernel.

Two texts are compared by the character n-grams (n = 1, 2, 3) that both contain, each counted once:
k(x, y) = |N(x) & N(y)| / sqrt(|N(x)| |N(y)|).  Nystroem landmarks stand for the training sample,
and one-versus-rest kernel ridge regression learns a weight per landmark and language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.arrowtext import small_batches

#: The training sample, of which every language has the same share: so many documents of each at most,
#: and so many in all, by the smallest hashes of id and text.  Landmarks are the first of them.
SAMPLE_PER_LANG, SAMPLE = 240, 15_360
LANDMARKS_PER_LANG, LANDMARKS = 48, 768
RIDGE = 1e-3
SHARPNESS = 6.0
UND = "und"
#: Numbers that n-grams of code points are hashed to.
SPACE = 1 << 19
#: Texts of one matrix product.
BLOCK = 32
_LETTERS: list[np.ndarray] = []


def held_out(doc_id, mod: int, rest: int):
    """crc32(doc_id as text) mod `mod` = `rest`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def letters() -> np.ndarray:
    """Every code point's lower-case letter, 0 for what is no letter; made once in a process."""
    if not _LETTERS:
        out = np.zeros(0x110000, np.uint64)
        for p in range(0x110000):
            if unicodedata.category(c := chr(p))[0] == "L":
                out[p] = ord(c.lower()[0])
        _LETTERS.append(out)
    return _LETTERS[0]


def ngrams(text: str | None) -> np.ndarray:
    """Sorted numbers of the n-grams in a text, any run of other characters being one; empty without a letter."""
    if not text:
        return np.zeros(0, np.int32)
    c = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not c.any():
        return np.zeros(0, np.int32)
    none = np.zeros(1, np.uint64)
    c = np.concatenate([none, c[(c > 0) | (np.concatenate([none, c[:-1]]) > 0)], none])
    c[c == 0] = 1  # no letter: then n-grams of two lengths are never one number
    seen = np.zeros(SPACE, bool)
    code = c
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            code = c if n == 1 else (code[:-1] << np.uint64(21)) | c[n - 1 :]
            seen[(code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)] = True
    return np.flatnonzero(seen).astype(np.int32)


class Model:
    """Landmarks' weights, added up for each n-gram that any landmark has."""

    def __init__(self, langs: list[str], rows: list[tuple[str, np.ndarray]]) -> None:
        self.langs = langs
        taken: dict[str, int] = {}
        marks = []
        for lang, grams in rows:
            if taken.setdefault(lang, 0) < min(LANDMARKS_PER_LANG, max(1, LANDMARKS // len(langs))):
                taken[lang] += 1
                marks.append(grams)
        self.column = np.full(SPACE, -1, np.int32)
        known = np.unique(np.concatenate(marks))
        self.column[known] = np.arange(len(known))
        spread = np.zeros((len(known), len(marks)), np.float32)
        for j, g in enumerate(marks):
            spread[self.column[g], j] = 1 / np.sqrt(len(g))
        kmm = self._product(marks, spread).astype(np.float64)
        val, vec = np.linalg.eigh((kmm + kmm.T) / 2)
        keep = val > 1e-6
        root = vec[:, keep] / np.sqrt(val[keep])
        phi = self._product([g for _, g in rows], spread) @ root
        y = np.where(np.array([[lang == k for k in langs] for lang, _ in rows]), 1.0, -1.0)
        w = np.linalg.solve(phi.T @ phi + RIDGE * len(rows) * np.eye(phi.shape[1]), phi.T @ y)
        # The kernel with all landmarks times their weights is one product: (texts x n-grams) (n-grams x languages).
        self.weights = spread @ (root @ w).astype(np.float32)

    def _product(self, grams: list[np.ndarray], right: np.ndarray) -> np.ndarray:
        """The texts' normalised n-gram vectors times `right`, block by block."""
        out = np.zeros((len(grams), right.shape[1]), np.float32)
        p = np.zeros((BLOCK, len(right)), np.float32)
        for a in range(0, len(grams), BLOCK):
            p[:] = 0
            for i, g in enumerate(grams[a : a + BLOCK]):
                c = self.column[g]
                p[i, c[c >= 0]] = 1 / np.sqrt(max(1, len(g)))
            out[a : a + BLOCK] = (p @ right)[: len(grams) - a]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams = [ngrams(t) for t in texts]
        f = SHARPNESS * self._product(grams, self.weights).astype(np.float64)
        p = np.exp(f - f.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        some = np.array([len(g) > 0 for g in grams])
        return [self.langs[b] if s else UND for b, s in zip(best, some)], np.where(some, p.max(axis=1), 0.0)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([ngrams(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["lang", "h", "grams"])


def fit(docs: DataFrame, training) -> Model | None:
    """A model from the rows where `training` holds and lang is not null; None without any.

    Every language of these rows is learned.  Rows of one id, text and language count once.
    """
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    each = min(SAMPLE_PER_LANG, max(1, SAMPLE // len(counts)))
    # Of each language's distinct rows those of the smallest hashes; a task passes on no more than that of each.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
    drawn = rows.select("lang", "h").distinct().withColumn("n", nth).where(F.col("n") <= each).select("lang", "h")
    # Broadcast: SAMPLE rows of two columns at most, or one of each language where there are more.
    picked = rows.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    got = picked.select("lang", "h", "text").mapInArrow(_grams, "lang string, h bigint, grams binary").toArrow()  # at most SAMPLE texts' n-grams
    found = sorted((h * 2654435761 % 2**32, h, lang, g) for lang, h, g in zip(*(got[c].to_pylist() for c in ("lang", "h", "grams"))) if g)
    langs = [r.lang for r in sorted(counts, key=lambda r: (-r["count"], r.lang)) if any(x[2] == r.lang for x in found)]
    return Model(langs, [(lang, np.frombuffer(g, np.int32)) for _, _, lang, g in found]) if found else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The input rows' columns plus lang_pred and score, from the text alone; columns of these names are replaced.

    A null text, and one without a letter, is `und` with score 0; so is every row without a model.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            lang, score = shared.value.predict(texts) if shared.value is not None and texts else ([UND] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    from pyspark.sql import types as T

    base = docs.select(*kept)
    return base.mapInArrow(label, T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def languages(docs: DataFrame) -> DataFrame:
    """The contract's query: learn from rows whose crc32(doc_id) mod 3 is not 1, predict all rows."""
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs, ~out)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
