"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlume.llm.common import materialize, with_columns_in_arrow

DIM = 1024
N = 3
#: Languages in one part of a model (a bound on what is collected and broadcast at once: DIM numbers each); more are compared part by part.
PART = 2000
#: Letters whose vectors a worker keeps (DIM numbers each); they are made from the code point, so the store can be emptied at any time.
MOST_LETTERS = 8192
#: Cells of one matrix of trigram counts.
CELLS = 1 << 22
_BLANK = ord(" ")


@cache
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or a blank for what isn't a letter. Letters whose lower case is several stay as they are."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c <= 0xDFFF and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Letters:
    """Random ±1 vectors of letters, made from the code point alone, so that all workers agree."""

    def __init__(self, dim: int) -> None:
        self.dim, self.known = dim, {}

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if len(self.known) + len(codes) > MOST_LETTERS:
            self.known.clear()
        for c in codes.tolist():
            if c not in self.known:
                self.known[c] = (2 * np.random.default_rng([7, c]).integers(0, 2, self.dim, dtype=np.int8) - 1).astype(np.float32)
        return np.stack([self.known[c] for c in codes.tolist()])

    def ngrams(self, codes: np.ndarray) -> np.ndarray:
        """Each row's letters are permuted by their place (a cyclic shift) and bound (multiplied)."""
        letters, at = np.unique(codes, return_inverse=True)
        vectors = self(letters)
        out = np.ones((len(codes), self.dim), np.float32)
        for k in range(N):
            out *= np.roll(vectors, N - 1 - k, axis=1)[at.reshape(codes.shape)[:, k]]
        return out


@cache
def _letters(dim: int) -> Letters:
    return Letters(dim)


def _points(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, blanks between words single, and the text each belongs to. Each text starts and ends with a blank."""
    points = np.frombuffer(b"".join((b" " + (x or b"") + b" ") for x in texts).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    sizes = np.array([len((x or b"").decode("utf-8", "replace")) + 2 for x in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    points = _folded()[points]
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != _BLANK) | (points[:-1] != _BLANK) | (owner[1:] != owner[:-1])
    return points[keep], owner[keep]


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of distinct trigrams, owner of each trigram, index of each trigram in codes)."""
    points, owner = _points(texts)
    if len(points) < N:
        return np.zeros((0, N), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters, at = np.unique(points, return_inverse=True)
    inside = owner[N - 1 :] == owner[: 1 - N]
    base = len(letters)
    key = np.zeros(len(points) - N + 1, np.int64)
    for k in range(N):
        key = key * base + at[k : len(points) - N + 1 + k]
    key, owner = key[inside], owner[N - 1 :][inside]
    if base**N <= 1 << 24:  # few distinct letters: number the trigrams by a table
        seen = np.zeros(base**N, bool)
        seen[key] = True
        distinct = np.flatnonzero(seen)
        number = np.zeros(base**N, np.int64)
        number[distinct] = np.arange(len(distinct))
        index = number[key]
    else:
        distinct, index = np.unique(key, return_inverse=True)
    codes = np.stack([letters[distinct // base ** (N - 1 - k) % base] for k in range(N)], 1)
    return codes, owner, index


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of few texts, so that counts of all their trigrams fit a dense matrix."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x or b"")
        if size > 1 << 20 or i - start >= 255:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _bundles(texts: list[bytes | None], groups: np.ndarray, n_groups: int, dim: int) -> np.ndarray:
    """The sum of all trigram vectors of each group of texts."""
    codes, owner, index = trigrams(texts)
    out = np.zeros((n_groups, dim), np.float32)
    step = max(1, CELLS // max(1, n_groups), CELLS // dim // 4)
    for a in range(0, len(codes), step):
        part = (index >= a) & (index < a + step)
        width = min(step, len(codes) - a)
        counts = np.bincount(groups[owner[part]] * width + index[part] - a, minlength=n_groups * width).reshape(n_groups, width)
        for b in range(0, width, 4096):
            out += counts[:, b : b + 4096].astype(np.float32) @ _letters(dim).ngrams(codes[a + b : a + min(width, b + 4096)])
    return out


def prototypes(labelled: DataFrame, dim: int = DIM) -> DataFrame:
    """lang, dim, value: each language's bundle over all its texts, summed in each batch first. Rows of null lang are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: k for k, x in enumerate(names)}
            total = np.zeros((len(names), dim))
            for a, b in _slices(texts):
                total += _bundles(texts[a:b], np.array([number[x] for x in langs[a:b]]), len(names), dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, dim).tolist(), pa.string()), pa.array(np.tile(np.arange(dim), len(names)), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["lang", "dim", "value"])

    bundles = labelled.where("lang is not null").select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, dim int, value double")
    return bundles.groupBy("lang", "dim").agg(F.sum("value").alias("value"))


Model = list[tuple[list[str], np.ndarray]]


def fit(labelled: DataFrame, dim: int = DIM, part: int = PART) -> Model:
    """Parts of at most ``part`` languages in order, each (languages, unit prototypes)."""
    bundles = materialize(prototypes(labelled, dim), "prototypes")
    names = sorted(r["lang"] for r in bundles.select("lang").distinct().collect())
    out = []
    for a in range(0, len(names), part):
        mine = names[a : a + part]
        rows = bundles.where(F.col("lang").between(mine[0], mine[-1])).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).collect()
        found = {r["lang"]: [x["value"] for x in r["v"]] for r in rows}
        vectors = np.array([found[x] for x in mine]).reshape(len(mine), dim)
        out.append((mine, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)))
    return out


def nearest(texts: list[bytes | None], names: list[str], vectors: np.ndarray) -> Iterator[tuple[str | None, float]]:
    """The language and cosine of each text's nearest prototype, the first of equal ones; (None, 0) for a text without a letter."""
    for a, b in _slices(texts):
        part = texts[a:b]
        bundle = _bundles(part, np.arange(len(part)), len(part), vectors.shape[1])
        norm = np.linalg.norm(bundle, axis=1)
        cosine = (bundle / np.maximum(norm, 1e-12)[:, None]) @ vectors.T
        for k, best in enumerate(cosine.argmax(axis=1)):
            yield (names[best], float(cosine[k, best])) if norm[k] > 0 else (None, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred and lang_score: the prototype nearest to the whole text by cosine, and that cosine (0 if negative, 1 at most).

    Null text, text without a letter, and an empty model give ``und`` and 0. Ties go to the first language in order. Repeated rows stay; columns of the added
    names are replaced; an empty table gives no row. Parts of a large model are compared one after the other, with a written table between them.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    if not model:
        return with_columns_in_arrow(docs, [text], added, lambda column: {"lang_pred": ["und"] * len(column), "lang_score": [0.0] * len(column)}, drop)
    out = docs
    for k, (names, vectors) in enumerate(model):
        shared = docs.sparkSession.sparkContext.broadcast((names, vectors.astype(np.float32)))

        def make(column: pa.Array, *before: pa.Array, shared=shared) -> dict[str, list]:
            found = list(nearest(column.to_pylist(), *shared.value))
            old = list(zip(*[x.to_pylist() for x in before])) if before else [("und", 0.0)] * len(found)
            # An earlier part's language keeps its place among equal ones; the first part's counts even at a cosine below 0.
            kept = [(x.decode() if isinstance(x, bytes) else x, s) if n is None or (before and s >= c) else (n, min(1.0, max(0.0, c))) for (n, c), (x, s) in zip(found, old)]
            return {"lang_pred": [n for n, _ in kept], "lang_score": [s for _, s in kept]}

        out = with_columns_in_arrow(out, [text, *(("lang_pred", "lang_score") if k else ())], added, make, drop if k + 1 == len(model) else ())
        if k + 1 < len(model):
            out = materialize(out, "languages")
    return out


def report(docs: DataFrame) -> DataFrame:
    """One row for each document, predicted by a model of the documents with crc32(doc_id) modulo 4 other than 2; a null doc_id isn't held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out).select("lang", "text"))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, drop=("text",)).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
