"""Toxicity by compression distance: windows are compressed with a toxic and an ordinary zstandard dictionary, and their lengths compared."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlume.llm.common import byte_table, materialize, quoted, release, with_columns_in_arrow

#: Labelled documents of each class that a model is fitted on, the first by hash; at most this many are ever read for it.
SAMPLE = 2000
#: Words in a window. A window is compressed twice over: the second copy is one match, so that a lone match in the first one already shortens the block.
WINDOW = 6
#: Bytes of the dictionary trained on ordinary texts, and z score from which a word's share of toxic documents exceeds its share of ordinary ones; folds choose one pair.
SIZES, ZS = (2048, 16384), (4.5, 6.0)
#: The share of toxic documents must also be this many times that of ordinary ones, and at least LEAST, so that a few copies of a text don't make its words typical.
TIMES, LEAST = 4, 0.01
#: Bytes of the dictionary trained on toxic texts, at most, and the trainer's segment and match lengths.
BYTES, SEGMENT, MATCH = 8192, 24, 6
#: Bytes of the shortest beginning of a word (with its blank) that is counted.
LEAST_BYTES = 5
#: Gains (bytes) from which a window may count; folds choose one. A document's distance is its excess gains over its windows, of which it has SMOOTH more.
GAINS, SMOOTH = tuple(range(1, 11)), 20
#: Share of ordinary documents that the calibrated threshold may put among the toxic ones.
FALSE_ALARMS = 0.01
WORDS = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Beginnings of words that a task counts before it passes the counts on.
HELD = 50_000
_FOLDS = 3


class Model(NamedTuple):
    """Dictionaries, gain from which a window counts, and distance from which a text is toxic. A model without dictionaries gives every text the same score."""

    toxic: bytes
    ordinary: bytes
    gain: int = 1
    threshold: float = 1.0
    constant: float | None = None


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def windows(text: bytes | None) -> list[bytes]:
    words = words_of(text)
    return [b" %s " % b" ".join(words[i : i + WINDOW]) * 2 for i in range(0, len(words), WINDOW)]


def beginnings(word: bytes) -> list[bytes]:
    """The word's beginnings with the blank before it, shortest first; the last is the word between blanks."""
    word = b" %s " % word
    return [word[:n] for n in range(min(LEAST_BYTES, len(word)), len(word) + 1)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=13, chain_log=13, search_log=4, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    made = zstandard.ZstdCompressionDict(content.rjust(64), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=params)


class _Gains:
    """How many bytes fewer the toxic dictionary makes of each window of a text."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = _compressor(toxic).compress, _compressor(ordinary).compress

    def __call__(self, text: bytes | None) -> np.ndarray:
        return np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text)], np.float64)


_gains: dict[int, _Gains] = {}


def _gains_of(toxic: bytes, ordinary: bytes) -> _Gains:
    key = hash((toxic, ordinary))
    if key not in _gains:
        if len(_gains) > _FOLDS * len(SIZES) * len(ZS):
            _gains.clear()
        _gains[key] = _Gains(toxic, ordinary)
    return _gains[key]


def distance(gains: np.ndarray, gain: int) -> float:
    return float(np.maximum(gains - gain + 1, 0).sum() / (len(gains) + SMOOTH))


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary that zstandard's trainer makes of the samples; of too few, the samples' own distinct bytes."""
    try:
        return zstandard.train_dictionary(size + 256, samples, k=SEGMENT, d=MATCH, f=20, accel=1).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _typical_text(text: bytes | None, typical: set[bytes]) -> bytes:
    """Each distinct word of a toxic text, or its longest beginning, that is typical of toxic texts."""
    out = []
    for word in dict.fromkeys(words_of(text)):
        found = [x for x in beginnings(word) if x in typical]
        if found:
            out.append(found[-1])
    return b"".join(out)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, toxic, fold of at most ``size`` labelled documents of each class: the first by a hash of doc_id. Labels other than 0 and 1 are left out."""
    per_class = [labels.where(F.col("toxic") == k).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for k in (0, 1)]
    chosen = F.broadcast(per_class[0].unionByName(per_class[1]))  # at most 2 * size rows of two integers
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(_FOLDS)).cast("int").alias("fold")
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, "doc_id").select("text", "toxic", fold)


def _counted(rows: DataFrame) -> DataFrame:
    """s, k (array: toxic documents of each fold that hold s), m (ordinary ones)."""

    def counted(counts: Counter[tuple[bytes, int, int]]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*([x[i] for x in counts] for i in range(3)), list(counts.values())), kinds)], names=["s", "toxic", "fold", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[bytes, int, int]] = Counter()
        for batch in batches:
            for text, toxic, fold in zip(*[c.to_pylist() for c in batch.columns]):
                counts.update((s, toxic, fold) for s in {s for w in set(words_of(text)) for s in beginnings(w)})
                if len(counts) > HELD:
                    yield counted(counts)
                    counts.clear()
        yield counted(counts)
        counts.clear()
        release()

    held = rows.mapInArrow(run, "s binary, toxic int, fold int, n bigint")
    one = lambda toxic, fold: F.sum(F.when((F.col("toxic") == toxic) & (F.col("fold") == fold), F.col("n")).otherwise(0))
    return held.groupBy("s").agg(F.array(*[one(1, f) for f in range(_FOLDS)]).alias("k"), F.array(*[one(0, f) for f in range(_FOLDS)]).alias("m"))


def _z(k, n1: int, m, n0: int):
    pooled = (k + m) / (n0 + n1)
    return (k / n1 - m / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1) + 1e-12)


def _parts() -> list[tuple[int, ...]]:
    """Folds to train on: each is left out in turn."""
    return [tuple(f for f in range(_FOLDS) if f != held) for held in range(_FOLDS)]


def dictionaries(rows: DataFrame, n: dict[tuple[int, int], int]) -> dict[tuple[int, float, int], tuple[bytes, bytes]]:
    """(toxic, ordinary) dictionaries of (part, z, ordinary size); n: documents of (class, fold).

    The ordinary dictionary is trained on whole ordinary texts. The toxic one holds it too, so that what all texts share costs the same with both, behind
    content trained on the toxic texts' own words: those whose share of documents exceeds the ordinary texts' at a z score. Without that contrast the trainer
    keeps what is frequent in all texts. Training takes one task, which reads the bounded sample; the driver gets the dictionaries.
    """
    counted, typical = _counted(rows), {}
    zs = []
    for p, folds in enumerate(_parts()):
        k, m = (sum((F.col(c)[f] for f in folds), F.lit(0)) for c in "km")
        n1, n0 = (max(1, sum(n.get((c, f), 0) for f in folds)) for c in (1, 0))
        zs.append(F.when((k >= 4) & (k / n1 >= LEAST) & (k / n1 >= TIMES * m / n0), _z(k, n1, m, n0)).otherwise(-1.0))
    found = counted.select("s", F.array(*zs).alias("z")).where(F.array_max("z") > min(ZS)).collect()  # few: typical beginnings of words in a bounded sample
    for p in range(len(zs)):
        for z in ZS:
            typical[p, z] = {bytes(r["s"]) for r in found if r["z"][p] > z}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for batch in batches for x in zip(*[c.to_pylist() for c in batch.columns])]
        out = []
        for p, folds in enumerate(_parts()):
            ordinary = [b" %s " % b" ".join(words_of(x)) for x, toxic, fold in texts if not toxic and fold in folds]
            own = {z: [s for x, toxic, fold in texts if toxic and fold in folds and (s := _typical_text(x, typical[p, z]))] for z in ZS}
            for size in SIZES:
                base = _trained(ordinary, size)
                out += [(p, z, size, _trained(own[z], min(BYTES, max(512, sum(map(len, own[z])) // 4))) + base, base) for z in ZS]
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["part", "z", "size", "toxic", "ordinary"])
        del texts, ordinary, own
        release()

    made = rows.coalesce(1).mapInArrow(run, "part int, z double, size int, toxic binary, ordinary binary").collect()
    return {(r["part"], r["z"], r["size"]): (bytes(r["toxic"]), bytes(r["ordinary"])) for r in made}


def _calibrated(y: np.ndarray, x: np.ndarray, share: float = FALSE_ALARMS) -> tuple[float, float]:
    """(share of toxic documents caught, threshold) at the lowest positive distance that at most ``share`` of the ordinary documents reach."""
    ordinary, toxic = np.sort(x[y == 0])[::-1], x[y == 1]
    if not len(ordinary) or not len(toxic):
        return 0.0, math.inf
    cut = max(0.0, ordinary[int(share * len(ordinary))])
    above = x[x > cut]
    return float((toxic > cut).mean()), float((cut + above.min()) / 2) if len(above) else math.inf


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Dictionaries of a bounded sample and a calibrated threshold: dictionaries are trained without one fold, and the threshold is set on that fold.

    Of the candidates (fold left out, z, ordinary size, gain), the one that catches most toxic documents of its fold at FALSE_ALARMS is taken. Without
    documents of one class all texts get the score of the other one.
    """
    rows = materialize(sample(docs, labels, size), "labelled")
    n = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    n0, n1 = (sum(v for (c, _), v in n.items() if c == k) for k in (0, 1))
    if not n0 or not n1:
        return Model(b"", b"", constant=0.0 if not n1 else 1.0)
    made = dictionaries(rows, n)
    keys = [(z, s) for z in ZS for s in SIZES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                found = [_gains_of(*made[fold, z, s])(text) for z, s in keys]
                out.append([distance(g, gain) for g in found for gain in GAINS])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.float64()))], names=["toxic", "fold", "x"])
        _gains.clear()
        release()

    described = rows.mapInArrow(run, "toxic int, fold int, x array<double>").collect()  # at most 2 * size rows
    y, fold, x = (np.array([r[c] for r in described]) for c in ("toxic", "fold", "x"))
    best = None
    for part in range(_FOLDS):
        for i in range(x.shape[1]):
            caught, threshold = _calibrated(y[fold == part], x[fold == part, i])
            if best is None or caught > best[0]:
                best = caught, threshold, (part, *keys[i // len(GAINS)]), GAINS[i % len(GAINS)]
    return Model(*made[best[2]], best[3], best[1])


def predict(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with tox_score: distance / (distance + threshold), so 0.5 at the calibrated threshold and 0 for a text none of whose windows counts.

    The whole text is compressed, window by window. Null and empty texts have distance 0. Repeated rows stay; a column named tox_score is replaced; an empty
    table gives no row.
    """

    def make(text: pa.Array) -> dict[str, list]:
        if model.constant is not None:
            return {"tox_score": [model.constant] * len(text)}
        gains, out = _gains_of(model.toxic, model.ordinary), []
        for x in text.to_pylist():
            d = distance(gains(x), model.gain)
            out.append(d / (d + model.threshold) if d else 0.0)
        return {"tox_score": out}

    return with_columns_in_arrow(docs, ["text"], [T.StructField("tox_score", T.DoubleType())], make, drop)


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id) modulo 5 is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document, scored by a model of labelled documents with crc32(doc_id) modulo 5 other than 0."""
    model = fit(docs, labels.where(~held_out()))
    scored = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, ("text",))
    return scored.select("doc_id", "held_out", F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those scored toxic; columns as in docs."""
    model = fit(docs, labels.where(~held_out()))
    return predict(docs, model).where("tox_score < 0.5").select(*[F.col(quoted(c)) for c in docs.columns])
