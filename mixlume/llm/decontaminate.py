"""Benchmark decontamination: one Aho-Corasick automaton over the words of normalised benchmark items, each text scanned once, hits mapped to the original."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlume.llm.common import byte_table, materialize, mix, quoted, with_columns_in_arrow

WINDOW = 10
#: Bytes of benchmark text in one automaton, which is broadcast (about 60 bytes of memory for each byte in a worker); a larger benchmark is scanned in parts.
MOST_BYTES = 12 << 20
#: Values of a letter of the automaton: its root has at most as many children.
ALPHABET = 128
WORDS = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
STATE = [
    T.StructField("decon_words", T.LongType()),
    T.StructField("decon_ranges", T.ArrayType(T.IntegerType())),
    T.StructField("decon_items", T.ArrayType(T.StringType())),
    T.StructField("decon_spans", T.ArrayType(T.IntegerType())),
]


def normalised(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def items(benchmark: DataFrame) -> DataFrame:
    """item_id (string), words (normalised, joined by blanks): each distinct item that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join(normalised(x)) or None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["item_id", "words"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).mapInArrow(run, "item_id string, words binary").where("words is not null").distinct()


class Matcher:
    """Finds the windows of n words of the items in a text.

    The automaton reads word numbers, spelled in two or three letters of ALPHABET values each; letters of different places differ, so that only whole words
    match, and a word that no item has is one letter of its own. Its patterns are the items' blocks of a few words at a stride with which each window of n
    words holds a whole block, so there are fewer than two states for each word of the benchmark; an item of fewer than n words is a pattern of its own. Where
    a block is met, the windows around it are looked up by hash and compared word by word.
    """

    def __init__(self, rows: list[tuple[str | None, bytes]], n: int = WINDOW) -> None:
        self.n, self.block = n, max(1, n // 2 - 1)
        self.stride = n - self.block + 1
        self.names = [x for x, _ in rows]
        split = [words.split(b" ") for _, words in rows]
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for ws in split for w in ws), 1)}
        places = 2 if len(self.number) < ALPHABET**2 else 3
        self.spelled = ["\0", *("".join(chr(1 + ALPHABET * p + k // ALPHABET**p % (ALPHABET if p + 1 < places else 1 << 20)) for p in range(places)) for k in range(1, len(self.number) + 1))]
        long = [np.array([self.number[w] for w in ws], np.int64) if len(ws) >= n else None for ws in split]
        spell = lambda numbers: "".join([self.spelled[k] for k in numbers])
        blocks = {spell(x[at : at + self.block]) for x in long if x is not None for at in range(0, len(x) - self.block + 1, self.stride)}
        whole: dict[str, list[int]] = {}
        for item, ws in enumerate(split):
            if long[item] is None:
                whole.setdefault(spell(self.number[w] for w in ws), []).append(item)
        self.automaton = ahocorasick.Automaton()
        for x in blocks | whole.keys():
            self.automaton.add_word(x, (len(x) // places, x in blocks, whole.get(x)))
        if len(self.automaton):
            self.automaton.make_automaton()
        # All windows of the long items: sorted hashes, a place of each, and the items that hold it.
        self.flat = np.concatenate([np.zeros(0, np.int64), *[x for x in long if x is not None]])
        sizes = np.array([len(x) for x in long if x is not None], np.int64)
        counts, ends = sizes - n + 1, np.cumsum(sizes)
        starts = np.repeat(ends - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        owner = np.repeat(np.flatnonzero([x is not None for x in long]), counts)
        self.hashes, first, index = np.unique(self._hashes(self.flat, starts), return_index=True, return_inverse=True)
        self.place = starts[first]
        pairs = np.unique(np.stack([index, owner]), axis=1)
        self.owners, self.at = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.hashes) + 1))

    def _hashes(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for k in range(self.n):
            out = mix(out ^ words[starts + k].astype(np.uint64)) if len(starts) else out
        return out

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[str]]:
        """First and end of the word ranges that are hit, and the names of the items hit."""
        first, last, found = [], [], set()
        if not len(self.automaton) or not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), found
        get, spelled = self.number.get, self.spelled
        text = [get(w, 0) for w in words]
        letters = [spelled[k] for k in text]
        hits = list(self.automaton.iter("".join(letters)))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), found
        after = np.searchsorted(np.cumsum([len(x) for x in letters]), [e for e, _ in hits], "right") + 1  # words up to the end of each hit
        near = set()
        for end, (_, (size, block, whole)) in zip(after.tolist(), hits):
            if block:
                near.add(end - size)
            if whole:
                first.append(end - size)
                last.append(end)
                found.update(whole)
        if near and len(text) >= self.n:
            near = np.array(sorted(near))
            starts = np.unique((near[:, None] - np.arange(self.stride)).ravel())
            starts = starts[(starts >= 0) & (starts <= len(text) - self.n)]
            numbers = np.array(text, np.int64)
            hashes = self._hashes(numbers, starts)
            k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            span = np.arange(self.n)
            same = (self.hashes[k] == hashes) & (numbers[starts[:, None] + span] == self.flat[self.place[k][:, None] + span]).all(axis=1)
            first += starts[same].tolist()
            last += (starts[same] + self.n).tolist()
            for w in np.unique(k[same]):
                found.update(self.owners[self.at[w] : self.at[w + 1]].tolist())
        return np.array(first, np.int64), np.array(last, np.int64), {self.names[x] for x in found} - {None}


_matchers: dict[int, Matcher] = {}


def _matcher(shared: Broadcast) -> Matcher:
    key, rows, n = shared.value
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(rows, n)
    return _matchers[key]


def _merged(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sorted, disjoint [first, last) pairs as one flat array."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    at = np.flatnonzero(new)
    return np.stack([first[at], last[np.append(at[1:], len(first)) - 1]], 1).ravel()


def _scan(text: bytes | None, matcher: Matcher, ranges: list[int] | None, items: list[str] | None) -> tuple[int, list[int], list[str], list[int]]:
    """Words, merged word ranges that are hit, items, and the ranges as code point spans of the original text; ranges and items of earlier parts are kept."""
    words = normalised(text)
    first, last, found = matcher(words)
    first, last, found = np.append(first, (ranges or [])[::2]).astype(np.int64), np.append(last, (ranges or [])[1::2]).astype(np.int64), found | set(items or [])
    if not len(first):
        return len(words), [], sorted(found), []
    merged = _merged(first, last)
    letters = np.frombuffer(text.translate(WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], letters.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])
    spans = np.stack([points[starts[merged[::2]]], points[ends[merged[1::2] - 1]]], 1).ravel()
    return len(words), merged.tolist(), sorted(found), spans.tolist()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most_bytes: int = MOST_BYTES, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with what the benchmark's windows hit in each whole text.

    Adds decon_words (words), decon_ranges (flat, disjoint, sorted [first, end) word ranges that are hit), decon_items (sorted item ids as strings)
    and decon_spans (the ranges as [start, end) code points of the original text). One automaton holds the whole benchmark, and each text is scanned once; only
    a benchmark of more than most_bytes, whose automaton workers couldn't hold, is scanned in parts with a written table between them. Null text, or text
    without words: 0 words, empty lists. Null or empty items have no window; a null item_id hits, but isn't listed. Repeated rows stay; columns of the added
    names are replaced, others keep their names and values; empty tables give empty results.
    """
    known = items(benchmark)
    total = known.agg(F.sum(F.length("words"))).first()[0] or 0
    parts = max(1, math.ceil(total / most_bytes))
    out = docs
    for part in range(parts):
        mine = known.where(F.pmod(F.xxhash64("words", "item_id"), F.lit(parts)) == part) if parts > 1 else known
        rows = sorted(((r["item_id"], bytes(r["words"])) for r in mine.collect()), key=lambda r: (r[0] is not None, *r))
        shared = docs.sparkSession.sparkContext.broadcast((hash((part, n, tuple(rows))), rows, n))

        def make(text, *state, shared=shared):
            matcher = _matcher(shared)
            before = zip(*[x.to_pylist() for x in state]) if state else ((None, None),) * len(text)
            found = [_scan(x, matcher, *old) for x, old in zip(text.to_pylist(), before)]
            return dict(zip([f.name for f in STATE], map(list, zip(*found))))

        out = with_columns_in_arrow(out, ["text"] + (["decon_ranges", "decon_items"] if part else []), STATE, make, drop if part + 1 == parts else ())
        if part + 1 < parts:
            out = materialize(out, "scanned")
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: counts, a digest of the items and the hit spans."""
    found = scan(docs.select("doc_id", "text"), benchmark, drop=("text",))
    pairs = F.expr("transform(sequence(0, size(decon_ranges) div 2), i -> if(2 * i < size(decon_ranges), decon_ranges[2 * i + 1] - decon_ranges[2 * i], 0))")
    return found.select(
        "doc_id",
        F.col("decon_words").alias("n_words"),
        F.when(F.size("decon_ranges") > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size("decon_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "decon_items"), 256).alias("items_sha256"),
        (F.size("decon_ranges") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those of which a word lies in a benchmark window; columns as in docs."""
    return scan(docs, benchmark).where(F.size("decon_ranges") == 0).select(*[F.col(quoted(c)) for c in docs.columns])


def digest(items: list[str]) -> str:
    """What report() makes of a list of items (for tests)."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, unnest(CASE WHEN len(ws) >= {WINDOW} THEN list_transform(range(1, len(ws) - {WINDOW} + 2), lambda i: array_to_string(ws[i:i + {WINDOW - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g,
    least(len(ws), {WINDOW}) AS k FROM items),
docs AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
grams AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM win))),
hits AS (SELECT doc_id, i, grams.k AS k, item FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
n_hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN n_hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
