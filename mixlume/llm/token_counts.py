"""Token counts under edits: a segment tree of pre-token counts for each document; an edit re-encodes only the leaves that it touches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlume.llm.common import in_slices, with_columns_in_arrow
from mixlume.llm.tokens import WordEncoder, encoder

#: Words of a leaf; a leaf with four times as many is split.
LEAF = 32
_SPACE = frozenset(" \t\n\v\f\r")
ADDED = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_tokens_edited", T.LongType()),
    T.StructField("n_edits", T.LongType()),
    T.StructField("n_chars_edited", T.LongType()),
    T.StructField("chars_encoded", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
]


def _leaves(text: str, size: int) -> list[str]:
    """Pieces of about ``size`` words. Each but the last ends in white space, so no pre-token lies in two of them."""
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    cuts = [0, *starts[size - 1 :: size].tolist(), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


class TokenTree:
    """Sums of characters and tokens over a document's leaves, as implicit binary trees (node k has children 2k and 2k + 1)."""

    def __init__(self, text: str, encode: WordEncoder, leaves: list[str] | None = None, counts: list[int] | None = None) -> None:
        self.encode, self.encoded, self.dirty = encode, len(text), set()
        leaves = _leaves(text, LEAF) if leaves is None else leaves
        self._build(leaves, count(leaves, encode) if counts is None else counts)

    def _build(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves = leaves or [""]
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(self.leaves)] = [len(x) for x in self.leaves]
        self.tokens[self.size : self.size + len(counts)] = counts
        for sums in (self.chars, self.tokens):
            k = self.size
            while k > 1:
                sums[k // 2 : k] = sums[k : 2 * k].reshape(-1, 2).sum(axis=1)
                k //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end of the text), and the characters before the leaf."""
        k, before = 1, 0
        at = min(at, max(0, int(self.chars[1]) - 1))
        while k < self.size:
            k *= 2
            if at - before >= self.chars[k]:
                before += int(self.chars[k])
                k += 1
        return k - self.size, before

    def _add(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.size + leaf
        while k:
            self.chars[k] += chars
            self.tokens[k] += tokens
            k //= 2

    def _set(self, leaf: int, text: str) -> None:
        """A leaf's new text; its tokens count 0 until settle()."""
        chars, tokens = len(text) - len(self.leaves[leaf]), int(self.tokens[self.size + leaf])
        self.leaves[leaf] = text
        self._add(leaf, chars, -tokens)
        self.dirty.add(leaf)

    def change(self, start: int, length: int, replacement: str) -> None:
        """Replaces characters (clipped to the text); the touched leaves, and those whose boundary the edit has opened, wait for their counts."""
        start = max(0, min(start, int(self.chars[1])))
        end = min(start + max(0, length), int(self.chars[1]))
        first, before = self._find(start)
        last = max(first, self._find(max(start, end - 1))[0])
        region = "".join(self.leaves[first : last + 1])
        region = region[: start - before] + replacement + region[end - before :]
        while last + 1 < len(self.leaves) and not (region and region[-1] in _SPACE):  # the last word may go on in the next leaf
            last += 1
            region += self.leaves[last]
        parts = _leaves(region, LEAF)
        if len(parts) > 4 * (last - first + 1):
            counts, more = self.tokens[self.size : self.size + len(self.leaves)].tolist(), len(parts) - (last - first + 1)
            self.dirty = {k if k < first else k + more for k in self.dirty if not first <= k <= last} | set(range(first, first + len(parts)))
            self._build(self.leaves[:first] + parts + self.leaves[last + 1 :], counts[:first] + [0] * len(parts) + counts[last + 1 :])
            return
        self._set(first, region)
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "")

    def waiting(self) -> list[str]:
        """Texts of the leaves that wait for their counts."""
        return [self.leaves[k] for k in sorted(self.dirty)]

    def settle(self, counts: list[int]) -> None:
        """Takes the counts of waiting() and updates the sums above those leaves."""
        for leaf, n in zip(sorted(self.dirty), counts):
            self.encoded += len(self.leaves[leaf])
            self._add(leaf, 0, n)
        self.dirty = set()

    def edit(self, start: int, length: int, replacement: str) -> int:
        """One change, settled at once; the new total."""
        self.change(start, length, replacement)
        self.settle(count(self.waiting(), self.encode))
        return self.total


def count(leaves: list[str], encode: WordEncoder) -> list[int]:
    return [len(x) // 4 for x in encode.ids([s.encode("utf-8", "replace") for s in leaves])]


def _parted(flat: list[int], sizes: list[int]) -> list[list[int]]:
    ends = np.cumsum(sizes).tolist()
    return [flat[e - n : e] for e, n in zip(ends, sizes)]


def with_counts(df: DataFrame, tokenizer: str, edits: str = "edits", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with counts of its whole text before and after its edits, applied in order.

    df has text and an array of struct(start, length, replacement) in code points; positions are clipped to the text as it then is. Adds n_tokens,
    n_tokens_edited, n_edits, n_chars_edited, chars_encoded (characters encoded: those of the text once, and of the leaves that edits touch) and edited_sha256.
    Null text is empty; null edits, or null fields, are no edits, 0 and the empty string; columns of the added names are replaced; an empty table gives no row.
    """

    def make(texts: pa.Array, lists: pa.Array) -> dict[str, list]:
        encode, rows, whole, todo = encoder(tokenizer), [], texts.to_pylist(), lists.to_pylist()
        for a, b in in_slices(whole):  # leaves of many texts are encoded in one call, and so are the leaves that all their edits touch
            part = [(x or b"").decode("utf-8", "replace") for x in whole[a:b]]
            leaves = [_leaves(x, LEAF) for x in part]
            counts = _parted(count([x for own in leaves for x in own], encode), [len(x) for x in leaves])
            trees = [TokenTree(x, encode, own, n) for x, own, n in zip(part, leaves, counts)]
            before = [t.total for t in trees]
            edits = [[e for e in own or [] if e] for own in todo[a:b]]
            for tree, own in zip(trees, edits):
                for e in own:
                    tree.change(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
            waiting = [t.waiting() for t in trees]
            for tree, n in zip(trees, _parted(count([x for own in waiting for x in own], encode), [len(x) for x in waiting])):
                tree.settle(n)
            for tree, first, own in zip(trees, before, edits):
                now = tree.text()
                rows.append((first, tree.total, len(own), len(now), tree.encoded, hashlib.sha256(now.encode("utf-8", "replace")).hexdigest()))
        return dict(zip([f.name for f in ADDED], map(list, zip(*rows))))

    return with_columns_in_arrow(df, ["text", edits], ADDED, make, drop)


def count_edits(docs: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and counts for docs under a table of edits (doc_id, seq, start, length, replacement), applied by seq. Edits of unknown documents do nothing."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "start", "length", "replacement")))
    lists = edits.groupBy("doc_id").agg(F.transform(ordered, lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["replacement"].alias("replacement"))).alias("edits"))
    return with_counts(docs.select("doc_id", "text").join(lists, "doc_id", "left"), tokenizer, drop=("text", "edits"))


def sample_edits(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with four edits of each text: a word run replaced in the middle, an insertion inside a word, a deletion near the end, an append."""
    n = "char_length(coalesce(text, ''))"
    edit = "named_struct('start', cast({0} as bigint), 'length', cast({1} as bigint), 'replacement', {2})"
    edits = [(f"{n} div 2", "40", "substring(coalesce(text, ''), 1, 60)"), (f"{n} div 3", "0", "concat('x', cast(doc_id as string))"), (f"{n} - {n} div 10", "25", "''"), (f"{n} + 100", "0", "concat(' ', coalesce(source, ''), ' end')")]
    return docs.select("doc_id", "text", F.expr(f"array({', '.join(edit.format(*e) for e in edits)})").alias("edits"))


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each document with its counts under sample_edits()."""
    return with_counts(sample_edits(docs), tokenizer, drop=("text", "edits"))
