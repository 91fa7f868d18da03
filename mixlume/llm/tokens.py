"""Exact whole-text encoding with a tokenizer of the tokenizers library, fast through a cache of the spans that words consist of."""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from mixlume.llm.common import SpanHasher, in_slices

_SPACE, _LETTER, _OTHER, _WHOLE = 0, 1, 2, 3
#: Class of each ASCII byte. An apostrophe may start a contraction and < a special token, so their words stay whole; so do words of other than Latin-1 letters.
_CLASS = np.array([_SPACE if b == 32 or 9 <= b <= 13 else _LETTER if chr(b).isalpha() and b < 128 else _OTHER if 33 <= b <= 126 and b not in b"'<" else _WHOLE for b in range(256)], np.uint8)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Second bytes after 0xC3 of the Latin-1 letters.
_LATIN = np.array([128 <= b <= 191 and b not in (0x97, 0xB7) for b in range(256)])


class WordEncoder:
    """For tokenizers whose pre-tokens never hold white space, part letters from other characters, and drop case (word_bpe_49k.json).

    A text's ids are those of its spans in order: runs of Latin letters, runs of other ASCII characters, and whole words where neither rule is safe.
    Ids are little-endian unsigned 32-bit integers as bytes. The cache is emptied at ``most`` spans.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[bytes, bytes] = {}
        self.hashers = SpanHasher(0), SpanHasher(1)

    def _learn(self, letters: list[bytes], others: list[bytes]) -> None:
        for at in range(0, len(letters), 20_000):  # a run of letters is one pre-token, so word numbers part the ids of many runs in one call
            runs = letters[at : at + 20_000]
            code = self.tokenizer.encode(b" ".join(runs).decode(), add_special_tokens=False)
            ids = np.array(code.ids, "<u4").tobytes()
            cuts = [0, *(4 * (np.flatnonzero(np.diff(np.array([*code.word_ids, -1], np.int64))) + 1)).tolist()]
            if len(cuts) - 1 == len(runs):
                self.known.update(zip(runs, [ids[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:  # a run without ids: each on its own
                others = [*runs, *others]
        for span, code in zip(others, self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in others], add_special_tokens=False)):
            self.known[span] = np.array(code.ids, "<u4").tobytes()

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text; null is empty."""
        out: list[bytes] = []
        for a, b in in_slices(texts):
            out += self._slice([x or b"" for x in texts[a:b]])
        return out

    @staticmethod
    def spans(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(data with ASCII letters in lower case, but for whole words; starts, ends and classes of its spans)."""
        raw = np.frombuffer(data, np.uint8)
        kind = _CLASS[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[_LATIN[raw[lead + 1]]]
        kind[lead] = kind[lead + 1] = _LETTER
        whole = np.flatnonzero(kind == _WHOLE)
        low = data.translate(_LOWER)
        if len(whole):
            edge = np.diff((kind != _SPACE).view(np.int8), prepend=np.int8(0), append=np.int8(0))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            words = np.unique(np.searchsorted(starts, whole, "right") - 1)
            starts, n = starts[words], (ends - starts)[words]
            at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
            kind[at] = _WHOLE
            mixed = np.frombuffer(low, np.uint8).copy()
            mixed[at] = raw[at]
            low = mixed.tobytes()
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(data)]])
        kinds = kind[starts]
        keep = kinds != _SPACE
        return low, starts[keep], ends[keep], kinds[keep]

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        """Equal spans are found by two 64-bit hashes, so that Python looks up each distinct span of the slice once."""
        data = b" ".join(texts)
        low, starts, ends, kinds = self.spans(data) if data else (b"", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        if not len(starts):
            return [b""] * len(texts)
        first, second = (h(low, starts, ends) for h in self.hashers)
        _, at, number = np.unique(first, return_index=True, return_inverse=True)
        if not (second[at][number] == second).all():  # two spans of one hash
            at = number = np.arange(len(starts))
        spans, kinds = [low[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())], kinds[at].tolist()
        known = self.known
        new = {x: k for x, k in zip(spans, kinds) if x not in known}
        if len(known) + len(new) > self.most:
            known.clear()
            new = dict(zip(spans, kinds))
        if new:
            self._learn([x for x, k in new.items() if k == _LETTER], [x for x, k in new.items() if k != _LETTER])
        codes = [known[x] for x in spans]
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        flat = np.frombuffer(b"".join(codes), "<u4")
        n = sizes[number]
        ahead = np.cumsum(n) - n
        flat = flat[np.repeat((np.cumsum(sizes) - sizes)[number] - ahead, n) + np.arange(n.sum())].tobytes()
        cuts = np.cumsum([0] + [len(x) + 1 for x in texts])
        cuts = 4 * np.append(ahead, n.sum())[np.searchsorted(starts, cuts)]
        return [flat[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
