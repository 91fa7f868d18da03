"""Quality signals computed from text."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of fewer words have no ratio signals.
LEAST_WORDS = 20

COUNTS = ["rps_doc_word_count", "rps_doc_num_sentences"]
RATIOS = [
    "rps_doc_unigram_entropy", "rps_doc_frac_unique_words", "rps_doc_frac_no_alph_words", "rps_doc_frac_chars_top_2gram", "rps_doc_frac_chars_top_3gram",
    "rps_doc_mean_word_length", "rps_lines_uppercase_letter_fraction", "rps_lines_ending_with_terminal_punctution_mark", "rps_lines_numerical_chars_fraction",
]


_BLANKS = re.compile("[ \\t\\n\\x0b\\f\\r]+")
_LETTER = re.compile("[A-Za-z]")
_RAW = ["words", "distinct", "wordless", "chars", "length", "upper", "digits", "ends", "lines", "ended", "top2", "top3"]
_SIGNALS = T.StructType([T.StructField("entropy", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in _RAW]])


def raw_counts(text: str) -> tuple:
    """(entropy of the words, counts as in _RAW): top2 and top3 are the characters that the copies of the widest repeated pair and triple of words cover."""
    words = [w for w in _BLANKS.split(text) if w]
    n, one = len(words), Counter(words)
    entropy = -sum(c / n * math.log(c / n) for c in one.values()) if n else None
    tops = [max((c * sum(map(len, g)) for g, c in Counter(zip(*[words[i:] for i in range(k)])).items() if c > 1), default=0) if n >= k else None for k in (2, 3)]
    data = text.encode("utf-8", "replace")
    among = lambda letters: len(data) - len(data.translate(None, letters))
    lines = [x for x in text.split("\n") if x.strip(" ")]
    return (
        entropy, n, len(one), sum(c for w, c in one.items() if not _LETTER.search(w)), sum(len(w) * c for w, c in one.items()), len(text), among(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), among(b"0123456789"), among(b".!?"),
        len(lines), sum(x.endswith((".", "!", "?")) for x in lines), *tops,
    )


def _counted(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([raw_counts(t) for t in texts], columns=_SIGNALS.names).astype({c: "Int64" for c in _RAW})


def text_signals(docs: DataFrame, key: str = "doc_id", text: str = "text", others: list[str] | None = None) -> DataFrame:
    """key, the eleven text signals and ``others``. Words are split at white space; ratios are NULL below LEAST_WORDS words.

    Words, n-grams and characters are counted within the row, in Arrow batches: nothing is shuffled or joined. (As array functions the same counts take several times as long.)
    """
    others = others or []
    base = docs.select(F.col(key), *others, F.pandas_udf(_counted, _SIGNALS)(F.coalesce(F.col(text), F.lit(""))).alias("c"))
    c = lambda name: F.col(f"c.{name}")
    ratio = lambda x: F.when(c("words") >= LEAST_WORDS, x)
    return base.select(
        key,
        *others,
        c("words").cast("double").alias("rps_doc_word_count"),
        c("ends").cast("double").alias("rps_doc_num_sentences"),
        ratio(F.round(c("entropy"), 9)).alias("rps_doc_unigram_entropy"),
        ratio(c("distinct") / c("words")).alias("rps_doc_frac_unique_words"),
        ratio(c("wordless") / c("words")).alias("rps_doc_frac_no_alph_words"),
        ratio(c("top2") / c("chars")).alias("rps_doc_frac_chars_top_2gram"),
        ratio(c("top3") / c("chars")).alias("rps_doc_frac_chars_top_3gram"),
        ratio(c("chars") / c("words")).alias("rps_doc_mean_word_length"),
        ratio(c("upper") / c("length")).alias("rps_lines_uppercase_letter_fraction"),
        ratio(c("ended") / c("lines")).alias("rps_lines_ending_with_terminal_punctution_mark"),
        ratio(c("digits") / c("length")).alias("rps_lines_numerical_chars_fraction"),
    )
