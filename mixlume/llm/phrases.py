"""Phrase collocations from a weighted de Bruijn graph: nodes are word pairs, edges are word triples; unary paths are compacted and all shorter counts come from flows and piece ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mixlume.llm.common import _parts, materialize, release

#: Occurrences that make a phrase a candidate, and a language's phrases that are reported.
LEAST, TOP = 10, 2000
#: Pairs that are at least 1 / HOT of the pairs of a sampled batch may be hot: the edges of at most MOST_HOT of them are dealt by their last word, too. This changes no result.
HOT, MOST_HOT, SAMPLED = 4000, 10_000, 64
#: A path is also cut at one node in CUT, by hash, so that neither rounds nor rows follow the longest passage.
CUT = 32
END = ""
#: A-Z to lower case, blanks to a space, ends of pieces to a line feed.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))


def _chunks(texts: list[bytes | None], most: int = 4 << 20) -> Iterator[bytes]:
    """The texts, translated, in chunks that end where pieces do."""
    data = b"\n".join(x for x in texts if x).translate(LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b"\n", at + most) + 1 or len(data)
        yield data[at:end]
        at = end


def _graph(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk, and its distinct edges as three word numbers (that after the last word is the end of a piece) with their counts. One edge begins at each word."""
    letters = np.frombuffer(data, np.uint8)
    begins = (letters != 32) & (letters != 10)
    begins[1:] &= ~begins[:-1]
    piece = np.cumsum(letters == 10, dtype=np.int32)[begins]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in data.split()), np.int64, len(piece))
    base = len(numbers) + 1
    second, third = np.full(len(ids), base - 1), np.full(len(ids), base - 1)
    second[:-1] = np.where(piece[1:] == piece[:-1], ids[1:], base - 1)
    third[:-2] = np.where(piece[2:] == piece[:-2], ids[2:], base - 1)
    pairs, pair = np.unique(ids * base + second, return_inverse=True)
    edges, counts = np.unique(pair * base + third, return_counts=True)
    pair = pairs[edges // base]
    return [*numbers, b""], pair // base, pair % base, edges % base, counts


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, chunk) of a batch (lang, text)."""
    for part in _parts(batch, 1):
        langs, texts = part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()
        for lang in dict.fromkeys(langs):
            for chunk in _chunks([t for g, t in zip(langs, texts) if g == lang]):
                yield lang, chunk


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n): pairs that make up at least 1 / HOT of a chunk."""
    for batch in batches:
        for _, chunk in _by_lang(batch):
            words, first, second, _, counts = _graph(chunk)
            if len(counts):
                pairs, at = np.unique(first * len(words) + second, return_inverse=True)
                n = np.bincount(at, counts)
                often = n * HOT >= n.sum()
                nodes = [(words[p // len(words)] + b" " + words[p % len(words)]).decode() for p in pairs[often].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(n[often].astype(np.int64))], names=["node", "n"])


def _edges(batches: Iterator[pa.RecordBatch], hot: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """(edge, n): the distinct edges of each chunk as "word word<tab>language<tab>word", with twice their counts, and one more if the pair is hot."""
    for batch in batches:
        for lang, chunk in _by_lang(batch):
            words, first, second, third, counts = _graph(chunk)
            numbers = {w: i for i, w in enumerate(words)}
            known = [numbers[a] * len(words) + numbers[b] for a, b in hot if a in numbers and b in numbers]
            marked = 2 * counts + np.isin(first * len(words) + second, known)
            texts = pa.array(words, pa.binary()).cast(pa.string())
            node = pc.binary_join_element_wise(texts.take(pa.array(first)), texts.take(pa.array(second)), " ")
            edge = pc.binary_join_element_wise(node, pa.scalar(lang), texts.take(pa.array(third)), "\t")
            for at in range(0, len(edge), 65536):
                yield pa.RecordBatch.from_arrays([edge.slice(at, 65536), pa.array(marked[at : at + 65536])], names=["edge", "n"])
        release()


def _runs(keys: pa.Array) -> np.ndarray:
    """Where runs of equal keys begin."""
    changed = np.ones(len(keys), bool)
    changed[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def _split(keys: pa.Array, at: str, reverse: bool = False) -> tuple[pa.Array, pa.Array]:
    parts = pc.split_pattern(keys, at, max_splits=1, reverse=reverse).flatten()
    return parts.take(pa.array(np.arange(0, len(parts), 2))), parts.take(pa.array(np.arange(1, len(parts), 2)))


def _flow(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (size, lang, w1, w2, w3, n) from edges in order: triples that reach ``least`` (each is whole in one task), pairs with the sum of their out-edges and ends (whole, or parts of a hot one), words with theirs."""
    held: list[pa.RecordBatch] = []
    pending: tuple[str, int, bool] | None = None  # the last pair, which may go on in the next rows

    def rows(size: int, lang: pa.Array, w1: pa.Array, w2: pa.Array | None, w3: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(n), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), size, np.int32)), lang, w1, none if w2 is None else w2, none if w3 is None else w3, pa.array(n.astype(np.int64))], names=["size", "lang", "w1", "w2", "w3", "n"])

    def summed(key: pa.Array, n: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs that have ended."""
        w1, rest = _split(key, " ")
        w2, lang = _split(rest, "\t")
        kept = pa.array(((n >= least) | hot) & pc.not_equal(w2, END).to_numpy(zero_copy_only=False))
        yield rows(2, lang.filter(kept), w1.filter(kept), w2.filter(kept), None, n[np.array(kept)])
        by_word = pa.table({"lang": lang, "w1": w1, "n": pa.array(n)}).group_by(["lang", "w1"]).aggregate([("n", "sum")]).combine_chunks()
        yield rows(1, by_word.column("lang").combine_chunks(), by_word.column("w1").combine_chunks(), None, None, np.array(by_word.column("n_sum")))

    def reduced(table: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal pending, held
        edge, marked = table.column(0).combine_chunks(), np.array(table.column(1))
        at = _runs(edge)
        n, hot, edge = np.add.reduceat(marked // 2, at), marked[at] % 2 == 1, edge.take(pa.array(at))
        if not final:  # the last edge may go on
            held = [pa.RecordBatch.from_arrays([edge.slice(len(edge) - 1), pa.array(2 * n[-1:] + hot[-1:])], names=["edge", "n"])]
            edge, n, hot = edge.slice(0, len(edge) - 1), n[:-1], hot[:-1]
        if len(edge):
            key, w3 = _split(edge, "\t", reverse=True)
            often = pa.array((n >= least) & pc.not_equal(w3, END).to_numpy(zero_copy_only=False))
            w1, rest = _split(key.filter(often), " ")
            w2, lang = _split(rest, "\t")
            yield rows(3, lang, w1, w2, w3.filter(often), n[np.array(often)])
            at = _runs(key)
            key, n, hot = key.take(pa.array(at)), np.add.reduceat(n, at), hot[at]
            if pending is not None:
                if key[0].as_py() == pending[0]:
                    n[0] += pending[1]
                else:
                    key, n, hot = pa.concat_arrays([pa.array([pending[0]], pa.string()), key]), np.concatenate([[pending[1]], n]), np.concatenate([[pending[2]], hot])
            pending = (key[len(key) - 1].as_py(), int(n[-1]), bool(hot[-1]))
            yield from summed(key.slice(0, len(key) - 1), n[:-1], hot[:-1])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 200_000:
            table, size = pa.Table.from_batches(held), 0
            yield from reduced(table, False)
            release()
    if held and sum(b.num_rows for b in held):
        yield from reduced(pa.Table.from_batches(held), True)
    if pending is not None:
        yield from summed(pa.array([pending[0]], pa.string()), np.array([pending[1]]), np.array([pending[2]]))


def _flows(docs: DataFrame, least: int) -> DataFrame:
    """(size, lang, w1, w2, w3, n) of all documents; written."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sampled = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).mapInArrow(_frequent, "node string, n long")
    hot = [tuple(r["node"].encode().split(b" ", 1)) for r in sampled.groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(MOST_HOT).collect()]
    edges = texts.mapInArrow(lambda batches: _edges(batches, hot), "edge string, n long")
    # An edge goes where its pair does, that of a hot pair where its three words say; the number isn't shuffled with it.
    dealt = edges.repartition(F.when(F.col("n") % 2 == 1, F.xxhash64("edge")).otherwise(F.xxhash64(F.substring_index("edge", "\t", 1)))).sortWithinPartitions("edge")
    return materialize(dealt.mapInArrow(lambda batches: _flow(batches, least), "size int, lang string, w1 string, w2 string, w3 string, n long"), "flows")


def _paths(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The compacted graph: nodes that paths don't swallow (lang, w1, w2, n), and paths (lang, words, n) of one or more edges of equal count.

    A node is swallowed where all that flows in comes by one edge and all leaves by one, so that its count is theirs; one in CUT is kept all the same. Each edge looks for the first edge of
    its path in rounds that double the distance; a cycle of such nodes can't be, since each piece that runs in it begins or ends there.
    """
    into = edges.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.count("*").alias("n_in"), F.max("n").alias("flow_in"), F.max("w1").alias("before"))
    out = edges.groupBy("lang", "w1", "w2").agg(F.count("*").alias("n_out"), F.max("n").alias("flow_out"))
    unary = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.col("flow_in") == F.col("n")) & (F.col("flow_out") == F.col("n")) & (F.pmod(F.xxhash64("lang", "w1", "w2"), F.lit(CUT)) != 0)
    node = materialize(nodes.join(into, ["lang", "w1", "w2"], "left").join(out, ["lang", "w1", "w2"], "left").withColumn("inner", F.coalesce(unary, F.lit(False))).select("lang", "w1", "w2", "n", "inner", "before"), "graph")

    inner = node.where("inner").select("lang", "w1", "w2", "before")
    key, before = F.struct("lang", "w1", "w2", "w3"), F.struct("lang", F.col("before").alias("w1"), F.col("w1").alias("w2"), F.col("w2").alias("w3"))
    jumps = materialize(edges.join(inner, ["lang", "w1", "w2"]).select(key.alias("edge"), before.alias("at"), F.lit(1).cast("long").alias("hops")), "jumps")
    while True:
        far = jumps.select(F.col("edge").alias("at"), F.col("at").alias("then"), F.col("hops").alias("more"))
        met = materialize(jumps.join(far, "at", "left").select("edge", F.coalesce("then", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("then").isNotNull().alias("moved")), "jumps")
        jumps = met.select("edge", "at", "hops")
        if not met.where("moved").take(1):
            break
    placed = edges.select(key.alias("edge"), "w3", "n").join(jumps, "edge", "left")
    path = placed.groupBy(F.coalesce("at", "edge").alias("first")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("hops", F.lit(0)).alias("hops"), "w3"))).alias("ends"), F.max("n").alias("n"))
    paths = path.select("first.lang", F.concat(F.array("first.w1", "first.w2"), F.col("ends.w3")).alias("words"), "n")
    return node.where("not inner").select("lang", "w1", "w2", "n"), materialize(paths, "paths")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact in 38 digits."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two or three words of each language, as op13 defines them.

    A null lang is ``und``; null and empty texts have no words; repeated rows count each time; an empty table, or one without candidates, gives no row; equal scores are ranked by a, then phrase;
    columns other than lang and text aren't read. A text is read whole; pieces are split between chunks of some megabytes, and one piece is always in memory as a whole.

    Each word begins one edge of the graph: the word, the next two, or the end of the piece. So a pair's count is the flow out of its node, ends included, and a word's is the flow of the nodes
    that it begins. Edges are counted within a chunk, then dealt by their pair (hot pairs: by all three words) and added up in order.
    """
    flows = _flows(docs, least)
    words = materialize(flows.where("size = 1").groupBy("lang", F.col("w1").alias("w")).agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least)
    nodes = flows.where("size = 2").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    junctions, paths = _paths(nodes, flows.where("size = 3").select("lang", "w1", "w2", "w3", "n"))

    def along(width: int, inner: bool) -> DataFrame:
        """The runs of ``width`` words on paths; inner: without those at both ends."""
        first, last = (2, F.size("words") - width) if inner else (1, F.size("words") - width + 1)
        at = paths.where(last >= first).select("lang", "words", "n", F.explode(F.sequence(F.lit(first), last)).alias("i"))
        return at.select("lang", *[F.element_at("words", F.col("i") + k).alias(f"w{k + 1}") for k in range(width)], "n")

    triples = along(3, False)
    pairs = materialize(junctions.unionByName(along(2, True)), "pairs")
    single = {k: often.select("lang", F.col("w").alias(f"w{k}"), F.col("f").alias(f"f{k}")) for k in (1, 2, 3)}
    begin = triples.groupBy("lang", "w1", "w2").agg(F.max("n").alias("longer"))
    end = triples.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("n").alias("longer"))
    longer = begin.unionByName(end).groupBy("lang", "w1", "w2").agg(F.max("longer").alias("longer"))
    two = pairs.join(longer, ["lang", "w1", "w2"], "left").where("longer is null or 100 * longer < 50 * n")
    two = two.join(single[1], ["lang", "w1"]).join(single[2], ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("n"), F.col("f1"), F.col("f2")).alias("score"))
    three = triples.join(pairs.withColumnRenamed("n", "f12"), ["lang", "w1", "w2"]).join(pairs.toDF("lang", "w2", "w3", "f23"), ["lang", "w2", "w3"])
    three = three.join(single[1], ["lang", "w1"]).join(single[3], ["lang", "w3"])
    three = three.withColumns({"s1": _score(F.col("n"), F.col("f1"), F.col("f23")), "s2": _score(F.col("n"), F.col("f12"), F.col("f3"))})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    both = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = both.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("k") <= top)  # a large language is cut down in 64 parts first
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_SQL_PIECES = r"string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"
ORACLE_SQL = rf"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest({_SQL_PIECES}) AS piece FROM documents)),
g AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= {LEAST}),
cut AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cut.lang, cut.k, cut.phrase, a, ws, j, x.n AS l, y.n AS r, ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score FROM cut
JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:j], ' ') AND x.k = j JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[j + 1:cut.k], ' ') AND y.k = cut.k - j),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT low.* FROM low LEFT JOIN longer t ON t.lang = low.lang AND t.phrase = low.phrase AND low.k = 2 WHERE t.a IS NULL OR 100 * t.a < 50 * low.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score FROM kept JOIN total ON total.lang = kept.lang
QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
