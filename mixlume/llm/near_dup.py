"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning of signatures, exact verification, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlume.llm import common
from mixlume.llm.common import SpanHasher, byte_table, in_slices, mix, quoted, release, unused, with_columns_in_arrow

SHINGLE = 5
#: Documents are linked at 100 * intersection >= percent * union; PERCENT is the default, op4's contract.
PERCENT = 85
#: A pair at the threshold of PERCENT misses all bands with probability (1 - 0.85 ** 5) ** 24 = 8e-7; other thresholds get as many bands as keep it below BAND_MISS.
BANDS, ROWS = 24, 5
BAND_MISS = 1e-6
#: Signature bytes compared between two looks at the posterior, and the chance at each look to prune a pair that is at the threshold.
BATCH, MISS = 24, 1e-8
#: Rows of one bucket that are compared with as many others in one task.
BLOCK = 512
#: Slots by which shingles are ordered from rare to frequent when a bucket of more than BLOCK rows is split: 65,536 counts, whatever the table's size.
SLOT_BITS = 16
#: About so many members of a group decide by majority from which set its members' differences are taken. Any set gives the same links.
VOTERS = 64
#: Blocks of a bucket that differences have split once; what is larger is split again, so a row is repeated for so many blocks at most.
WIDE = 8
#: Edges that one task contracts by itself before components are found in rounds.
TASK_EDGES = 200_000
#: Pairs of a block whose signatures are copied and compared at once: 3 MB at 80 %.
COMPARED = 1 << 13
#: Words hashed at once, so that memory doesn't follow the longest text.
CHUNK = 100_000
WORDS = byte_table(lambda b: b != 32 and not 9 <= b <= 13)


#: Rows of an Arrow batch while the search's tables are written: ten thousand texts at a time are buffers of 64 MB and more for each task, outside the heap and in Python.
ROWS_SENT = 1000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """common.materialize() with batches of ROWS_SENT rows; the session's setting is as before afterwards."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(int(before), ROWS_SENT) if int(before) > 0 else ROWS_SENT))
    try:
        return common.materialize(df, name)
    finally:
        conf.set(key, before)


@cache
def band_count(percent: int = PERCENT) -> int:
    """Bands of ROWS hashes that a pair at the threshold misses with probability below BAND_MISS: 24 at 85 %, 35 at 80 %."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    return 1 if percent == 100 else math.ceil(math.log(BAND_MISS) / math.log1p(-((percent / 100) ** ROWS)))


@cache
def _seeds(n: int) -> np.ndarray:
    """The seeds of the first n hashes; those of fewer hashes are the beginning of those of more."""
    width = BANDS * ROWS
    parts = [np.random.default_rng(20240229 + k).integers(0, 2**63, (2, width), dtype=np.int64).astype(np.uint64) for k in range(-(-n // width))]
    return np.concatenate(parts, axis=1)[:, :n]


@cache
def _hasher() -> SpanHasher:
    return SpanHasher()


def _hash_units(units: list[list[bytes]], sizes: list[int]) -> np.ndarray:
    """Hashes of all shingles of all units: a unit's words, at least one; sizes: words in each."""
    data = b" ".join([b" ".join(u) for u in units])
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    size = np.array(sizes)
    n = np.maximum(size - SHINGLE + 1, 1)
    first = np.repeat(np.cumsum(size) - size, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return _hasher()(data, starts[first], ends[first + np.repeat(np.minimum(size, SHINGLE), n) - 1])


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each whole text; about 1 MB of texts and CHUNK words are worked on at a time, however many texts a caller has."""
    return [found for start, end in in_slices(texts) for found in _sets(texts[start:end])]


def _sets(texts: list[bytes | None]) -> list[np.ndarray]:
    units, sizes, owner = [], [], []
    for i, text in enumerate(texts):
        words = (text or b"").translate(WORDS).split()
        for at in range(0, max(1, len(words) - SHINGLE + 1) if words else 0, CHUNK):
            units.append(words[at : at + CHUNK + SHINGLE - 1])
            sizes.append(len(units[-1]))
            owner.append(i)
    out = [np.zeros(0, np.uint64)] * len(texts)
    if units:
        run = np.cumsum(sizes) // CHUNK  # units of one run are hashed at once: fewer than CHUNK words besides a unit's own
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(units)]
        hashes = np.concatenate([_hash_units(units[a:b], sizes[a:b]) for a, b in zip(cuts, cuts[1:])])
        n = np.bincount(owner, np.maximum(np.array(sizes) - SHINGLE + 1, 1), len(texts)).astype(np.int64)
        ends = np.cumsum(n)
        for i in np.flatnonzero(n):
            out[i] = np.unique(hashes[ends[i] - n[i] : ends[i]])
    return out


ADDED = [T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]


def _signatures(texts: pa.Array, percent: int = PERCENT) -> dict[str, list]:
    n_bands = band_count(percent)
    seeds = _seeds(n_bands * ROWS)
    texts = texts.to_pylist()
    counts, classes, bands, sigs = [], [], [], []
    for a, b in in_slices(texts):
        sets = shingle_sets(texts[a:b])
        n = np.array([len(s) for s in sets])
        full = np.flatnonzero(n)
        counts += n.tolist()
        rows = [(None, [], None)] * (b - a)
        if len(full):
            u = np.concatenate([sets[i] for i in full])
            at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            low = np.empty((n_bands * ROWS, len(full)), np.uint64)
            for k in range(n_bands * ROWS):
                low[k] = np.minimum.reduceat((u ^ seeds[0, k]) * (seeds[1, k] | np.uint64(1)), at)
            key = np.zeros((len(full), n_bands), np.uint64) + np.arange(n_bands, dtype=np.uint64)
            for r in range(ROWS):
                key = mix(key ^ low[r::ROWS].T)
            sig = (mix(low) >> np.uint64(56)).astype(np.uint8).T
            for j, i in enumerate(full):
                rows[i] = (hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), key[j].view(np.int64), sig[j].tobytes())
        for c, k, s in rows:
            classes.append(c)
            bands.append(k)
            sigs.append(s)
    return {"n_shingles": counts, "cls": classes, "bands": bands, "sig": sigs}


@cache
def least_matches(miss: float = MISS, percent: int = PERCENT) -> tuple[int, ...]:
    """For each number of compared signature bytes that is a multiple of BATCH: matches below which P(similarity >= threshold | matches) < miss, uniform prior."""
    s = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, band_count(percent) * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:  # P(Beta(m + 1, n - m + 1) > s) = P(Binomial(n + 1, s) <= m)
            m += 1
            tail += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _survive(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which rows of two signature matrices aren't pruned, batch by batch."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(MISS, percent)):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, cols] == b[alive, cols]).sum(axis=1)
        kept = matches >= least
        alive, matches = alive[kept], matches[kept]
    return alive


def _matrix(column: pa.Array, percent: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), band_count(percent) * ROWS)


def _prune(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.take(pa.array(_survive(_matrix(batch.column(2), percent), _matrix(batch.column(3), percent), percent))).select(["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets reach the threshold; rows of the same a follow each other."""
    last, mine = None, None
    for batch in batches:
        texts_a, texts_b, kept = batch.column(2), batch.column(3).to_pylist(), []
        for start, end in in_slices(texts_b):
            for i, theirs in zip(range(start, end), shingle_sets(texts_b[start:end])):
                key = batch.column(0)[i].as_py()
                if key != last:
                    last, mine = key, shingle_sets([texts_a[i].as_py()])[0]
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(theirs) - both):
                    kept.append(i)
        yield batch.take(pa.array(kept, pa.int64())).select(["a", "b"])
        del texts_a, texts_b
        release()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from each node of one task's edges to the smallest node that these edges reach from it."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([parent[x] for x in nodes], pa.binary())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, label: for each node of the edges (a, b; binary) the smallest node that it reaches.

    Tasks of about TASK_EDGES edges first put each node straight below the smallest that their own edges reach. If several tasks did so, large-star and small-star rounds follow, each written,
    until all trees are stars: a round shuffles seven times, so few edges shouldn't go through any.
    """
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    own = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    now = materialize(own.coalesce(tasks).mapInArrow(_contracted, "u binary, v binary"), "edges")
    while tasks > 1 and not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge (u, v) at most that leads to a smaller one, and none leads on from there."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _spanning(group: pa.Table, percent: int) -> pa.Table:
    """Links between rows of different labels in one bucket (or of two blocks of it), as few as connect what they connect.

    Signatures of all pairs are compared batch by batch; the full sets of the rows of surviving pairs decide.
    """
    classes, labels, block = group.column("cls").to_pylist(), group.column("label").to_pylist(), np.array(group.column("block"))
    sigs = _matrix(group.column("sig").combine_chunks(), percent)
    numbers: dict[bytes, int] = {}
    own = np.array([numbers.setdefault(x, len(numbers)) for x in labels])
    i, j = np.nonzero((own[:, None] != own) & np.triu(np.ones((len(own), len(own)), bool), 1) & ((block[:, None] != block) | (len(np.unique(block)) == 1)))
    alive = [at + _survive(sigs[i[at : at + COMPARED]], sigs[j[at : at + COMPARED]], percent) for at in range(0, len(i), COMPARED)]
    alive = np.concatenate(alive) if alive else np.zeros(0, np.int64)
    i, j = i[alive], j[alive]
    rows = np.unique(np.concatenate([i, j]))
    sets = dict(zip(rows.tolist(), shingle_sets([group.column("text")[int(r)].as_py() for r in rows])))
    parent = list(range(len(classes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[bytes, int] = {}
    for k, label in enumerate(labels):
        parent[k] = first.setdefault(label, k)
    links = []
    for x, y in zip(i.tolist(), j.tolist()):
        if (p := root(x)) != (q := root(y)):
            n, m = len(sets[x]), len(sets[y])
            if 100 * min(n, m) >= percent * max(n, m):
                both = np.intersect1d(sets[x], sets[y], assume_unique=True).size
                if 100 * both >= percent * (n + m - both):
                    parent[max(p, q)] = min(p, q)
                    links.append((classes[x], classes[y]))
    del sets, sigs, group
    release()
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})


def _slots(rows: DataFrame) -> np.ndarray:
    """How many of the texts of rows (cls, text) hold a shingle of each slot; a shingle's slot is the top SLOT_BITS bits of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, end in in_slices(texts):
                for found in shingle_sets(texts[start:end]):
                    total[np.unique(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] += 1
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])
        release()

    found = rows.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** SLOT_BITS rows
    total = np.zeros(1 << SLOT_BITS, np.int64)
    total[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return total


def rare_prefix(found: np.ndarray, slots: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(n * percent / 100) + 1 of a set's n hashes, those of rare slots first. Sets at the threshold share one, since both drop fewer than what they share."""
    order = np.lexsort((found, slots[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))
    return found[order[: len(found) - -(-len(found) * percent // 100) + 1]]


def _prefixes(rows: DataFrame, slots: np.ndarray, percent: int) -> DataFrame:
    """cls, key: the rare prefix of each text of rows (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for start, end in in_slices(texts):
                parts = [rare_prefix(x, slots, percent).view(np.int64) for x in shingle_sets(texts[start:end])]
                owner = np.repeat(np.arange(start, end), [len(x) for x in parts])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), pa.array(np.concatenate(parts))], names=["cls", "key"])
            del texts
            release()

    return rows.select("cls", "text").mapInArrow(run, "cls binary, key bigint")


def excess(difference: int, size: int, percent: int) -> int:
    """e of a set that differs from its group's reference in ``difference`` hashes: sets x and y are linked if and only if 2 * (100 + percent) * (hashes that both differ in) >= e(x) + e(y)."""
    return (100 + percent) * difference - (100 - percent) * size


def difference_prefix(found: np.ndarray, e: int, least: int, slots: np.ndarray, percent: int) -> np.ndarray:
    """The first hashes, those of rare slots first, of a set's difference from its group's reference; least: the smallest e of the group, of its member m.

    If e + least <= 0, the set is linked with m whatever they share: it is near, others are far. By excess(), a far set and a set linked with it differ in
    (e + least) / (2 * (100 + percent)) common hashes at least, and a near set y and a far one in (e(y) - least + 1) / (2 * (100 + percent)). Both are positive, so
    prefixes that leave out one hash less share one. Two near sets are linked by way of m.
    """
    shared = -(-(e + least if e + least > 0 else e - least + 1) // (2 * (100 + percent)))
    order = np.lexsort((found, slots[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))
    return found[order[: max(0, len(found) - shared + 1)]]


def _majority(group: pa.Table) -> pa.Table:
    """head, ref: the sorted hashes that more than half of a group's voters hold."""
    sets = shingle_sets(group.column("text").to_pylist())
    found, n = np.unique(np.concatenate(sets), return_counts=True)
    out = pa.table({"head": group.column("head").slice(0, 1), "ref": pa.array([found[2 * n > len(sets)].tobytes()], pa.binary())})
    del sets, group
    release()
    return out


def _differences(rows: DataFrame, percent: int) -> DataFrame:
    """head, cls, e, d: excess and sorted hashes of the difference of each text of rows (head, cls, text, ref) from its group's reference, which may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, refs = batch.column(2).to_pylist(), batch.column(3)
            for start, end in in_slices(texts):
                sets = shingle_sets(texts[start:end])
                own = [np.setxor1d(x, np.frombuffer(refs[k].as_py() or b"", np.uint64), assume_unique=True) for k, x in zip(range(start, end), sets)]
                e = pa.array([excess(len(d), len(x), percent) for d, x in zip(own, sets)], pa.int64())
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), e, pa.array([d.tobytes() for d in own], pa.binary())], names=["head", "cls", "e", "d"])
            del texts
            release()

    return rows.select("head", "cls", "text", "ref").mapInArrow(run, "head binary, cls binary, e bigint, d binary")


def _difference_prefixes(rows: DataFrame, slots: np.ndarray, percent: int) -> DataFrame:
    """cls, key: the prefix of each difference of rows (head, cls, e, d, least); a key is of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, e, found, least = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
            parts = [difference_prefix(np.frombuffer(d, np.uint64), x, y, slots, percent) ^ np.frombuffer(h, np.uint64)[0] for h, x, d, y in zip(heads, e, found, least)]
            owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            keys = mix(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(owner, pa.int64())), pa.array(keys)], names=["cls", "key"])

    return rows.select("head", "cls", "e", "d", "least").mapInArrow(run, "cls binary, key bigint")


def _links(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of equal sets that connect all that is linked; written."""
    sigs = nodes.select("cls", "sig")

    def texts_of(classes: DataFrame) -> DataFrame:
        needed = classes.distinct().join(nodes.select("cls", "doc_id", "h"), "cls")
        texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(needed, ["doc_id", "h"])
        return materialize(texts.select("cls", F.col("text").cast("binary").alias("text")).dropDuplicates(["cls"]), "texts")

    def sized(keyed: DataFrame) -> DataFrame:
        """key, cls, n, head: members of the buckets of two or more."""
        buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("head")).where("n > 1"), "buckets")
        return materialize(keyed.join(buckets, "key"), "members")

    def to_heads(members: DataFrame) -> DataFrame:
        """Links of each bucket's members with its head."""
        pairs = members.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()
        signed = pairs.join(sigs.toDF("b", "sb"), "b").join(sigs.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")
        alive = materialize(signed.mapInArrow(lambda batches: _prune(batches, percent), "a binary, b binary"), "alive")
        texts = texts_of(alive.select(F.explode(F.array("a", "b")).alias("cls")))
        joined = alive.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
        return materialize(joined.mapInArrow(lambda batches: _verify(batches, percent), "a binary, b binary"), "links")

    def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of the buckets of three or more that aren't yet all of one label. A label's members are linked."""
        rest = members.where("n > 2").select("key", "cls", "n", "head").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        rest = materialize(rest, "rest")
        split = materialize(rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"), "split")
        return materialize(rest.join(split, "key", "left_semi"), "apart")

    def in_blocks(rest: DataFrame, texts: DataFrame) -> DataFrame:
        """Links between labels in each bucket of rest, block by block."""
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        rest = rest.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rest = rest.select("key", "cls", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        rest = rest.join(sigs, "cls").join(texts, "cls")
        return materialize(rest.groupBy("key", "i", "j").applyInArrow(lambda group: _spanning(group, percent), "a binary, b binary"), "links")

    def asked_once(rest: DataFrame) -> DataFrame:
        """Buckets of the same members ask the same: one of them stays."""
        same = rest.groupBy("key").agg(F.count("*").alias("k"), *[F.sum(F.xxhash64(F.lit(x), "cls").cast("decimal(38,0)")).alias(x) for x in "xy"])
        return materialize(rest.join(same.groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"), "asked")

    def by_differences(rest: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Keys (cls, key) that linked members of rest's buckets share unless near their group's nearest, and links of those. A group: the buckets of one head."""
        grouped = rest.groupBy("head", "cls").agg(F.max("n").alias("n")).join(texts, "cls")
        voters = grouped.where(F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / VOTERS)) == 0).select("head", "text")
        refs = materialize(voters.groupBy("head").applyInArrow(_majority, "head binary, ref binary"), "refs")
        rows = materialize(_differences(grouped.join(refs, "head", "left"), percent), "differences")
        nearest = materialize(rows.groupBy("head").agg(F.min(F.struct("e", "cls")).alias("m")).select("head", F.col("m.e").alias("least"), F.col("m.cls").alias("m")), "nearest")
        rows = rows.join(nearest, "head")
        near = rows.where("e + least <= 0 and cls <> m").select(F.col("m").alias("a"), F.col("cls").alias("b"))
        return _difference_prefixes(rows, slots, percent), materialize(near, "links")

    members = sized(nodes.select("cls", F.explode("bands").alias("key")))
    links = to_heads(members)
    up = links.groupBy("b").agg(F.min("a").alias("m"))
    label = up.join(up.toDF("m", "mm"), "m", "left").select(F.col("b").alias("cls"), F.coalesce("mm", "m").alias("label"))
    rest = apart(members, materialize(label, "labels"))
    texts = texts_of(rest.select("cls"))
    links = links.unionByName(in_blocks(rest.where(F.col("n") <= BLOCK), texts))

    # Buckets of more than a block are split by the rare prefixes of their members, which those that are linked share: pages of one template part here.
    large = rest.where(F.col("n") > BLOCK).select("cls").distinct()
    if large.isEmpty():
        return links
    texts = materialize(texts.join(large, "cls", "left_semi"), "texts")
    slots = _slots(texts)
    keyed, limit, before = _prefixes(texts, slots, percent), BLOCK, None
    while True:
        members = sized(keyed)
        links = links.unionByName(to_heads(members))
        rest = asked_once(apart(members, components(links).withColumnRenamed("node", "cls")))
        wide = rest.where(F.col("n") > limit)
        left = wide.count()
        if not left or before is not None and 2 * left > before:  # differences don't part these: whole blocks
            return links.unionByName(in_blocks(rest, texts))
        # Near copies of one text share nearly all their shingles, rare ones of the text too. In what each changes, only those meet that changed the same.
        links = links.unionByName(in_blocks(rest.where(F.col("n") <= limit), texts))
        keyed, near = by_differences(wide, texts)
        links, limit, before = links.unionByName(near), WIDE * BLOCK, left


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows of docs (doc_id, h, n_shingles, cls, bands, sig), and cls, component_id of each class; both written."""
    own = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    signed = materialize(with_columns_in_arrow(own, ["text"], ADDED, lambda texts: _signatures(texts, percent), ("text",)), "signatures")
    classes = signed.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.first(F.struct("bands", "sig")).alias("x"))
    nodes = materialize(classes.select("cls", "rep.doc_id", "rep.h", "x.bands", "x.sig"), "classes")
    labels = components(_links(docs, nodes, percent)).withColumnRenamed("node", "cls")
    labelled = labels.join(nodes.select("cls", "doc_id"), "cls")
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    merged = labelled.join(smallest, "label").select("cls", "component_id")
    ids = nodes.select("cls", "doc_id").join(merged, "cls", "left").select("cls", F.coalesce("component_id", "doc_id").alias("component_id"))
    return signed, materialize(ids, "components")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    A document's set: the distinct 5-word shingles of its whole text, lower case in A-Z, words split at ASCII white space; with fewer words, all of them are one
    shingle; null text or text without words has none and is linked with nothing. Documents are linked at ``percent`` % of Jaccard similarity, confirmed on
    full sets; component_id is the smallest doc_id that is reached. Texts of equal sets are one class throughout, so copies make no pairs. Rows that repeat
    a doc_id are separate texts of one id, so that they all stay or all go; rows without doc_id are linked with nothing and kept, their component_id is null;
    an empty table gives no row; columns other than doc_id and text aren't read.
    """
    signed, ids = _grouped(docs, percent)
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")).join(ids, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def text_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """h, component_id: for the hash of each distinct text that has words, the component that near_duplicates() gives it; rows without doc_id are left out."""
    signed, ids = _grouped(docs, percent)
    return signed.where("cls is not null and doc_id is not null").select("h", "cls").distinct().join(ids, "cls").select("h", "component_id")


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that near_duplicates() doesn't keep; columns as in docs."""
    name = unused("_gone", docs.columns)
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col(quoted("doc_id")) == F.col(name), "left_anti")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {SHINGLE} THEN list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM docs),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM docs UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.r)
SELECT doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
