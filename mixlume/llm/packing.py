"""Best-fit packing by minimum bin slack over the table's histogram of piece lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlume.llm.common import materialize
from mixlume.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0
#: Rows that one (length, slice) rank window should hold; hot lengths are dealt to more slices as the table grows.
SLICE_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each whole text and end_id, cut every ``capacity`` ids. Null text: empty."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths with the largest sum of at most ``room``: subset sums as bits of an integer, each length as often as it is there."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... copies make any number of copies
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            chosen += [length] * k
    return chosen


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(bins, lengths in a bin): each bin takes the longest piece that is left and then the fullest combination of others; the bin is repeated while its lengths last.

    Each pattern uses up a length, so there are at most about as many patterns as lengths, whatever the table's size.
    """
    counts, out = {k: v for k, v in histogram.items() if v}, []
    while counts:
        seed = max(counts)
        rest = dict(counts)
        rest[seed] -= 1
        chosen = [seed, *_fullest({k: v for k, v in rest.items() if v and k <= capacity - seed}, capacity - seed)]
        need = {x: chosen.count(x) for x in chosen}
        times = min(counts[x] // n for x, n in need.items())
        out.append((times, chosen))
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return out


def slots(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[list[int], list[tuple[int, int, list[int]]]]]:
    """For each length: first rank of each of its runs, and of each run the first bin, pieces in a bin and their offsets in the bin."""
    out: dict[int, tuple[list[int], list[tuple[int, int, list[int]]]]] = {}
    used: dict[int, int] = {}
    base = 0
    for times, lengths in plan:
        offset, places = 0, {}
        for x in lengths:
            places.setdefault(x, []).append(offset)
            offset += x
        for x, at in places.items():
            firsts, runs = out.setdefault(x, ([], []))
            firsts.append(used.get(x, 0))
            runs.append((base, len(at), at))
            used[x] = used.get(x, 0) + times * len(at)
        base += times
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs the documents' pieces of at most ``capacity`` ids into few sequences.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row for each piece. The driver gets only the histogram of lengths (at most
    ``capacity`` rows) and broadcasts the plan made from it. Pieces get their rank within a length in slices, as many as the length's pieces need, so a length
    that many copies share isn't ranked in one task. Columns other than doc_id and text aren't read. Null text is a document of the end id alone; repeated doc_ids are packed each; an empty table gives no row.
    """
    made = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = made.sparkSession.sparkContext.broadcast(slots(patterns(histogram, capacity)))
    dealt = made.sparkSession.createDataFrame([(k, 1 + n // SLICE_ROWS) for k, n in histogram.items()], "length long, slices long")  # at most ``capacity`` rows
    sliced = made.join(F.broadcast(dealt), "length").withColumn("slice", F.expr("pmod(xxhash64(doc_id, piece), slices)"))
    by_slice = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_slice.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = sliced.withColumn("rank", F.row_number().over(own) - 1).join(bases, ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = plan.value
        for batch in batches:
            bins, offsets = [], []
            for length, rank in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                firsts, runs = places[length]
                k = bisect_right(firsts, rank) - 1
                base, each, at = runs[k]
                bins.append(base + (rank - firsts[k]) // each)
                offsets.append(at[(rank - firsts[k]) % each])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
