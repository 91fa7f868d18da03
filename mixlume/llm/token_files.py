"""Token ids as binary segments: patched frame-of-reference blocks with an index of block starts."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixlume.llm.common import shared_folder
from mixlume.llm.tokens import encoder

BLOCK = 128
END_ID = 1
#: Ids after which a segment ends (a document stays whole).
SEGMENT_IDS = 1 << 18
MAGIC = b"PFR1"
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "u1"), ("used", "<u2")])


_SHORT = np.ceil(np.log2(np.arange(1 << 16) + 1.0)).astype(np.uint8)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    high = x >> 16
    return np.where(high > 0, 16 + _SHORT[high], _SHORT[x & 0xFFFF]).astype(np.uint8) if high.any() else _SHORT[x]


def _packed(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as bits, lowest first, in little-endian 64-bit words."""
    values = np.ascontiguousarray(x.T).astype(np.uint64)
    words = np.zeros((BLOCK * width // 64, len(x)), "<u8")
    for k in range(BLOCK if width else 0):
        word, shift = divmod(k * width, 64)
        words[word] |= values[k] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= values[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8)


def _unpacked(x: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(x).view("<u8").T) if width else x.T
    values, mask = np.zeros((BLOCK, len(x)), np.uint32), np.uint64((1 << width) - 1)
    for k in range(BLOCK if width else 0):
        word, shift = divmod(k * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        values[k] = value & mask
    return values.T


def _widths(need: np.ndarray) -> np.ndarray:
    """For each block the width that makes it shortest: one of the percentiles of its values' bits, so that the longer ones are exceptions."""
    rows = len(need)
    count = np.bincount((need + np.arange(rows, dtype=np.int64)[:, None] * 33).ravel(), minlength=33 * rows).reshape(rows, 33)
    return (BLOCK // 8 * np.arange(33) - 5 * np.cumsum(count, axis=1)).argmin(axis=1).astype(np.uint8)


def encode_segment(ids: np.ndarray) -> bytes:
    """Magic, number of ids, number of blocks, block starts (bytes from the first block), blocks.

    A block: minimum (u32), width, number of exceptions, values used; BLOCK differences from the minimum packed at that width; positions (u8), then
    differences (u32) of the exceptions, which are those that need more bits than the chosen percentile of the block's differences.
    """
    n = len(ids)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    x = padded.reshape(rows, BLOCK)
    low = x.min(axis=1) if rows else np.zeros(0, np.uint32)
    x = x - low[:, None]
    need = _bits(x)
    width = _widths(need)
    over = need > width[:, None]
    n_over = over.sum(axis=1)
    sizes = _HEAD.itemsize + BLOCK // 8 * width.astype(np.int64) + 5 * n_over
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros(rows, _HEAD)
    head["low"], head["width"], head["exceptions"], head["used"] = low, width, n_over, BLOCK
    if rows:
        head["used"][-1] = n - (rows - 1) * BLOCK
        out[starts[:, None] + np.arange(_HEAD.itemsize)] = head.view(np.uint8).reshape(rows, -1)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        size = BLOCK // 8 * int(w)
        out[(starts[at] + _HEAD.itemsize)[:, None] + np.arange(size)] = _packed(x[at] & np.uint32((1 << int(w)) - 1), int(w))
    r, c = np.nonzero(over)
    rank = np.arange(len(r)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    base = starts[r] + _HEAD.itemsize + BLOCK // 8 * width[r].astype(np.int64)
    out[base + rank] = c
    out[(base + n_over[r] + 4 * rank)[:, None] + np.arange(4)] = x[r, c].astype("<u4").view(np.uint8).reshape(-1, 4)
    return MAGIC + struct.pack("<QI", n, rows) + starts.astype("<u4").tobytes() + out.tobytes()


def decode_segment(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, rows = struct.unpack_from("<QI", data, 4)
    starts = np.frombuffer(data, "<u4", rows, 16).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=16 + 4 * rows)
    out = np.zeros((rows, BLOCK), np.uint32)
    if not rows:
        return out.ravel()
    head = body[starts[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD).ravel()
    width, n_over = head["width"], head["exceptions"].astype(np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = _unpacked(body[(starts[at] + _HEAD.itemsize)[:, None] + np.arange(BLOCK // 8 * int(w))], int(w))
    r = np.repeat(np.arange(rows), n_over)
    rank = np.arange(len(r)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    base = starts[r] + _HEAD.itemsize + BLOCK // 8 * width[r].astype(np.int64)
    out[r, body[base + rank]] = body[(base + n_over[r] + 4 * rank)[:, None] + np.arange(4)].view("<u4").ravel()
    return (out + head["low"][:, None]).ravel()[:n]


def decode_block(data: bytes, block: int) -> np.ndarray:
    """One block's ids, found through the index of block starts."""
    rows = struct.unpack_from("<QI", data, 4)[1]
    start = struct.unpack_from("<I", data, 16 + 4 * block)[0] + 16 + 4 * rows
    low, width, n_over, used = struct.unpack_from("<IBBH", data, start)
    at = start + _HEAD.itemsize
    x = _unpacked(np.frombuffer(data, np.uint8, BLOCK // 8 * width, at)[None], width)[0]
    at += BLOCK // 8 * width
    x[np.frombuffer(data, np.uint8, n_over, at)] = np.frombuffer(data, "<u4", n_over, at + n_over)
    return (x + np.uint32(low))[:used]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes each text's ids and end_id in ascending doc_id order, as segments in a Parquet container that Spark commits.

    A row is a segment: shard (range of doc_ids), segment, n_ids, base (ids of the shard before it), doc_ids, n_tokens, data. Null text: the end id alone.
    Null doc_ids come first; of equal doc_ids each is written. An empty table gives no segment. Columns other than doc_id and text aren't read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    ranges = docs.select("doc_id", F.col("text").cast("binary").alias("text")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer).ids, TaskContext.get().partitionId()
        docs_in, parts, base, segment = [], [], 0, 0

        def flush():
            nonlocal docs_in, parts, base, segment
            ids = np.frombuffer(b"".join(parts), "<u4")
            made = [[shard], [segment], [len(ids)], [base], [docs_in], [[len(p) // 4 for p in parts]], [encode_segment(ids)]]
            docs_in, parts, base, segment = [], [], base + len(ids), segment + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_kind), pa.list_(pa.int64()), pa.binary()))], names=["shard", "segment", "n_ids", "base", "doc_ids", "n_tokens", "data"])

        size = 0
        for batch in batches:
            id_kind = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                docs_in.append(doc)
                parts.append(ids + end)
                size += len(parts[-1]) // 4
                if size >= segment_ids:
                    size = 0
                    yield flush()
        if parts:
            yield flush()

    ranges.mapInArrow(run, f"shard int, segment int, n_ids bigint, base bigint, doc_ids array<{kind}>, n_tokens array<bigint>, data binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (binary, little-endian u32) of each document in the files at path."""
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, ids_of, sizes, data in zip(*[c.to_pylist() for c in batch.columns]):
                flat = decode_segment(data).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                cut = [flat[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), sizes)]
                columns = (ids_of, (ends - sizes + start).tolist(), sizes, [zlib.crc32(x) for x in cut], cut)
                kinds = (batch.schema.field(1).type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    joined = segments.join(shards, "shard").select((F.col("base") + F.col("shard_start")).alias("start"), "doc_ids", "n_tokens", "data")
    return joined.mapInArrow(run, f"doc_id {kind.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs to the shared folder and returns what the files hold of each document."""
    path = f"{shared_folder(docs.sparkSession)}/mixlume/ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path).drop("ids")
