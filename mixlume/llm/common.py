"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="mixlume-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: cuts lineage, survives lost executors, and later reads are column-pruned."""
    path = f"{shared_folder(df.sparkSession)}/mixlume/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(column: str) -> str:
    """The column's name as an expression, whatever characters it holds."""
    return "`" + column.replace("`", "``") + "`"


def unused(stem: str, columns: list[str]) -> str:
    """A name that starts with ``stem`` and clashes with none of the columns, in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def with_columns_in_arrow(df: DataFrame, inputs: list[str], added: list[T.StructField], make: Callable[..., dict[str, pa.Array]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns that ``make(*input_arrays)`` returns for each Arrow batch; input strings arrive as binary (UTF-8). A column of df with an added name is replaced.

    Other columns keep their names and values, whatever their names are; those in ``drop`` (a text that isn't needed any more) aren't sent back.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    gone = {f.name.lower() for f in added} | {c.lower() for c in drop}
    keep = [f for f in df.schema if f.name.lower() not in gone]
    kinds = {f.name: to_arrow_type(f.dataType) for f in added}
    sent = [f.name for f in keep] + [c for c in dict.fromkeys(inputs) if c not in {f.name for f in keep}]  # a kept input is sent once
    places = [sent.index(c) for c in inputs]
    source = df.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(sent)])
    schema = T.StructType([T.StructField(f"k{i}", f.dataType, f.nullable) for i, f in enumerate(keep)] + [T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added)])

    def given(column: pa.Array) -> pa.Array:
        return column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, places[0]):
                new = make(*[given(batch.column(i)) for i in places])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(new[k], type=t) for k, t in kinds.items()]], names=schema.names)
            release()

    return source.mapInArrow(run, schema).toDF(*[f.name for f in keep], *kinds)


def _parts(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of a text column each, so that few texts are Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, np.int64)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Gives freed memory of this worker back to the system: Spark reuses workers, which would otherwise hold the peak of each stage before."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def byte_table(kept: Callable[[int], bool]) -> bytes:
    """For bytes.translate: A-Z to lower case, bytes that aren't kept to a space."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if kept(b + 32 if 65 <= b <= 90 else b) else 32 for b in range(256))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    up, down = np.full(n, np.uint64(base)), np.full(n, np.uint64(pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class SpanHasher:
    """64-bit hashes of many spans of one byte buffer from prefix sums: time per span doesn't depend on its length. Hashers of two seeds have bases of their own."""

    def __init__(self, seed: int = 0) -> None:
        self.letter = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * seed))
        self.base = int(mix(np.array([seed + 1], np.uint64))[0]) | 5
        self.up, self.down = _powers(self.base, 1 << 16)

    def __call__(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self.up):
            self.up, self.down = _powers(self.base, len(data) + (1 << 16))
        buffer = np.frombuffer(data, np.uint8)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letter[buffer] * self.up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (Stafford's variant 13)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_slices(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer text is a range of its own."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x or b"") > most:
            yield start, i
            start, size = i, 0
        size += len(x or b"")
    if start < len(texts):
        yield start, len(texts)
