"""Exact duplicates by an extendible-hash index in shared files: a directory that doubles until no bucket is overfull, and owner tasks that chain collisions and compare bytes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mixlume.llm.common import materialize, quoted, release, with_columns_in_arrow

#: Bytes of normalised text above which a bucket is split, and the most bits of the directory (2 ** 20 slots are at most 16 MB); fuller buckets of that depth stay, as owners read them in order.
CAPACITY, MOST_BITS = 1 << 20, 20
SPACES = b" \t\n\x0b\x0c\r"


def _entries(texts: pa.Array, chars: pa.Array, ids: pa.Array, rows: pa.Array, bits: int) -> dict[str, list]:
    """For each row the hash and the digest of its normalised text; of the rows of one text in this batch, the first also has the text, the number of rows and the best of them."""
    keys, digests, first = [], [], {}
    n = len(texts)
    bodies, counts, best = [None] * n, [None] * n, [None] * n
    for i, (text, length, doc, row) in enumerate(zip(texts.to_pylist(), chars.to_pylist(), ids.to_pylist(), rows.to_pylist())):
        body = (text or b"").translate(None, SPACES)
        mine = {"chars": length, "doc_id": doc, "row": row}
        at = first.setdefault(body, i)
        if at == i:
            key = xxhash.xxh3_64_intdigest(body) >> (64 - bits) << (64 - bits)
            keys.append(key - (1 << 64) if key >> 63 else key)
            digests.append(hashlib.sha256(body).hexdigest())
            bodies[i], counts[i], best[i] = body, 1, mine
        else:
            keys.append(keys[at])
            digests.append(digests[at])
            counts[at] += 1
            if _order(mine) < _order(best[at]):
                best[at] = mine
    return {"h": keys, "text_sha256": digests, "body": bodies, "n": counts, "best": best}


def _order(row: dict) -> tuple:
    """Most code points first, then the smallest doc_id, rows without one last; then the place in the table."""
    return -row["chars"], row["doc_id"] is None, 0 if row["doc_id"] is None else row["doc_id"], row["row"]


def _slot(depth: int) -> Column:
    """The first ``depth`` bits of the hash."""
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY, most_bits: int = MOST_BITS) -> tuple[int, pa.Table]:
    """The directory's depth, and (slot, bucket) for each of its slots. ``entries``: (h, size).

    It begins with as many slots as full buckets would fill (a longer text fills one), and doubles as long as a bucket holds more than ``capacity`` bytes besides its longest text, which no split could part; only such
    buckets split, others are met by several slots. A bucket's load are its distinct hashes: copies are chained into one entry. What reaches the driver are sizes of slots, at most 2 ** most_bits.
    """
    loads = materialize(entries.groupBy("h").agg(F.max("size").alias("size")), "loads")
    total = loads.agg(F.sum(F.least("size", F.lit(capacity)))).first()[0] or 0
    depth = min(most_bits, max(0, math.ceil(math.log2(max(1, total) / capacity))))
    closed: list[tuple[int, int]] = []  # (first bits, depth) of buckets that don't split any more
    while True:
        found = loads.groupBy(_slot(depth).alias("slot")).agg(F.sum("size").alias("size"), F.max("size").alias("longest")).toArrow()
        slots, sizes, longest = (np.array(found.column(k)) for k in range(3))
        full = slots[sizes - longest > capacity] if depth < most_bits else slots[:0]
        if not len(full):
            break
        met = np.zeros(1 << depth, bool)
        for bits, d in closed:
            met[bits << (depth - d) : (bits + 1) << (depth - d)] = True
        met[full] = True
        closed += [(int(s), depth) for s in np.flatnonzero(~met)]
        depth += 1
    bucket = np.arange(1 << depth)
    for bits, d in closed:
        bucket[bits << (depth - d) : (bits + 1) << (depth - d)] = bits << (depth - d)
    return depth, pa.table({"slot": np.arange(1 << depth), "bucket": bucket})


def _owned(batches: Iterator[pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Index entries of the buckets of one owner, whose rows come by bucket and hash: texts of one hash are a chain, in which bytes decide. Holds the chain of one hash at a time."""
    key, chain = None, []

    def ended() -> list[dict]:
        return [{"bucket": key[0], "h": key[1], "place": k, "text_sha256": x[1], "group_size": x[2], "best": x[3]} for k, x in enumerate(chain)]

    for batch in batches:
        out = []
        columns = [batch.column(k) for k in range(batch.num_columns)]
        for i in range(batch.num_rows):
            bucket, h, body, sha, n, best = (c[i].as_py() for c in columns)
            if (bucket, h) != key:
                out += ended()
                key, chain = (bucket, h), []
            same = next((x for x in chain if x[0] == body), None)
            if same is None:
                chain.append([body, sha, n, best])
            else:
                same[2] += n
                same[3] = min(same[3], best, key=_order)
        yield pa.RecordBatch.from_pylist(out, schema=kind)
        del columns, batch
        release()
    yield pa.RecordBatch.from_pylist(ended(), schema=kind)


def _indexed(docs: DataFrame, keep: list[str], capacity: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (doc_id, text and the columns to keep) with ``row``, ``h`` and ``text_sha256``, and the index; both written in the shared folder."""
    id_type = docs.schema["doc_id"].dataType
    best = T.StructType([T.StructField("chars", T.LongType()), T.StructField("doc_id", id_type), T.StructField("row", T.LongType())])
    added = [T.StructField("h", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("body", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("best", best)]
    rows = docs.withColumns({"chars": F.length(F.coalesce("text", F.lit(""))).cast("long"), "row": F.monotonically_increasing_id()})
    rows = with_columns_in_arrow(rows, ["text", "chars", "doc_id", "row"], added, lambda *columns: _entries(*columns, bits), () if "text" in keep else ("text",))
    rows = materialize(rows, "rows")
    entries = rows.where("n is not null")
    depth, slots = directory(entries.select("h", F.length("body").alias("size")), capacity)
    slots = materialize(docs.sparkSession.createDataFrame(slots), "directory")
    index = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("h", T.LongType()), T.StructField("place", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("group_size", T.LongType()), T.StructField("best", best)])
    kind = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in index])
    dealt = entries.withColumn("slot", _slot(depth)).join(F.broadcast(slots), "slot").select("bucket", "h", "body", "text_sha256", "n", "best")
    owned = dealt.repartition("bucket").sortWithinPartitions("bucket", "h").mapInArrow(lambda batches: _owned(batches, kind), index)
    return rows, materialize(owned, "index")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Texts are equal when they are identical without ASCII white space; null counts as empty, so that null, empty and blank texts are one group. Of each group one row stays: that with the most
    code points in its original text, then the smallest doc_id (rows without one come last, and keep_id is null only if all lack it); of rows that repeat all this, the one that the table has
    first. An empty table gives no row; other columns aren't read.

    A batch's rows of one text are one entry, so that a group of copies sends at most one row a batch to its bucket. Entries go to buckets by the first bits of a 64-bit hash; a bucket's owner
    reads them in order of the hash and compares bytes within a hash. ``bits`` of the hash are used; few of them make collisions, for tests.
    """
    rows, index = _indexed(docs.select("doc_id", "text"), [], capacity, bits)
    groups = index.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    out = rows.select("doc_id", "row", "text_sha256").join(groups, "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs without the rows that exact_duplicates() doesn't keep; columns as in docs, whatever their names."""
    names = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    rows, index = _indexed(docs.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]), list(names.values()), capacity, 64)
    kept = index.select(F.col("best.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*[F.col(n) for n in names.values()]).toDF(*docs.columns)


_SQL_TEXT = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_TEXT} AS body, length(coalesce(text, '')) AS chars FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST)
"""
