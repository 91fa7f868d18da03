"""Conversation prefix trie: ROLLUP over blocks of positional turn-id columns aggregates all prefixes together; subtree figures come from a second ROLLUP over suffix sums."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mixlume.llm.common import materialize

#: Turn-id columns in a block; a longer conversation continues in further blocks, each keyed by the node at which the block before ends.
WIDTH = 8
#: Conversations that share a donor, and the most turns that are taken from it (op12's rebuilding).
SPAN, HEADS = 100, 6
#: The textless root's name. All other nodes are named by a hash of the block's key and the turn ids below it.
ROOT = "0" * 32
#: Bytes of joined ids in one piece of a node's list.
PIECE = 1 << 16
TURNS = [f"t{j}" for j in range(1, WIDTH + 1)]
BLOCKS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("block", T.LongType()), T.StructField("key", T.StringType()), T.StructField("last", T.IntegerType()), *[T.StructField(t, T.StringType()) for t in TURNS]])


def head_turns(conv_id: int) -> int:
    """How many turns a rebuilt conversation takes from its donor."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _name(key: str, ids: list[str]) -> str:
    """The name of the node at the end of a full block; _node() is the same in SQL functions."""
    return hashlib.sha256(",".join([key, *ids]).encode()).hexdigest()[:32]


def _node(level: Column) -> Column:
    named = F.substring(F.sha2(F.concat_ws(",", F.col("key"), F.slice(F.array(*TURNS), F.lit(1), level)), 256), 1, 32)
    return F.when(level == 0, F.col("key")).otherwise(named)


class _Cutter:
    """Cuts the turns of one conversation after another into blocks; holds one block at a time."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.conv: int | None = None

    def begin(self, conv: int) -> None:
        self.end()
        self.conv, self.block, self.key, self.ids = conv, 0, ROOT, []

    def add(self, turn: str) -> None:
        if len(self.ids) == WIDTH:
            self._emit(WIDTH + 1)
            self.key, self.block, self.ids = _name(self.key, self.ids), self.block + 1, []
        self.ids.append(turn)

    def end(self) -> None:
        if self.conv is not None:
            self._emit(len(self.ids))
            self.conv = None

    def _emit(self, last: int) -> None:
        self.rows.append((self.conv, self.block, self.key, last, *self.ids, *[None] * (WIDTH - len(self.ids))))

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(BLOCKS)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.string()] * WIDTH]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=BLOCKS.names)


def _cut(batches: Iterator[pa.RecordBatch], rebuild: bool) -> Iterator[pa.RecordBatch]:
    """Rows (donor, conv_id, turn id) arrive in the order of donor, the donor's own conversation first, conversation and turn. Of a donor only the first turns are held."""
    cutter, donor, heads, conv, at, skip = _Cutter(), None, [], None, 0, 0
    for batch in batches:
        for d, c, turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if d != donor:
                donor, heads = d, []
            if c != conv:
                conv, at, skip = c, 0, head_turns(c) if rebuild else 0
                cutter.begin(c)
                if c != d:
                    for head in heads[:skip]:
                        cutter.add(head)
            at += 1
            if rebuild and c == d and at < HEADS:
                heads.append(turn)
            if c == d or at > skip:
                cutter.add(turn)
        yield cutter.taken()
    cutter.end()
    yield cutter.taken()


def blocks(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """conv_id, block, key, last, t1 to t8: the turn ids of each conversation in blocks of eight, each under the name of the node that the blocks before lead to.

    ``last``: turns in the block, or one more than the block holds if the conversation goes on. A turn id is a 128-bit hash of role and text, with the text's code points behind it.
    With ``rebuild`` a conversation's first turns come from that of its hundred, as op12 says. The rows of a hundred conversations are sorted in one task and read in order there, so
    that a conversation of any length takes no more memory than a block.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.concat(F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 32), F.lit(":"), F.length(text))
    donor = F.col("conv_id") - F.col("conv_id") % SPAN if rebuild else F.col("conv_id")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    rows = rows.select(donor.alias("donor"), "conv_id", "turn", "role", "text", turn.alias("id"))
    dealt = rows.repartition("donor").sortWithinPartitions("donor", F.col("conv_id") != F.col("donor"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("donor", "conv_id", "id").mapInArrow(lambda batches: _cut(batches, rebuild), BLOCKS)


def _rolled(rows: DataFrame, figures: str) -> DataFrame:
    """The figures of each prefix of the blocks' turn ids, with level (turns of the block in the prefix) and id. A block's empty prefix is the end of the block before, so only the first block's is kept."""
    columns = ", ".join(TURNS)
    rolled = rows.sparkSession.sql(f"SELECT block, key, {columns}, {WIDTH} - bit_count(grouping_id()) AS level, {figures} FROM {{rows}} GROUP BY block, key, ROLLUP ({columns})", rows=rows)
    real = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(F.element_at(F.array(*TURNS), F.greatest("level", F.lit(1)).cast("int")).isNotNull())
    return rolled.where(real).withColumn("id", _node(F.col("level")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (id, conv_id) as rows (id, first conv_id, ids joined by commas) of at most PIECE bytes."""
    node, first, ids, size = None, None, [], 0
    for batch in batches:
        out = []
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != node or size > PIECE:
                if ids:
                    out.append((node, first, ",".join(ids)))
                node, first, ids, size = n, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        yield _table(out)
    yield _table([(node, first, ",".join(ids))] if ids else [])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["id", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, read in order; no list of a node is ever whole in memory."""
    node, sha = None, None

    def ended(pairs: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["id", "ends_sha256"])

    for batch in batches:
        out = []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != node:
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield ended(out)
    yield ended([(node, sha.hexdigest())] if node is not None else [])


def _ends(rows: DataFrame) -> DataFrame:
    """id, ends_sha256 of the nodes at which conversations end. Ids are joined within ranges of conv_id first, so that a node of very many ends meets in one task as a few long pieces."""
    at = rows.where(F.col("last") <= WIDTH).select(_node(F.col("last")).alias("id"), "conv_id")
    pieces = at.repartitionByRange("conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(_joined, "id string, first long, ids string")
    return pieces.repartition("id").sortWithinPartitions("id", "first").select("id", "ids").mapInArrow(_hashed, "id string, ends_sha256 string")


def trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """A row for each distinct prefix of the conversations' turns (role, text), the textless root included.

    conv_id: the smallest conversation that starts with it; depth: turns; parent_conv_id: the parent's conv_id (root: null); n_convs: conversations that start with it; n_children;
    n_leaves: childless nodes in its subtree, itself included; saved_tokens: over the subtree, code points of each node's last text times conversations but one;
    ends_sha256: SHA-256 of the ids of conversations that end there, ascending, joined by commas.

    Turns are ordered by ``turn`` (null first), ties by role, then text; rows that repeat a turn are turns of their own; null role and text are empty; rows without conv_id belong to
    no conversation and are left out; an empty table has no node; other columns aren't read. A conversation whose turns were all replaced is a member of the root alone.
    Each node's figures are put down to its smallest member. That is the smallest member of all deeper nodes on its way, too, so sums over a subtree are sums of members' suffix sums.
    """
    rows = materialize(blocks(conversations, rebuild), "blocks")
    rolled = _rolled(rows, "count(*) AS n_convs, min(conv_id) AS conv_id, max(last) AS furthest")
    chars = F.coalesce(F.substring_index(F.element_at(F.array(*TURNS), F.greatest("level", F.lit(1)).cast("int")), ":", -1).cast("long"), F.lit(0))
    nodes = rolled.select(
        "id", F.when(F.col("level") > 0, _node(F.col("level") - 1)).alias("parent"), "conv_id", "block", "level", (F.col("block") * WIDTH + F.col("level")).alias("depth"), "n_convs",
        F.when(F.col("level") > 0, (F.col("n_convs") - 1) * chars).otherwise(0).alias("saved"), (F.col("furthest") == F.col("level")).cast("int").alias("leaf"),
    )
    nodes = materialize(nodes, "nodes")

    own = nodes.groupBy("conv_id", "block").agg(*[F.sum(F.when(F.col("level") == j, F.col("saved"))).alias(f"w{j}") for j in range(1, WIDTH + 1)], F.max("leaf").alias("leaf"))
    weights = [F.coalesce(f"w{j}", F.lit(0)) for j in range(1, WIDTH + 1)]
    whole = Window.partitionBy("conv_id")
    later = whole.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.join(own, ["conv_id", "block"], "left").withColumn("all", sum(weights[1:], weights[0]))
    sums = sums.withColumns({"later": F.coalesce(F.sum("all").over(later), F.lit(0)), "leaves": F.coalesce(F.max("leaf").over(whole), F.lit(0))})
    sums = sums.withColumns({f"s{j}": sum(weights[j - 1 :], F.col("later")) for j in range(1, WIDTH + 1)}).where("s1 > 0 or leaves > 0")
    under = _rolled(sums.select(*BLOCKS.names, "leaves", *[f"s{j}" for j in range(1, WIDTH + 1)]), "sum(leaves) AS n_leaves, " + ", ".join(f"sum(s{j}) AS s{j}" for j in range(1, WIDTH + 1)))
    under = under.select("id", "n_leaves", F.element_at(F.array(*[f"s{j}" for j in range(1, WIDTH + 1)]), F.greatest("level", F.lit(1)).cast("int")).alias("saved_tokens"))

    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "id")
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(under, "id", "left").join(children, "id", "left").join(_ends(rows), "id", "left").join(parents, "parent", "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


#: CRC-32 of the digits, eight shifts a byte; the polynomial is the standard's.
_CRC = "list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(d) + 1), lambda i: [ascii(d[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {SPAN} AS donor, xor({_CRC}, 4294967295) % {HEADS} AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS d FROM t)),
r AS (SELECT c.conv_id, t.pos AS k, t.role, t.text FROM c JOIN t ON t.conv_id = c.donor AND t.pos <= c.h UNION ALL SELECT c.conv_id, t.pos + 1000000, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
l AS (SELECT c.conv_id, coalesce(any_value(x.ts), []) AS ts FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY k) AS ts FROM r GROUP BY conv_id) x ON x.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS depth, ts FROM l),
q AS (SELECT conv_id, n, depth, sha256(ts[1:depth]::JSON::VARCHAR) AS id, CASE WHEN depth > 0 THEN sha256(ts[1:depth - 1]::JSON::VARCHAR) END AS parent, CASE WHEN depth > 0 THEN length(ts[depth]['text']) ELSE 0 END AS chars FROM p),
v AS (SELECT id, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM q GROUP BY id, depth),
k AS (SELECT parent, count(*) AS n FROM v WHERE parent IS NOT NULL GROUP BY parent),
pairs AS (SELECT DISTINCT a.id AS top, b.id AS low, b.depth AS d FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
s AS (SELECT top, sum(v.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves FROM pairs JOIN v ON v.id = low AND v.depth = d LEFT JOIN k ON k.parent = low GROUP BY top)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM v LEFT JOIN v u ON u.id = v.parent AND u.depth = v.depth - 1 LEFT JOIN k ON k.parent = v.id JOIN s ON s.top = v.id
"""
