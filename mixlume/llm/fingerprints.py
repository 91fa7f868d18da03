"""Document fingerprints: threshold-scaled sketches of word shingles. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlume.llm.common import quoted, unused

SHINGLE = 5
#: A shingle hash below 2**63 / SCALE is retained.
SCALE = 2
#: doc_ids that one window of neighbours spans.
WIDTH = 1024
#: Distinct keys that one task may order.
ALONE = 4096
#: Groups whose top documents are broadcast; more are joined by a shuffle of the texts.
BROADCAST = 200_000
_MASK = 0x7FFFFFFFFFFFFFFF


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """df with ``name``: the sorted distinct 63-bit shingle hashes of the whole text below the fraction 1/scale.

    A shingle is five words (lower case, split at white space); a text of fewer words, but not none, is one shingle. The rule is the same for each hash and
    text, so the sketch of a union of shingle sets is the array_union of their sketches, and a short text's sketch may be empty; null text has an empty one.
    A column called ``name`` is replaced, others keep their names and values.
    """
    df = df.drop(name)
    words, hashes = unused("_words", df.columns), unused("_hashes", df.columns)
    word = ", ".join([f"{words}[i + {k}]" for k in range(1, SHINGLE)])
    df = df.withColumn(words, F.expr(rf"array_remove(split(lower(coalesce({quoted(text)}, '')), '[\\s]+'), '')"))
    df = df.withColumn(
        hashes,
        F.expr(
            f"case when size({words}) >= {SHINGLE} then transform(slice({words}, 1, size({words}) - {SHINGLE - 1}), (w, i) -> xxhash64(w, {word}) & {_MASK}L) "
            f"when size({words}) > 0 then array(xxhash64(concat_ws(' ', {words})) & {_MASK}L) else cast(array() as array<bigint>) end"
        ),
    )
    return df.withColumn(name, F.expr(f"array_sort(array_distinct(filter({hashes}, h -> h <= {(_MASK + 1) // scale - 1}L)))")).drop(words, hashes)


def text_of(sketch: Column) -> Column:
    return F.concat_ws("", F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Estimated Jaccard similarity of two texts by their sketches; two empty sketches tell nothing, so it is 1 where the texts are ``equal`` and 0 elsewhere."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.when(equal, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds, whatever the lengths; null if a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def _next_lower(keys: DataFrame, n: int, width: int) -> DataFrame:
    """key, lower: for each distinct key the next lower one. Windows hold ``width`` consecutive keys; heads of windows are ordered by the same rule one level up."""
    if n <= ALONE:
        return keys.withColumn("lower", F.lag("key").over(Window.orderBy("key")))
    own = keys.withColumn("group", F.expr(f"floor(key / {width})").cast("long"))
    groups = own.groupBy("group").agg(F.max("key").alias("top"))
    above = _next_lower(groups.select(F.col("group").alias("key")), -(-n // width), width)
    tops = above.where("lower is not null").join(groups.select(F.col("group").alias("lower"), "top"), "lower").select(F.col("key").alias("group"), "top")
    inside = own.withColumn("lower", F.lag("key").over(Window.partitionBy("group").orderBy("key")))
    return inside.join(tops, "group", "left").select("key", F.coalesce("lower", "top").alias("lower"))


def report(docs: DataFrame, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text: its second half replaced by the start of the next document's, in descending order of doc_id.

    Documents of ``width`` consecutive doc_ids are sorted together; the top document of each such group also goes to the next higher group that isn't empty,
    as the neighbour of its lowest document, and the highest document of all to the lowest group. So texts are shuffled once. A row of null doc_id has no
    place in the order: its second half is cut off and near_next is null. Of equal doc_ids the next row is the next document; null text is empty; an empty
    table gives no row; other columns aren't read.
    """
    apart = docs.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_sketch"))
    own = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    group = F.expr(f"floor(doc_id / {width})").cast("long")
    groups = own.groupBy(group.alias("group")).agg(F.max("doc_id").alias("top"))
    row = groups.agg(F.count("*"), F.min("group"), F.max("group")).first()
    n, lowest, highest = row[0], row[1], row[2]
    if not n:
        lowest = highest = 0
    lower = _next_lower(groups.select(F.col("group").alias("key")), n, width).where("lower is not null").select(F.col("key").alias("to"), F.col("lower").alias("group"))
    tops = groups.join(lower, "group", "left").select("top", F.when(F.col("group") == highest, F.lit(lowest)).otherwise(F.col("to")).alias("to"))
    numbered = own.withColumn("group", group)
    tops = tops.select(F.col("top").alias("_top"), F.col("to").alias("_to"))
    tops = F.broadcast(tops) if n <= BROADCAST else tops  # n rows of two integers
    dealt = numbered.join(tops, F.col("doc_id") == F.col("_top"), "left").withColumn("copies", F.expr("if(_top is null, array(named_struct('to', group, 'last', false)), array(named_struct('to', group, 'last', false), named_struct('to', _to, 'last', true)))"))
    dealt = dealt.select("doc_id", "text", F.inline("copies"))
    dealt = with_sketch(dealt.repartition("to"), "text", "sketch", scale)  # after the shuffle, which carries texts alone
    order = Window.partitionBy("to").orderBy("last", F.desc("doc_id"), "text")
    both = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where("not last")
    both = both.select("doc_id", "text", "sketch", "next_text", "next_sketch").unionByName(with_sketch(apart, "text", "sketch", scale))
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))"))
    both = with_sketch(both, "edited", "edited_sketch", scale)
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        F.when(F.col("next_sketch").isNotNull(), likeness(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next_text"))).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
    )
