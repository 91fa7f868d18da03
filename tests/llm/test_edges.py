"""Each operator and stage on rows with nulls, empty, very long, tied and repeated texts, and with columns whose names could clash with its own."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mixlume.llm import decontaminate, fingerprints, lang_id, line_dedup, near_dup, packing, pii, token_counts, token_files, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLASH = ["_in0", "a.b", "tick`s", "_host", "_site", "_keys", "_lines", "_kept", "_gone", "_pii_t", "_row", "_words", "_hashes", "k0", "i0", "a0", "c0", "cls", "h", "label", "slice", "rank", "sketch", "group", "shard", "z"]
LONG = " ".join(f"word{i % 4001}" for i in range(30000))
ROWS = [
    (1, "some plain words that stand here in a row today\nFooter", "en", "s0"), (2, None, None, None), (3, "", "de", "s0"), (4, "  \n\t", "en", None), (5, LONG, "en", "s1"),
    (6, "one two three\nFooter", "en", "s0"), (6, "one two three\nFooter", "en", "s0"), (None, "row without an id\nFooter", "en", "s0"), (None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    """(labels, benchmark, folder of both)."""
    folder = str(tmp_path_factory.mktemp("sides"))
    spark.createDataFrame([(k, k % 2) for k in range(1, 7)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("q1", "plain words that stand"), (None, None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"), folder


ADDING = {
    "decontaminate.scan": lambda d, labels, bench: decontaminate.scan(d, bench),
    "pii.find": lambda d, labels, bench: pii.find(d),
    "line_dedup.mark": lambda d, labels, bench: line_dedup.mark(d),
    "lang_id.predict": lambda d, labels, bench: lang_id.predict(d, lang_id.fit(d.select("lang", "text"))),
    "lang_id.predict without a model": lambda d, labels, bench: lang_id.predict(d, []),
    "toxicity.predict": lambda d, labels, bench: toxicity.predict(d, toxicity.fit(d, labels)),
    "fingerprints.with_sketch": lambda d, labels, bench: fingerprints.with_sketch(d, "text", "fp"),
    "token_counts.with_counts": lambda d, labels, bench: token_counts.with_counts(d.withColumn("edits", F.expr("cast(null as array<struct<start:bigint,length:bigint,replacement:string>>)")), TOKENIZER),
}
REPORTS = {
    "op1": lambda d, labels, bench: decontaminate.report(d, bench),
    "op2": lambda d, labels, bench: token_counts.report(d, TOKENIZER),
    "op3": lambda d, labels, bench: pii.report(d),
    "op4": lambda d, labels, bench: near_dup.near_duplicates(d),
    "op5": lambda d, labels, bench: line_dedup.report(d),
    "op6": lambda d, labels, bench: token_files.round_trip(d, TOKENIZER),
    "op7": lambda d, labels, bench: lang_id.report(d),
    "op8": lambda d, labels, bench: fingerprints.report(d),
    "op10": lambda d, labels, bench: toxicity.report(d, labels),
}


@pytest.mark.parametrize("name", ADDING)
def test_added_columns_leave_all_others_alone(docs, sides, name):
    out = ADDING[name](docs, *sides[:2])
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert sorted(map(str, (tuple(r)[: len(docs.columns)] for r in rows))) == sorted(map(str, map(tuple, docs.collect())))
    assert ADDING[name](docs.limit(0), *sides[:2]).count() == 0


@pytest.mark.parametrize("name", REPORTS)
def test_reports_have_a_row_for_each_document(docs, sides, name):
    rows = REPORTS[name](docs, *sides[:2]).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert all(r["held_out"] is not None for r in rows if "held_out" in r)
    assert REPORTS[name](docs.limit(0), *sides[:2]).count() == 0


def test_packing_packs_each_document(docs):
    got = packing.pack(docs, TOKENIZER).where("piece = 0").collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


def test_rows_without_id(docs):
    near = [(r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).where("doc_id is null").collect()]
    assert near == [(None, True)] * 2
    marks = {(r["n_chars"], r["near_next"]) for r in fingerprints.report(docs).where("doc_id is null").collect()}
    assert marks == {(24, None), (0, None)}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, docs, sides, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sides[2])
    assert out.columns == docs.columns
    kept = {str(tuple(r)) for r in out.collect()}
    if name != "line_dedup":
        assert kept <= {str(tuple(r)) for r in docs.collect()}
    assert stage(spark, docs.limit(0), sides[2]).count() == 0


def test_pipeline_of_empty_tables_and_null_texts(spark, docs, sides, tmp_path):
    for k, table in enumerate((docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0), docs.select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))):
        folder = f"{tmp_path}/{k}"
        table.write.parquet(f"{folder}/documents.parquet")
        sides[0].write.parquet(f"{folder}/labels.parquet")
        sides[1].write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert len(got) == (0 if k == 0 else len(ROWS)) and all(r["length"] == 1 for r in got)
