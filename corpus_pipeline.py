"""The corpus pipeline: toxic documents go, boilerplate lines go, one document of each near-duplicate group stays, benchmark leaks go, the rest is packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mixlume.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from mixlume.llm.common import shared_folder, table
from mixlume.llm.queries import TOKENIZER

#: Similarity from which documents are near-duplicates in the stages; op4's own contract is another.
NEAR_PERCENT = 80
#: Pages that must hold a line before the line-dedup stage drops it: on a small host each line exceeds the ratio, and a clean document must keep its text.
LEAST_PAGES = 5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(docs, NEAR_PERCENT, least=LEAST_PAGES)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Compression lengths and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet in the shared folder and read as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/mixlume/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
