"""Scans, audits and sinks."""

from __future__ import annotations

import lzma
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the folder that driver and executors share (spark.checkpoint.dir; a temporary one in local mode) and reads it: cuts lineage and long expressions."""
    spark = df.sparkSession
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mixlume-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/mixlume/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, domain: str = "_source_domain") -> DataFrame:
    """JSON lines (plain, gz, zst) with a fixed schema and without the text body; the domain comes from the record or else from the file's name."""
    rows = spark.read.schema(schema).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return rows.withColumn(domain, F.coalesce(F.col(domain) if domain in rows.columns else F.lit(None).cast("string"), stem))


def read_xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of xz files, which Spark doesn't decode: a file is one task, decoded as a stream. Write the result to Parquet once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                lines: list[tuple[str, int, str]] = []
                for k, line in enumerate(io.TextIOWrapper(lzma.open(io.BytesIO(content)), encoding="utf-8")):
                    lines.append((name, k, line.rstrip("\n")))
                    if len(lines) == 10_000:
                        yield pd.DataFrame(lines, columns=["path", "line_no", "line"])
                        lines = []
                yield pd.DataFrame(lines, columns=["path", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, line_no long, line string")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headed CSV with a byte-order mark, quoted cells of several lines, and blanks kept as text."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').option("emptyValue", "").option("nullValue", "\0").csv(path)


def newest_parseable(files: DataFrame, by: str, name: str, body: str) -> tuple[DataFrame, DataFrame]:
    """(the newest file of each directory that parses as {results: {task: {metric: text}}} with a task, as columns by, name and results; files that don't parse, with a reason)."""
    kind = "results map<string, map<string, string>>"
    parsed = files.withColumn("_j", F.from_json(body, kind)).withColumn("_ok", F.expr(f"coalesce(try_parse_json({body}) is not null, false)"))
    dead = parsed.where("not _ok").select(by, name, F.when(F.trim(F.coalesce(F.col(body), F.lit(""))) == "", "empty").otherwise("not JSON").alias("reason"))
    good = parsed.where(F.col("_ok") & (F.size(F.col("_j.results")) > 0))
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(name)))
    return good.withColumn("_r", last).where("_r = 1").select(by, name, F.col("_j.results").alias("results")), dead


def scan_files(spark: SparkSession, pattern: str, fmt: str, name: str = r"([^/]+)$", **options: str) -> DataFrame:
    """All files that a path pattern names, as one table with ``file``: what the first group of ``name`` finds in the row's path. Schemas are merged."""
    rows = spark.read.format(fmt).options(**({"mergeSchema": "true"} | options)).load(pattern)
    return rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), name, 1))


def paired(scopes: dict[str, tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """One table of the scopes' pairs of tables, each pair joined by key, with the scope as a column; columns that a scope lacks are NULL."""
    out = None
    for name, (a, b) in scopes.items():
        one = a.join(b, key).withColumn("scope", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def single_result(files: DataFrame, body: str, tag: str) -> DataFrame:
    """files with value and status: the value of the one element of the body's results whose val_data contains the tag; none or several are a status, not an error."""
    parsed = F.from_json(body, "results array<struct<val_data: string, value: double>>")["results"]
    hits = files.withColumn("_r", F.filter(F.coalesce(parsed, F.array()), lambda r: F.contains(r["val_data"], F.lit(tag))))
    status = F.when(F.size("_r") == 1, "one").when(F.size("_r") == 0, "none").otherwise("several")
    return hits.withColumn("status", status).withColumn("value", F.when(F.size("_r") == 1, F.col("_r")[0]["value"])).drop("_r")


def file_identity(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """name, status of each file against a manifest (name, bytes, sha256): ok, changed, missing or unexpected."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("_bytes"), F.sha2("content", 256).alias("_sha"))
    both = manifest.join(found, "name", "full_outer")
    status = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("sha256") == F.col("_sha")) & (F.col("bytes") == F.col("_bytes")), "ok").otherwise("changed")
    return both.select("name", status.alias("status"))


def without_non_finite(df: DataFrame) -> DataFrame:
    """df with NaN and infinities of double and float columns as NULL, as it should be before any sink."""

    def clean(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c

    return df.select(*[clean(f) for f in df.schema.fields])


def save(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    without_non_finite(df).write.mode("overwrite").format(fmt).option("header", True).save(path)
