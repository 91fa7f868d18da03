"""Streaming forms: frozen scoring of arriving rows, running records, and monthly quantiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mixlume.operators import stats


def score_stream(arriving: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Arriving rows scored by a stateless function of frozen parameters: the batch code, with parameter tables as the static side."""
    if not arriving.isStreaming:
        raise ValueError("arriving must be a stream")
    return score(arriving)


def running_record(arriving: DataFrame, by: str, value: str) -> DataFrame:
    """by, record: for the update output mode. A late row can't lower a maximum, so no watermark is needed; NaN and infinities don't count."""
    ok = ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    return arriving.where(ok).groupBy(by).agg(F.max(value).alias("record"))


def monthly_quantiles(arriving: DataFrame, ts: str, value: str, table: str, q: float = 0.9) -> StreamingQuery:
    """Keeps the Parquet folder ``table``/quantiles at each calendar month's quantile of all rows seen: months aren't windows of one length.

    A batch is written by month, and only the months that it touches are read again and replaced. A repeated epoch overwrites itself, and the stream resumes
    from its checkpoint below ``table``, which should be in a folder that all executors share.
    """

    def update(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.date_format(ts, "yyyy-MM").alias("month"), F.col(value).cast("double").alias("value"))
        rows.write.mode("overwrite").partitionBy("month").parquet(f"{table}/rows/epoch={epoch}")
        touched = [r["month"] for r in batch.select(F.date_format(ts, "yyyy-MM").alias("month")).distinct().collect() if r["month"] is not None]  # months of one batch
        if not touched:
            return
        seen = spark.read.option("basePath", f"{table}/rows").schema("value double, epoch long, month string").parquet(f"{table}/rows").where(F.col("month").isin(touched))
        counts = seen.groupBy("month").agg(F.count("value").alias("n"))
        found = stats.quantiles(seen, ["month"], {"quantile": ("value", q)}).join(counts, "month")
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{table}/quantiles")

    return arriving.writeStream.option("checkpointLocation", f"{table}/checkpoint").foreachBatch(update).start()
