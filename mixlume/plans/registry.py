"""All registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None, doubles: str = "", dates: str = ""):
    """Registers a query with its SQL; both sides round the named double columns to DIGITS digits, so that the order of sums doesn't matter, and give dates as text."""
    names, days = doubles.split(), dates.split()

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c).cast("double"), DIGITS) + 0.0).alias(c) if c in names else F.date_format(c, "yyyy-MM-dd").alias(c) if c in days else F.col(c) for c in df.columns])

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            replaced = ", ".join([f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in names] + [f"strftime(CAST({c} AS DATE), '%Y-%m-%d') AS {c}" for c in days])
            ORACLE_SQL[name] = f"SELECT * REPLACE ({replaced}) FROM (\n{sql}\n)" if replaced else sql
        return run

    return add


for _name in ("quality", "tables", "frontier", "mixture", "scenarios", "extensions", "optimum", "selection", "transfer", "refits"):
    import_module(f"mixlume.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["ag2_domain_summary"](spark, sf_dir)
