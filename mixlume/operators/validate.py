"""Checks of tables and keys; each returns its evidence as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(rules: dict[str, Column]) -> Column:
    """All names of rules that hold for a row, in order; a row is kept where there is none."""
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))


def violations(df: DataFrame, key: str, rules: dict[str, tuple[str, list[str] | None]]) -> DataFrame:
    """key, col, rule, value of each cell that breaks its column's rule: required, positive or enum."""

    def broken(name: str, rule: str, allowed: list[str] | None) -> Column:
        c = F.col(name)
        if rule == "positive":
            return ~F.coalesce(c.cast("double") > 0, F.lit(False))
        if rule == "enum":
            return ~F.coalesce(c.isin(*(allowed or [])), F.lit(False))
        return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""

    cells = F.array_compact(F.array(*[F.when(broken(c, r, a), F.struct(F.lit(c).alias("col"), F.lit(r).alias("rule"), F.col(c).cast("string").alias("value"))) for c, (r, a) in rules.items()]))
    return df.select(F.col(key).alias("key"), F.inline(cells))


def inventory_difference(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key, status: missing or unexpected."""
    both = expected.select(key).distinct().withColumn("_e", F.lit(True)).join(present.select(key).distinct().withColumn("_p", F.lit(True)), key, "full_outer")
    return both.where("_e is null or _p is null").select(key, F.when(F.col("_p").isNull(), "missing").otherwise("unexpected").alias("status"))


def key_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Repeated keys of each side and keys of only one side, in one full join of key counts."""
    counts = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = counts(left, "_l").join(counts(right, "_r"), key, "full_outer")
    return both.agg(F.count_if(F.col("_l") > 1).alias("left_repeated"), F.count_if(F.col("_r") > 1).alias("right_repeated"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))


def many_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined to right; fails when run if a key repeats in right."""
    counted = right.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c != key])
    sure = counted.withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast(right.schema[key].dataType)).otherwise(F.col(key))).drop("_n")
    return left.join(sure, key, how)


def support(n: str, d: str) -> Column:
    """inside, N_outside, D_outside or both_outside of the bounds n0, n1, d0, d1 of the row."""
    out_n, out_d = ~F.col(n).between(F.col("n0"), F.col("n1")), ~F.col(d).between(F.col("d0"), F.col("d1"))
    return F.when(out_n & out_d, "both_outside").when(out_n, "N_outside").when(out_d, "D_outside").otherwise("inside")


def extrapolation_distance(n: str, d: str) -> Column:
    """Distance from the bounds n0, n1, d0, d1 of the row, in logarithms."""
    far = lambda x, low, high: F.greatest(F.lit(0.0), F.ln(F.col(low) / F.col(x)), F.ln(F.col(x) / F.col(high)))
    return F.sqrt(F.pow(far(n, "n0", "n1"), 2) + F.pow(far(d, "d0", "d1"), 2))


def compare(expected: DataFrame, actual: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """rows, largest absolute difference, ok; a key of one side only isn't ok."""
    both = expected.select(key, F.col(value).alias("_x")).join(actual.select(key, F.col(value).alias("_y")), key, "full_outer")
    gap = F.abs(F.col("_x") - F.col("_y"))
    return both.agg(F.count("*").alias("rows"), F.max(gap).alias("largest"), F.bool_and(F.coalesce(gap <= tolerance, F.lit(False))).alias("ok"))
