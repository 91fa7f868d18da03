"""Resampling, splits and folds from hashes: the same rows in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.functions.expr import hash_uniform, poisson_one
from mixlume.operators import stats


def poisson_weights(key: str, reps: int, seed: str, first: int = 0) -> Column:
    """The Poisson(1) counts of a key in ``reps`` replicates from ``first`` on, as an array: each hash is worked out once, not for each comparison with it."""
    drawn = F.transform(F.sequence(F.lit(first), F.lit(first + reps - 1)), lambda rep: hash_uniform(seed, rep, F.col(key)))
    return F.transform(drawn, poisson_one)


def poisson_rows(df: DataFrame, key: str, reps: int, seed: str) -> DataFrame:
    """df exploded by replicate (rep), each row as often as its Poisson(1) count (weight)."""
    rows = df.select("*", F.posexplode(poisson_weights(key, reps, seed)).alias("rep", "weight")).where("weight > 0")
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("weight")))).drop("_k")


def bootstrap_median(df: DataFrame, by: list[str], value: str, key: str, reps: int, seed: str) -> DataFrame:
    """by, low, high: 95 % percentile interval of the median over replicates; a row is in a replicate as often as its count, once on average."""
    rows = poisson_rows(df.select(*by, value, key), key, reps, seed)
    medians = stats.quantiles(rows, [*by, "rep"], {"_m": (value, 0.5)})
    return medians.groupBy(*by).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))  # a value for each replicate


def places(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df with _place (from 1, the last one of equal orders) and _of (rows) within by, parted by ranges of the order, so that a hot group isn't ordered in one task."""
    counts = df.groupBy(*by, order).agg(F.count("*").alias("_c"))
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_of"))
    placed = stats.running(counts, by, order, "_c", "_place").drop("_c")
    placed = placed.join(F.broadcast(sizes), by) if by else placed.crossJoin(F.broadcast(sizes))
    return df.join(placed, [*by, order])


def stratified_split(df: DataFrame, stratum: str, key: str, share: float, seed: str) -> DataFrame:
    """df with part: ``fit`` for the first floor(share * n) rows of each stratum by hash, else ``check``."""
    placed = places(df.withColumn("_u", hash_uniform(seed, F.col(key))), [stratum], "_u")
    return placed.withColumn("part", F.when(F.col("_place") <= F.floor(F.lit(share) * F.col("_of")), "fit").otherwise("check")).drop("_u", "_place", "_of")


def contiguous_folds(df: DataFrame, order: str | list[str], k: int, by: list[str] | None = None) -> DataFrame:
    """df with fold 0..k-1: contiguous in the order (one column, a unique number), the first n % k folds one larger."""
    names = [order] if isinstance(order, str) else list(order)
    if len(names) != 1:
        raise ValueError("the order of folds is one column; make one of several first")
    placed = places(df, by or [], names[0])
    size, larger = F.floor(F.col("_of") / k), F.col("_of") % k
    before = F.col("_place") - 1
    fold = F.when(before < larger * (size + 1), F.floor(before / (size + 1))).otherwise(larger + F.floor((before - larger * (size + 1)) / F.greatest(size, F.lit(1))))
    return placed.withColumn("fold", fold.cast("int")).drop("_place", "_of")
