"""Least squares from sums of products: one distributed pass gives the moments of any number of groups and folds; only small systems are solved."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, by: list[str], x: list[str], y: list[str], weight: Column | None = None) -> DataFrame:
    """by, n, g: sums of products of (1, x..., y...) over complete rows, as the flat upper triangle g."""
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in [*x, *y]]]
    w = F.lit(1.0) if weight is None else weight
    rows = df.dropna(subset=[*x, *y])
    sums = [F.sum(w * names[i] * names[j]) for i in range(len(names)) for j in range(i, len(names))]
    aggs = [F.count("*").alias("n"), F.array(*sums).alias("g")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def subtract_folds(folds: DataFrame, by: list[str], fold: str = "fold") -> DataFrame:
    """by, fold, n, g of the training part of each fold: the total less the fold, so that no row is read again."""
    spread = folds.select(*by, fold, "n", F.posexplode("g").alias("_k", "_v"))
    total = spread.groupBy(*by, "_k").agg(F.sum("_v").alias("_t"), F.sum("n").alias("_n"))
    rest = spread.join(total, [*by, "_k"]).select(*by, fold, (F.col("_n") - F.col("n")).alias("n"), "_k", (F.col("_t") - F.col("_v")).alias("_v"))
    return rest.groupBy(*by, fold, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("g"))


def matrix(g: list[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = g
    return out + np.triu(out, 1).T


def solve(g: list[float], x: int, y: int, alpha: float = 0.0) -> np.ndarray:
    """Coefficients (1 + x, y) of centred ridge regression from moments; fails on a rank-deficient system without ridge."""
    m = matrix(g, 1 + x + y)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - n * np.outer(mean, mean)
    a = c[:x, :x] + alpha * np.eye(x)
    if not alpha and np.linalg.matrix_rank(a, tol=1e-9 * max(1.0, abs(a).max())) < x:
        raise ValueError("rank-deficient design")
    beta = np.linalg.solve(a, c[:x, x:])
    return np.vstack([mean[x:] - mean[:x] @ beta, beta])


def fit(moments: DataFrame, by: list[str], x: list[str], y: list[str], alphas: tuple[float, ...] = (0.0,)) -> DataFrame:
    """by, alpha, target, term, beta: each row of moments solved where it is (a grouped map over sums, never over raw rows)."""
    kinds = ", ".join(f"{c} {dict(moments.dtypes)[c]}" for c in by)
    terms = ["intercept", *x]

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for alpha in alphas:
                    beta = solve(list(r.g), len(x), len(y), alpha)
                    rows += [(*[getattr(r, c) for c in by], float(alpha), t, term, float(beta[i, j])) for j, t in enumerate(y) for i, term in enumerate(terms)]
            yield pd.DataFrame(rows, columns=[*by, "alpha", "target", "term", "beta"])

    return moments.select(*by, "g").mapInPandas(run, (kinds + ", " if by else "") + "alpha double, target string, term string, beta double")


def slope(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """by, n, slope, intercept of one-variable least squares; NULL for a constant x."""
    aggs = [F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")]
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
