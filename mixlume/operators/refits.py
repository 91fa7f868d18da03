"""Interaction models with a chosen ridge, refitted on repeated subsamples, and what the refits choose: sums of products of every repeat and fold in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlume.functions.expr import hash_uniform
from mixlume.operators import resample, stats

#: Ridges to choose from.
ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0)
FOLDS, DIGITS = 5, 9
_FITS = "rep int, target string, alpha double, cv_rmse double, varied array<string>, center array<double>, beta array<double>"


def _bounds(rows: DataFrame, key: str, reps: int, share: float, seed: str) -> list[float]:
    """For each repeat 1..reps the largest hash among the floor(share * n) smallest ones; 2 for repeat 0, which has all rows."""
    drawn = rows.select(key).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).select("rep", hash_uniform(seed, F.col("rep"), F.col(key)).alias("u"))
    counts = drawn.groupBy("rep", "u").agg(F.count("*").alias("c"))
    placed = stats.running(counts, ["rep"], "u", "c", "place")
    sizes = counts.groupBy("rep").agg(F.sum("c").alias("n"))
    found = placed.join(F.broadcast(sizes), "rep").where(F.col("place") <= F.floor(F.lit(share) * F.col("n"))).groupBy("rep").agg(F.max("u").alias("u"))  # a row for each repeat
    at = {r["rep"]: r["u"] for r in found.collect()}
    return [2.0, *[at.get(r, -1.0) for r in range(1, reps + 1)]]


def _design(x: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.column_stack([x, *[x[:, a] * x[:, b] for a, b in pairs]]) if pairs else x


def _solve(m: np.ndarray, k: int, alpha: float) -> np.ndarray:
    """(1 + k, targets): intercept and coefficients of a centred ridge regression from sums of products of (1, x, y)."""
    mean = m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - m[0, 0] * np.outer(mean, mean)
    beta = np.linalg.solve(c[:k, :k] + alpha * np.eye(k), c[:k, k:])
    return np.vstack([mean[k:] - mean[:k] @ beta, beta])


def fits(rows: DataFrame, key: str, domains: list[str], targets: list[str], reps: int = 0, share: float = 0.8, seed: str = "refit", varied: int = 5, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """rep, target, alpha, cv_rmse, varied, center, beta: shares and products of the most variable ones, a ridge chosen by the mean RMSE of folds (the first of equals), and the fit on all folds.

    Repeat 0 has all rows, repeats 1..reps a subsample of floor(share * n) rows by hash. Each repeat chooses its most variable domains itself. Folds are contiguous in
    the key's order over all rows, so a subsample's folds differ a little in size. beta: intercept, domains, products of ``varied`` in order; center: mean shares.
    Rows with a missing or infinite share, target or key are left out; no row, no fit; folds that a subsample leaves empty are passed over.

    Rows are read three times whatever the number of repeats: for bounds of hashes, for variances, and for sums of products, which tasks add up for all repeats.
    """
    numbers = [F.col(c).cast("double") for c in [*domains, *targets]]
    whole = rows.where(F.col(key).isNotNull() & F.forall(F.array(*numbers), lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))))
    bounds = _bounds(whole, key, reps, share, seed) if reps else [2.0]
    hashes = F.array(F.lit(0.0), *[hash_uniform(seed, r, F.col(key)) for r in range(1, reps + 1)])
    wide = resample.contiguous_folds(whole.select(key, *[v.alias(c) for v, c in zip(numbers, [*domains, *targets])]), key, FOLDS).select(
        "fold", F.array(*domains).alias("x"), F.array(*targets).alias("y"), hashes.alias("u")
    )
    n, k = len(domains), min(varied, len(domains))
    inside = [F.col("u")[r] <= b for r, b in enumerate(bounds)]
    spreads = wide.agg(*[F.array(*[F.var_pop(F.when(i, F.col("x")[j])) for j in range(n)]).alias(f"v{r}") for r, i in enumerate(inside)]).first()
    chosen = [sorted(sorted(range(n), key=lambda j: (-(spreads[r][j] or 0.0), j))[:k]) for r in range(len(bounds))]
    products = [list(combinations(c, 2)) for c in chosen]
    size = 1 + n + k * (k - 1) // 2 + len(targets)
    upper = np.triu_indices(size)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.empty:
                continue
            x, y, u = (np.stack(batch[c].to_numpy()).astype(float) for c in "xyu")
            fold = batch["fold"].to_numpy()
            for r, bound in enumerate(bounds):
                z = np.column_stack([np.ones(len(x)), _design(x, products[r]), y])
                for f in np.unique(fold):
                    part = z[(fold == f) & (u[:, r] <= bound)]
                    if len(part):
                        sums[r, f] = sums.get((r, f), 0) + part.T @ part
        if sums:
            yield pd.DataFrame([(r, int(f), m[upper].tolist()) for (r, f), m in sums.items()], columns=["rep", "fold", "g"])

    parts = wide.mapInPandas(add, "rep int, fold int, g array<double>").select("rep", "fold", F.posexplode("g").alias("k", "v")).groupBy("rep", "fold", "k").agg(F.sum("v").alias("v"))
    grams = parts.groupBy("rep", "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("g")).groupBy("rep").agg(F.collect_list("g").alias("g"))  # at most FOLDS arrays a repeat

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rep, flat in zip(batch["rep"], batch["g"]):
                cells = []
                for g in flat:
                    m = np.zeros((size, size))
                    m[upper] = g
                    cells.append(m + np.triu(m, 1).T)
                all_rows, features = sum(cells), size - 1 - len(targets)
                scores = np.full((len(alphas), len(targets)), np.inf)
                for a, alpha in enumerate(alphas):
                    errors = []
                    for cell in cells if len(cells) > 1 else []:
                        beta, v = _solve(all_rows - cell, features, alpha), np.zeros((size, len(targets)))
                        v[: 1 + features], v[1 + features :] = beta, -np.eye(len(targets))
                        errors.append(np.sqrt(np.maximum(np.einsum("it,ij,jt->t", v, cell, v), 0) / cell[0, 0]))
                    if errors:
                        scores[a] = np.mean(errors, axis=0)
                for t, name in enumerate(targets):
                    a = int(np.argmin(np.round(scores[:, t], 12)))
                    beta = _solve(all_rows, features, alphas[a])[:, t]
                    error = float(scores[a, t]) if np.isfinite(scores[a, t]) else None
                    out.append((rep, name, alphas[a], error, [domains[j] for j in chosen[rep]], (all_rows[0, 1 : 1 + n] / all_rows[0, 0]).tolist(), beta.tolist()))
            yield pd.DataFrame(out, columns=["rep", "target", "alpha", "cv_rmse", "varied", "center", "beta"])

    return grams.mapInPandas(solve, _FITS)


def coefficients(fitted: DataFrame, domains: list[str]) -> DataFrame:
    """rep, target, alpha, cv_rmse, term, beta of fits()."""
    pairs = F.flatten(F.transform("varied", lambda a, i: F.transform(F.slice("varied", i + 2, F.size("varied")), lambda b: F.concat_ws("_x_", a, b))))
    terms = F.concat(F.array(*[F.lit(t) for t in ["intercept", *domains]]), pairs)
    return fitted.select("rep", "target", "alpha", "cv_rmse", F.inline(F.arrays_zip(terms.alias("term"), F.col("beta").alias("beta"))))


def choices(rows: DataFrame, key: str, domains: list[str], targets: list[str], fitted: DataFrame, policies: dict[str, tuple[str, Column]]) -> DataFrame:
    """rep, policy, pick, frozen_pick, same, refit_regret, frozen_regret for repeats from 1.

    A recipe's score is the ``mean`` or ``max`` (policies: name -> (kind, condition)) over targets of its prediction divided by the mean recipe's, less one. Each
    repeat picks the feasible recipe of the lowest score (to nine digits, then the smallest key); repeat 0's pick is the frozen one. refit_regret: how much worse the
    frozen pick is by the repeat's scores; frozen_regret: how much worse the repeat's pick is by repeat 0's. Policies that no recipe meets give no row.

    Models (repeats x targets) are gathered and sent to tasks; a task keeps one row for each repeat and policy.
    """
    models = sorted(fitted.collect(), key=lambda r: (r["rep"], targets.index(r["target"])))  # repeats x targets
    reps = sorted({r["rep"] for r in models})
    n, kinds = len(domains), [kind for kind, _ in policies.values()]
    beta = {rep: np.array([m["beta"] for m in models if m["rep"] == rep]).T for rep in reps}
    own = {rep: next(m for m in models if m["rep"] == rep) for rep in reps}
    pairs = {rep: list(combinations([domains.index(v) for v in own[rep]["varied"]], 2)) for rep in reps}

    def scores(rep: int, x: np.ndarray) -> np.ndarray:
        """(policies' kinds, rows)"""
        at = np.vstack([x, [own[rep]["center"]]])
        p = np.column_stack([np.ones(len(at)), _design(at, pairs[rep])]) @ beta[rep]
        relative = p[:-1] / p[-1] - 1
        return np.round(np.array([relative.mean(axis=1) if kind == "mean" else relative.max(axis=1) for kind in kinds]), DIGITS)

    wide = rows.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in domains]).alias("x"), F.array(*[F.coalesce(c, F.lit(False)) for _, c in policies.values()]).alias("ok"))
    wide = wide.where(F.col("key").isNotNull() & F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.sort_values("key", kind="stable")
            x, ok, keys = np.stack(batch["x"].to_numpy()).astype(float), np.stack(batch["ok"].to_numpy()).astype(bool), batch["key"].to_numpy()
            for rep in reps:
                for p, s in enumerate(scores(rep, x)):
                    met = np.flatnonzero(ok[:, p] & np.isfinite(s))
                    if len(met):
                        i = met[s[met].argmin()]
                        found = (float(s[i]), keys[i], x[i].tolist())
                        held[rep, p] = min(held.get((rep, p), found), found, key=lambda v: v[:2])
        if held:
            yield pd.DataFrame([(*at, *v) for at, v in held.items()], columns=["rep", "p", "score", "key", "x"])

    kind = wide.schema["key"].dataType.simpleString()
    found = wide.mapInPandas(best, f"rep int, p int, score double, key {kind}, x array<double>").groupBy("rep", "p").agg(F.min_by(F.struct("key", "score", "x"), F.struct("score", "key")).alias("b"))
    picks = {(r["rep"], r["p"]): r["b"] for r in found.collect()} if models else {}  # repeats x policies
    out = []
    for (rep, p), b in sorted(picks.items()):
        frozen = picks[0, p]
        if rep:
            refit = scores(rep, np.array([frozen["x"]]))[p][0] - b["score"]
            out.append((rep, list(policies)[p], b["key"], frozen["key"], b["key"] == frozen["key"], float(refit), float(scores(0, np.array([b["x"]]))[p][0] - frozen["score"])))
    key_type = wide.schema["key"].dataType
    fields = [("rep", T.IntegerType()), ("policy", T.StringType()), ("pick", key_type), ("frozen_pick", key_type), ("same", T.BooleanType()), ("refit_regret", T.DoubleType()), ("frozen_regret", T.DoubleType())]
    return rows.sparkSession.createDataFrame(out, T.StructType([T.StructField(*f) for f in fields]))


def summary(chosen: DataFrame) -> DataFrame:
    """policy, frozen_pick, repeats, same_share, distinct_picks, median_regret, max_regret of choices()."""
    return chosen.groupBy("policy", "frozen_pick").agg(
        F.count("*").alias("repeats"), F.avg(F.col("same").cast("int")).alias("same_share"), F.count_distinct("pick").alias("distinct_picks"), F.percentile("refit_regret", 0.5).alias("median_regret"), F.max("refit_regret").alias("max_regret")
    )
