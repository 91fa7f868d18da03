"""Data mixtures (recipes) and the losses they lead to."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.functions.expr import hash_uniform, total
from mixlume.operators import moments, resample


def normalised(recipes: DataFrame, domains: list[str]) -> DataFrame:
    """Shares divided by their sum; fails on a sum that isn't positive."""
    s = total([F.col(m) for m in domains])
    sure = F.when(s > 0, s).otherwise(F.raise_error(F.lit("a recipe's shares must have a positive sum")).cast("double"))
    return recipes.withColumn("_s", sure).withColumns({m: F.col(m) / F.col("_s") for m in domains}).drop("_s")


def is_composition(domains: list[str], tolerance: float = 1e-9) -> Column:
    """Whether shares are present, not negative, and sum to 1 as they are (nothing is normalised silently)."""
    ok = total([F.col(m) for m in domains])
    every = F.forall(F.array(*[F.col(m) for m in domains]), lambda x: F.coalesce(~F.isnan(x) & (x >= 0), F.lit(False)))
    return every & F.coalesce(F.abs(ok - 1) < tolerance, F.lit(False))


def long(recipes: DataFrame, key: str, domains: list[str]) -> DataFrame:
    return recipes.select(key, *domains).unpivot([key], domains, "domain", "share")


def most_variable(recipes: DataFrame, domains: list[str], k: int) -> DataFrame:
    """domain, var of the k domains with the largest variance; no target is looked at."""
    row = recipes.agg(*[F.var_pop(m).alias(m) for m in domains])
    return row.unpivot([], domains, "domain", "var").orderBy(F.desc("var"), "domain").limit(k)


def interaction_names(domains: list[str]) -> list[str]:
    return [f"{a}_x_{b}" for a, b in combinations(domains, 2)]


def with_interactions(recipes: DataFrame, domains: list[str]) -> DataFrame:
    return recipes.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(domains, 2)})


def spread(domains: list[str]) -> list[Column]:
    """effective (exp of the entropy), domains (that have a share), largest share."""
    h = total([F.when(F.col(m) > 0, F.col(m) * F.ln(m)).otherwise(0.0) for m in domains])
    return [F.exp(-h).alias("effective"), total([(F.col(m) > 0).cast("int") for m in domains]).alias("domains"), F.greatest(*domains).alias("largest")]


def quality_coverage(shares: DataFrame, mapping: DataFrame, key: str = "idx") -> DataFrame:
    """key, quality (mean over domains of known quality), unknown_share, status. A domain with an inferred mapping keeps an unknown quality; mapping is a small parameter table."""
    joined = shares.join(F.broadcast(mapping), "domain", "left").withColumn("_q", F.when(F.col("mapping_type") != "inferred", F.col("quality")))
    known = F.sum(F.when(F.col("_q").isNotNull(), F.col("share")).otherwise(0.0))
    unknown = F.sum(F.when(F.col("_q").isNull(), F.col("share")).otherwise(0.0))
    out = joined.groupBy(key).agg(F.when(known > 0, F.sum(F.col("share") * F.col("_q")) / known).alias("quality"), unknown.alias("unknown_share"))
    return out.withColumn("status", F.when(F.col("unknown_share") > 1e-9, "PARTIAL_UNKNOWN").otherwise("COMPLETE"))


def composition_key(domains: list[str], digits: int = 6) -> Column:
    """Rounded shares as one text."""
    return F.concat_ws("|", *[(F.round(F.col(m), digits) * 10**digits).cast("long").cast("string") for m in domains])


def best_per_target(rows: DataFrame, key: str, targets: list[str]) -> DataFrame:
    long_form = rows.select(key, *targets).unpivot([key], targets, "target", "loss")
    return long_form.groupBy("target").agg(F.min_by(key, F.struct(F.round("loss", 9), F.col(key))).alias("best"), F.min("loss").alias("loss"))


def predict(recipes: DataFrame, domains: list[str], coefficients: dict[str, list[float]]) -> DataFrame:
    """recipes with each target's predicted loss and its change relative to the intercept; coefficients: intercept, then one for each domain."""
    out = {t: F.lit(c[0]) + total([F.col(m) * b for m, b in zip(domains, c[1:])]) for t, c in coefficients.items()}
    extra = [c for c in recipes.columns if c not in domains and c not in out]
    return recipes.select(*extra, *[v.alias(t) for t, v in out.items()], *[(v / coefficients[t][0] - 1).alias(f"rel_{t}") for t, v in out.items()])


def decide(predicted: DataFrame, key: str, a: str, b: str, weights: list[float], feasible: Column) -> DataFrame:
    """w, weighted_pick, minimax_pick, capped_pick: finite decisions for each weight of target a against b; ties go to the smaller key."""
    f = predicted.withColumn("w", F.explode(F.array(*[F.lit(w) for w in weights])))
    weighted, worst = F.round(F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b), 9), F.round(F.greatest(a, b), 9)
    return f.groupBy("w").agg(F.min_by(key, F.struct(weighted, F.col(key))).alias("weighted_pick"), F.min_by(key, F.struct(worst, F.col(key))).alias("minimax_pick"), F.min_by(F.when(feasible, F.col(key)), F.when(feasible, F.struct(weighted, F.col(key)))).alias("capped_pick"))


def heldout_choices(recipes: DataFrame, key: str, x: list[str], y: str, k: int, alpha: float) -> DataFrame:
    """fold, pick, realised_rank, regret: in each fold the row with the lowest prediction of a ridge fit on the other folds, and how it does among the fold's rows.

    Moments of the folds give all fits; each row is read once more, with its fold's few coefficients.
    """
    rows = resample.contiguous_folds(recipes, key, k).select(key, "fold", y, *x)
    train = moments.subtract_folds(moments.gram(rows, ["fold"], x, [y]).withColumn("one", F.lit(1)), ["one"])
    beta = moments.fit(train, ["fold"], x, [y], (alpha,)).groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("term", "beta"))).alias("_b"))
    scored = rows.join(F.broadcast(beta), "fold").withColumn("_p", F.col("_b")["intercept"] + total([F.col(c) * F.col("_b")[c] for c in x]))
    best = scored.groupBy("fold").agg(F.min_by(F.struct(F.col(key).alias("pick"), F.col(y).alias("y")), F.struct(F.round("_p", 9), F.col(key))).alias("_c"), F.min(y).alias("least"))
    return scored.join(F.broadcast(best), "fold").groupBy("fold", F.col("_c.pick").alias("pick"), (F.col("_c.y") - F.col("least")).alias("regret")).agg((F.count_if(F.col(y) < F.col("_c.y")) + 1).alias("realised_rank"))


def panel(rows: DataFrame, key: str, targets: list[str]) -> DataFrame:
    """z of each target (sample deviation), the worst one, and whether all improve on the mean."""
    params = rows.agg(*[F.avg(t).alias(f"_m{t}") for t in targets], *[F.stddev_samp(t).alias(f"_s{t}") for t in targets])
    z = rows.crossJoin(F.broadcast(params)).select(key, *[((F.col(t) - F.col(f"_m{t}")) / F.col(f"_s{t}")).alias(f"z_{t}") for t in targets])
    names = [f"z_{t}" for t in targets]
    every = F.forall(F.array(*names), lambda x: x < 0)
    return z.select("*", F.greatest(*names).alias("worst"), every.alias("all_improve"))


def subsample_picks(rows: DataFrame, key: str, loss: str, reps: int, seed: str) -> DataFrame:
    """pick, reps: how often each row is the best of a repeated 80 % subsample (by hash)."""
    r = rows.select(key, loss).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    placed = resample.places(r.withColumn("_u", hash_uniform(seed, F.col("rep"), F.col(key))), ["rep"], "_u")
    picks = placed.where(F.col("_place") <= F.floor(F.col("_of") * 8 / 10)).groupBy("rep").agg(F.min_by(key, F.struct(F.round(loss, 9), F.col(key))).alias("pick"))
    return picks.groupBy("pick").agg(F.count("*").alias("reps"))


def cross_validate(recipes: DataFrame, key: str, x: list[str], y: list[str], alphas: tuple[float, ...], k: int) -> DataFrame:
    """alpha, target, rmse: ridge by k folds. One pass gives the moments of each fold; training moments and test errors both follow from them."""
    folds = moments.gram(resample.contiguous_folds(recipes, key, k), ["fold"], x, y).withColumn("one", F.lit(1))
    train = moments.subtract_folds(folds, ["one"]).select("fold", F.col("g").alias("train"))
    both = folds.select("fold", "n", F.col("g").alias("test")).join(train, "fold")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                m = moments.matrix(list(r.test), 1 + len(x) + len(y))
                for alpha in alphas:
                    beta = moments.solve(list(r.train), len(x), len(y), alpha)
                    for j, t in enumerate(y):
                        v = np.zeros(len(m))
                        v[: 1 + len(x)], v[1 + len(x) + j] = beta[:, j], -1
                        rows.append((alpha, t, float(r.n), float(v @ m @ v)))
            yield pd.DataFrame(rows, columns=["alpha", "target", "n", "sse"])

    scored = both.mapInPandas(run, "alpha double, target string, n double, sse double")
    return scored.groupBy("alpha", "target").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))
