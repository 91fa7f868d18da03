"""Frozen quality scoring: fit scale, direction and score parameters once, apply them to any rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlume.functions import expr
from mixlume.operators import stats
from mixlume.sources.io import cut


def long_form(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")


def fit_scale(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, center, scale, n: one row for each metric."""
    return stats.robust_params(long_form(wide, [], metrics))


def apply_scale(wide: DataFrame, params: DataFrame, metrics: list[str], limit: float = 5.0) -> DataFrame:
    """Robust z of each metric by frozen parameters, clipped to ±limit; missing stays missing. params has a row for each metric: one row of a map is broadcast."""
    frozen = params.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("center", "scale")))).alias("_p"))
    p = lambda m: F.col("_p")[m]
    z = {m: expr.clip((F.col(m) - p(m)["center"]) / p(m)["scale"], -limit, limit) for m in metrics}
    return wide.crossJoin(F.broadcast(frozen)).select(*[z[c].alias(c) if c in z else F.col(c) for c in wide.columns])


def anchors(metrics: list[str]) -> Column:
    """An array with each metric's anchor: the mean of the other present metrics, NULL without one. Sums of arrays within Arrow batches: metrics² terms as column expressions outgrow compiled code."""

    @F.pandas_udf("array<double>")
    def means(values: pd.DataFrame) -> pd.Series:
        v = values.to_numpy(np.float64)
        here = ~np.isnan(v)
        v = np.where(here, v, 0.0)
        out = np.zeros_like(v)
        for i in range(v.shape[1]):
            for j in range(v.shape[1]):
                if i != j:
                    out[:, i] += v[:, j]
        n = here.sum(axis=1, keepdims=True) - here
        return pd.Series(list(np.where(n > 0, out / np.maximum(n, 1), np.nan)))

    return F.transform(means(F.struct(*[F.col(m).cast("double").alias(m) for m in metrics])), lambda x: F.nanvl(x, F.lit(None)))


def anchor_correlations(z: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """[by,] metric, n, rho: Spearman correlation of each metric with the mean of the others."""
    return weighted_correlations(z, metrics, F.array(F.lit(1)), 1, by).drop("k")


def weighted_correlations(z: DataFrame, metrics: list[str], weights: Column, size: int, by: list[str] | None = None) -> DataFrame:
    """[by,] k, metric, n, rho: anchor_correlations() under each weighting of the rows, the k-th of their ``size`` weights (whole numbers, NULL counts as 0); a row isn't exploded by them."""
    by = by or []
    anchored = z.select(*by, *metrics, anchors(metrics).alias("_anchors"), F.transform(weights, lambda w: F.coalesce(w, F.lit(0))).alias("_w"))
    anchored = cut(anchored, "anchors")
    entries = F.inline(F.array(*[F.struct(F.lit(i).alias("_metric"), F.col(m).cast("double").alias("value"), F.col("_anchors")[i].alias("anchor")) for i, m in enumerate(metrics)]))
    found = stats.spearmans(anchored.select(*by, "_w", entries), [*by, "_metric"], "value", "anchor", F.col("_w"), size)
    return found.select(*by, "k", F.element_at(F.array(*[F.lit(m) for m in metrics]), F.col("_metric") + 1).alias("metric"), "n", "rho")


def pool_correlations(per_domain: DataFrame, by: list[str]) -> DataFrame:
    """Fisher-z mean of correlations with weight n - 3; share of domains that agree with its sign; n below 4 is left out."""
    w = F.col("n") - 3
    ok = per_domain.where("rho is not null and n > 3").withColumn("_z", F.atanh(expr.clip(F.col("rho"), -0.999999, 0.999999)))
    pooled = ok.groupBy(*by).agg(F.tanh(F.sum(w * F.col("_z")) / F.sum(w)).alias("pooled_rho"), F.sum(F.signum("rho")).alias("_s"), F.count("*").alias("domains"), F.sum(w * F.col("_z") * F.col("_z")).alias("_q"), (F.sum(w * F.col("_z")) * F.sum(w * F.col("_z")) / F.sum(w)).alias("_m"))
    agree = (F.col("domains") + F.signum("pooled_rho") * F.col("_s")) / (2 * F.col("domains"))
    return pooled.select(*by, "domains", "pooled_rho", agree.alias("sign_agreement"), F.greatest(F.col("_q") - F.col("_m"), F.lit(0.0)).alias("heterogeneity"))


def directions(correlations: DataFrame) -> DataFrame:
    """metric, sign: +1 or -1 by the correlation; missing or 0 counts as +1, so that no sign is 0."""
    return correlations.select("metric", F.when(F.col("rho") < 0, -1).otherwise(1).alias("sign"))


def orient(z: DataFrame, signs: DataFrame, metrics: list[str]) -> DataFrame:
    """Each metric times its frozen sign. Fails unless there is exactly one sign of ±1 for each metric."""
    known = F.map_from_entries(F.collect_list(F.struct("metric", "sign")))
    frozen = signs.agg(known.alias("_s"), F.count("*").alias("_n"), F.count_if(F.col("sign").isin(-1, 1)).alias("_ok"))
    bad = (F.col("_n") != len(metrics)) | (F.col("_ok") != len(metrics))
    sign = lambda m: F.when(bad, F.raise_error(F.lit("signs must be -1 or 1, one for each metric")).cast("int")).otherwise(F.coalesce(F.col("_s")[m], F.raise_error(F.lit(f"no sign for {m}")).cast("int")))
    return z.crossJoin(F.broadcast(frozen)).select(*[(F.col(c) * sign(c)).alias(c) if c in metrics else F.col(c) for c in z.columns])


def family_scores(oriented: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Adds score_<family> (mean of present metrics), family_mean (mean of present families) and equal_mean (mean of all present metrics)."""
    out = oriented.select("*", *[expr.mean_present([F.col(m) for m in ms]).alias(f"score_{f}") for f, ms in families.items()])
    every = [m for ms in families.values() for m in ms]
    return out.withColumns({"family_mean": expr.mean_present([F.col(f"score_{f}") for f in families]), "equal_mean": expr.mean_present([F.col(m) for m in every])})


def score_params(scored: DataFrame, column: str = "family_mean") -> DataFrame:
    """mean, sd (population; 1 if it is 0): what freezes the score's scale."""
    return scored.agg(F.avg(column).alias("mean"), F.coalesce(F.nullif(F.stddev_pop(column), F.lit(0.0)), F.lit(1.0)).alias("sd"))


def freeze_scores(scored: DataFrame, params: DataFrame, column: str = "family_mean", out: str = "quality") -> DataFrame:
    return scored.crossJoin(F.broadcast(params)).withColumn(out, (F.col(column) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def subset_families(families: dict[str, list[str]], included: list[str]) -> tuple[dict[str, list[str]], list[str]]:
    """(families restricted to the included metrics, names of those that are empty then)."""
    kept = {f: [m for m in ms if m in included] for f, ms in families.items()}
    return {f: ms for f, ms in kept.items() if ms}, [f for f, ms in kept.items() if not ms]


def domain_summary(scored: DataFrame, by: str = "domain", value: str = "quality", other: str = "equal_mean") -> DataFrame:
    """Rows, medians and 10 % trimmed mean of each domain."""
    base = scored.groupBy(by).agg(F.count(value).alias("n")).join(stats.quantiles(scored, [by], {"median_quality": (value, 0.5), "median_equal": (other, 0.5)}), by)
    return base.join(stats.trimmed_mean(scored, [by], value), by, "left")


def decide(q: Column, d: Column, q_cut: Column, d_cut: Column) -> Column:
    """Keep, flag or put low, with a state of its own for what is missing."""
    return (
        F.when(q.isNull() & d.isNull(), "REVIEW_MISSING_Q_AND_D").when(q.isNull(), "REVIEW_MISSING_Q").when(d.isNull(), "REVIEW_MISSING_D")
        .when((q >= q_cut) & (d < d_cut), "RETAIN").when(q >= q_cut, "RETAIN_FLAG_REVIEW").when(d < d_cut, "LOW_PRIORITY").otherwise("LOW_PRIORITY_REVIEW")
    )


def leave_one_domain_out(z: DataFrame, metrics: list[str], domains: list[str]) -> DataFrame:
    """held_out, metric, n, rho: directions refitted without each domain in turn; rows without a domain take no part."""
    found = weighted_correlations(z, metrics, F.array(*[(F.col("domain") != d).cast("int") for d in domains]), len(domains))
    return found.select(F.element_at(F.array(*[F.lit(d) for d in domains]), F.col("k") + 1).alias("held_out"), "metric", "n", "rho")


def domain_balanced(scored: DataFrame, value: str = "quality", by: str = "domain") -> DataFrame:
    """Mean and population deviation with equal total weight for each domain."""
    per = scored.where(F.col(value).isNotNull()).groupBy(by).agg(F.avg(value).alias("_m"), F.avg(F.col(value) * F.col(value)).alias("_s"))
    return per.agg(F.avg("_m").alias("mean"), F.sqrt(F.avg("_s") - F.avg("_m") * F.avg("_m")).alias("sd"), F.count("*").alias("domains"))


def weight_grid(step_count: int = 20) -> list[tuple[float, float, float]]:
    """All weights of three families in steps of 1/step_count."""
    return [(i / step_count, j / step_count, (step_count - i - j) / step_count) for i in range(step_count + 1) for j in range(step_count + 1 - i)]


def family_weight_grid(scored: DataFrame, families: list[str], by: str = "domain", step_count: int = 20) -> DataFrame:
    """grid_id, domain, median, rank (1 is best) of each domain under each weighting; complete rows only."""
    grid = [F.struct(F.lit(k).alias("grid_id"), *[F.lit(w).alias(f"w{i}") for i, w in enumerate(ws)]) for k, ws in enumerate(weight_grid(step_count))]
    value = expr.total([F.col(f"g.w{i}") * F.col(f"score_{f}") for i, f in enumerate(families)])
    rows = scored.dropna(subset=[f"score_{f}" for f in families]).select(by, *[f"score_{f}" for f in families], F.explode(F.array(*grid)).alias("g"))
    medians = stats.quantiles(rows.select(by, F.col("g.grid_id").alias("grid_id"), value.alias("v")), ["grid_id", by], {"median": ("v", 0.5)})
    return medians.withColumn("rank", F.rank().over(Window.partitionBy("grid_id").orderBy(F.desc("median"))))


def rank_envelope(z: DataFrame, signs: DataFrame, families: dict[str, list[str]], by: str = "domain", primary: int = 0) -> DataFrame:
    """by, n, rank, rank_min, rank_median, rank_max, median_min, median_max: how far the ranks of domains move when directions are refitted.

    signs: rep, metric, sign of each replicate (replicates x metrics, one row is broadcast); the replicate ``primary`` gives n (rows with a score) and rank. Each row is scored by
    every replicate's directions (family_mean); a domain's place is that of its median score, 1 for the best, equal to nine digits shares the better one.
    The envelope is over the other replicates. A metric without a sign fails; domains without any score have no row.
    """
    metrics = [m for ms in families.values() for m in ms]
    one = signs.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("metric", "sign"))).alias("s")).agg(F.collect_list(F.struct("rep", "s")).alias("_r"))
    drawn = z.select(by, *metrics).crossJoin(F.broadcast(one)).withColumn("_e", F.explode("_r"))
    sign = lambda m: F.coalesce(F.col("_e.s")[m], F.raise_error(F.lit(f"no sign for {m}")).cast("int"))
    turned = drawn.select(by, F.col("_e.rep").alias("rep"), *[(F.col(m) * sign(m)).alias(m) for m in metrics])
    scores = cut(family_scores(turned, families).where("family_mean is not null").select(by, "rep", "family_mean"), "turned")
    medians = stats.quantiles(scores, ["rep", by], {"_m": ("family_mean", 0.5)}).join(scores.groupBy("rep", by).agg(F.count("*").alias("_n")), ["rep", by])
    placed = medians.withColumn("_k", F.rank().over(Window.partitionBy("rep").orderBy(F.desc(F.round("_m", 9)))))  # a row for each domain
    own, c = F.col("rep") == primary, F.col
    other = lambda name: F.when(~own, c(name))
    return placed.groupBy(by).agg(
        F.max(F.when(own, c("_n"))).alias("n"), F.max(F.when(own, c("_k"))).alias("rank"), F.min(other("_k")).alias("rank_min"), F.percentile(other("_k"), 0.5).alias("rank_median"), F.max(other("_k")).alias("rank_max"),
        F.min(other("_m")).alias("median_min"), F.max(other("_m")).alias("median_max"),
    )


def direction_rules(whole: DataFrame, replicates: DataFrame, by_domain: DataFrame, left_out: DataFrame, missing: DataFrame, families: dict[str, list[str]], weak: float = 0.05) -> DataFrame:
    """metric, rho, sign, weight, flip_rate, domain_agreement, loo_flip, missing_rate, weak_or_unstable: all evidence on each metric's direction.

    whole: metric, rho; replicates: rep, metric, rho; by_domain: domain, metric, rho; left_out: held_out, metric, rho; missing: metric, missing_rate. A metric's weight is its share
    of the family-balanced mean. A missing rho counts as a positive direction. Unstable: a correlation below ``weak``, a flip when a domain is left out, or flips in more than 5 % of the replicates.
    """
    turned = lambda df, name, agg: df.join(whole.select("metric", F.col("rho").alias("_w")), "metric").groupBy("metric").agg(agg((F.coalesce(F.col("rho") < 0, F.lit(False)) != F.coalesce(F.col("_w") < 0, F.lit(False)))).alias(name))
    share = lambda b: F.avg(b.cast("int"))
    out = whole.select("metric", "rho", F.when(F.col("rho") < 0, -1).otherwise(1).alias("sign"))
    weights = F.coalesce(*[F.when(F.col("metric").isin(ms), 1 / (len(families) * len(ms))) for ms in families.values()])
    out = out.withColumn("weight", weights)
    for part in (turned(replicates, "flip_rate", share), turned(by_domain, "_d", share), turned(left_out, "loo_flip", F.bool_or), missing.select("metric", "missing_rate")):
        out = out.join(part, "metric", "left")
    unstable = (F.coalesce(F.abs("rho"), F.lit(1.0)) < weak) | F.coalesce("loo_flip", F.lit(False)) | (F.coalesce("flip_rate", F.lit(0.0)) > 0.05)
    return out.select("metric", "rho", "sign", "weight", "flip_rate", (1 - F.col("_d")).alias("domain_agreement"), "loo_flip", "missing_rate", unstable.alias("weak_or_unstable"))
