"""Conflict between quality signals: pairwise correlations, a replicated conflict graph, and each record's degree of conflict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.operators import stats
from mixlume.sources.io import cut

#: Rows below which a pair has no correlation.
LEAST_ROWS = 30


def metric_pairs(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """ids, metric_a, metric_b, a, b: each unordered pair of metrics of each record (a narrow explode, not a join)."""
    pairs = [F.struct(F.lit(x).alias("metric_a"), F.lit(y).alias("metric_b"), F.col(x).alias("a"), F.col(y).alias("b")) for i, x in enumerate(sorted(metrics)) for y in sorted(metrics)[i + 1 :]]
    return wide.select(*ids, F.explode(F.array(*pairs)).alias("p")).select(*ids, "p.*")


def pair_counts(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """metric_a, metric_b, rows, n_a, n_b, a_below (rows with a < b) over metric_pairs() of all rows: each task counts its rows' pairs and sends one row for each pair."""
    names = sorted(metrics)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, present, below = 0, np.zeros(len(names), np.int64), np.zeros(len(pairs), np.int64)
        for batch in batches:
            v = batch.to_numpy(np.float64)
            rows, present = rows + len(v), present + (~np.isnan(v)).sum(axis=0)
            below += [np.count_nonzero(v[:, i] < v[:, j]) for i, j in pairs]
        if rows:
            yield pd.DataFrame([(names[i], names[j], rows, present[i], present[j], n) for (i, j), n in zip(pairs, below)], columns=["metric_a", "metric_b", "rows", "n_a", "n_b", "a_below"])

    parts = wide.select(*[F.col(m).cast("double").alias(m) for m in names]).mapInPandas(run, "metric_a string, metric_b string, rows long, n_a long, n_b long, a_below long")
    return parts.groupBy("metric_a", "metric_b").agg(*[F.sum(c).alias(c) for c in ("rows", "n_a", "n_b", "a_below")])


def missing_classes(wide: DataFrame, metrics: list[str]) -> dict[str, str]:
    """For each metric the first metric that is present in exactly the same rows (itself, if there is none before it)."""
    pairs = [(x, y) for i, x in enumerate(metrics) for y in metrics[:i]]
    row = wide.agg(*[F.coalesce(F.bool_and(F.col(x).isNull() == F.col(y).isNull()), F.lit(True)) for x, y in pairs]).first()  # one row of few hundred flags
    out = {m: m for m in metrics}
    for (x, y), same in zip(pairs, row):
        if same and metrics.index(y) < metrics.index(out[x]):
            out[x] = y
    return out


def pair_correlations(wide: DataFrame, metrics: list[str], by: list[str] | None = None, key: str = "id") -> DataFrame:
    """[by,] metric_a, metric_b, n, rho (Spearman) over pairwise complete rows; NULL for fewer than LEAST_ROWS rows or a constant side.

    A metric's ranks among the rows that another one shares with it depend on that one's missing rows alone. So each metric is ranked once for each class of
    metrics that are missing together, not once for each pair; the ranks of a row (key: its unique name) come together again, and its pairs are summed up
    before the shuffle.
    """
    by = by or []
    names = sorted(metrics)
    classes = missing_classes(wide, names)
    heads = sorted(set(classes.values()))
    cells = [F.when(F.col(m).isNotNull() & F.col(h).isNotNull(), F.struct(F.lit(i * len(heads) + j).alias("_cell"), F.col(m).cast("double").alias("_v"))) for i, m in enumerate(names) for j, h in enumerate(heads)]
    long_form = cut(wide.select(key, *by, F.inline(F.array_compact(F.array(*cells)))), "cells")
    ranked = stats.average_ranks(long_form, [*by, "_cell"], "_v", "_r")
    rows = ranked.groupBy(key, *by).agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_r"))).alias("_m"))
    place = lambda m, other: names.index(m) * len(heads) + heads.index(classes[other])
    pairs = wide.sparkSession.createDataFrame([(x, y, place(x, y), place(y, x)) for i, x in enumerate(names) for y in names[i + 1 :]], "metric_a string, metric_b string, _a int, _b int")
    each = rows.crossJoin(F.broadcast(pairs)).select(*by, "metric_a", "metric_b", F.element_at("_m", F.col("_a")).alias("a"), F.element_at("_m", F.col("_b")).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    a, b = F.when(both, F.col("a")), F.when(both, F.col("b"))
    out = each.groupBy(*by, "metric_a", "metric_b").agg(F.count(a).alias("n"), stats.correlation(a, b).alias("rho")).where("n > 0")
    return out.withColumn("rho", F.when(F.col("n") >= LEAST_ROWS, F.col("rho")))


def t_tail(rho: Column, n: Column) -> Column:
    """Two-sided p value of a correlation by Student's t, integrated numerically on the few rows of a pair table."""

    @F.pandas_udf("double")
    def tail(r: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for x, k in zip(r, m):
            if pd.isna(x) or k < 3:
                out.append(None)
                continue
            df = k - 2
            # With t = sqrt(df) tan(u), the tail is an integral of cos(u)^(df - 1) from u to pi/2.
            edge = float(np.arctan2(abs(x), np.sqrt(max(0.0, 1 - x * x))))
            grid = np.linspace(0, np.pi / 2, 20001)
            f = np.cos(grid) ** (df - 1)
            whole, part = np.trapezoid(f, grid), np.trapezoid(np.where(grid >= edge, f, 0), grid)
            out.append(float(part / whole))
        return pd.Series(out, dtype="float64")

    return tail(rho, n)


def tested_pairs(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pairs with p, q (Benjamini-Hochberg within by) and conflict (q <= 0.05 and rho < 0)."""
    tested = stats.benjamini_hochberg(pairs.withColumn("p", t_tail(F.col("rho"), F.col("n"))), "p", by)
    return tested.withColumn("conflict", F.coalesce((F.col("q") <= 0.05) & (F.col("rho") < 0), F.lit(False)))


def domain_strength(per_domain: DataFrame) -> DataFrame:
    """metric_a, metric_b: domains, mean, min and max correlation over domains, and strength max(0, -mean)."""
    return per_domain.where("rho is not null").groupBy("metric_a", "metric_b").agg(
        F.count("*").alias("domains"), F.avg("rho").alias("mean_rho"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"), F.greatest(F.lit(0.0), -F.avg("rho")).alias("strength"), F.count_if(F.col("rho") < 0).alias("negative_domains")
    )


def conflict_graph(pooled: DataFrame, per_domain: DataFrame, elsewhere: DataFrame, domain: str, scope: str, least: int = 4) -> DataFrame:
    """Each pooled pair with its support: metric_a, metric_b, rho, q, conflict, domains_negative, domains_significant, domains_valid, scopes_valid, scopes_replicated, stable, cause.

    All three are tables of tested_pairs(): of all rows, within each domain of them, and of each scope of rows that aren't among them. domains_significant and scopes_replicated count
    significant negative pairs, the valid ones pairs with a correlation. stable: significant and negative here and in some scope elsewhere. cause, of significant domains:
    ``multi_domain`` (``least`` or more), ``pooled_only`` (none), ``domain_specific``. Rows without domain or scope take no part. Tables hold pairs of metrics, not records.
    """
    pair, c = ["metric_a", "metric_b"], F.col
    inside = per_domain.where(c(domain).isNotNull()).groupBy(*pair).agg(F.count_if(c("rho") < 0).alias("domains_negative"), F.count_if("conflict").alias("domains_significant"), F.count("rho").alias("domains_valid"))
    outside = elsewhere.where(c(scope).isNotNull()).groupBy(*pair).agg(F.count("rho").alias("scopes_valid"), F.count_if("conflict").alias("scopes_replicated"))
    counts = ["domains_negative", "domains_significant", "domains_valid", "scopes_valid", "scopes_replicated"]
    out = pooled.select(*pair, "rho", "q", "conflict").join(inside, pair, "left").join(outside, pair, "left").fillna(0, counts)
    cause = F.when(c("domains_significant") >= least, "multi_domain").when(c("domains_significant") == 0, "pooled_only").otherwise("domain_specific")
    return out.select(*pair, "rho", "q", "conflict", *counts, (c("conflict") & (c("scopes_replicated") > 0)).alias("stable"), cause.alias("cause"))


def replicated_edges(strength: DataFrame) -> DataFrame:
    """metric_a, metric_b, weight of the pairs that are negative in each domain of domain_strength()."""
    return strength.where("negative_domains = domains").select("metric_a", "metric_b", F.col("strength").alias("weight"))


def conflict_degree(wide: DataFrame, edges: list[tuple[str, str, float]]) -> Column:
    """Mean gap |a - b| over the edges whose metrics are both present, weighted by the edge; NULL without such an edge. The edge list is a frozen parameter."""
    usable = [(F.col(a).isNotNull() & F.col(b).isNotNull(), F.abs(F.col(a) - F.col(b)), w) for a, b, w in edges]
    if not usable:
        return F.lit(None).cast("double")
    top = sum((F.when(ok, gap * w).otherwise(0.0) for ok, gap, w in usable), F.lit(0.0))
    weight = sum((F.when(ok, F.lit(w)).otherwise(0.0) for ok, _, w in usable), F.lit(0.0))
    return F.when(weight > 0, top / weight)
