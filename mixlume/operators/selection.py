"""Choice of a row under many weightings of its targets: scenarios drawn from hashes, the best row of each, and how stable the choice is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlume.functions.expr import hash_uniform

#: Tries of the rejection step of a gamma draw below 1; each is accepted with probability 0.79 at least, so that all fail with probability below 1e-8.
TRIES = 12
#: Digits to which objectives are rounded before ties are broken by the key.
DIGITS = 9


def _exponential(*parts: Column | int | str) -> Column:
    return -F.ln(1 - hash_uniform(*parts))


def gamma_draw(shape: float | int, *parts: Column | int | str) -> Column:
    """A gamma draw from hashes of parts: a sum of exponentials for a whole shape, an exponential times a beta draw (Jöhnk) for a shape below 1."""
    if shape == int(shape) and shape >= 1:
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(int(shape) - 1)), lambda k: _exponential(*parts, k)), F.lit(0.0), lambda a, x: a + x)
    if not 0 < shape < 1:
        raise ValueError("shape must be whole or below 1")
    tries = F.transform(
        F.sequence(F.lit(0), F.lit(TRIES - 1)),
        lambda k: F.struct(F.pow(hash_uniform(*parts, "x", k), F.lit(1 / shape)).alias("x"), F.pow(hash_uniform(*parts, "y", k), F.lit(1 / (1 - shape))).alias("y")),
    )
    first = F.get(F.filter(tries, lambda v: (v["x"] + v["y"] <= 1) & (v["x"] > 0)), F.lit(0))
    return _exponential(*parts, "e") * F.coalesce(first["x"] / (first["x"] + first["y"]), F.lit(shape))


def weight_scenarios(spark: SparkSession, targets: list[str], sparse: float = 0.2, balanced: int = 5, draws: int = 100) -> DataFrame:
    """scenario, w (array in the order of targets, sum 1): equal weights, each target alone, and ``draws`` sparse and balanced Dirichlet draws."""
    fixed = [("equal", [1 / len(targets)] * len(targets))] + [(f"only_{t}", [float(x == t) for x in targets]) for t in targets]
    out = spark.createDataFrame(fixed, "scenario string, w array<double>")
    names = F.array(*[F.lit(t) for t in targets])
    for kind, shape in (("sparse", sparse), ("balanced", balanced)):
        g = spark.range(draws).select(F.col("id"), F.transform(names, lambda t: gamma_draw(shape, kind, F.col("id"), t)).alias("g"))  # noqa: B023
        total = F.aggregate("g", F.lit(0.0), lambda a, x: a + x)
        out = out.unionByName(g.withColumn("t", total).select(F.concat(F.lit(kind + "_"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("scenario"), F.transform("g", lambda x: x / F.col("t")).alias("w")))
    return out


def best_rows(rows: DataFrame, key: str, models: dict[str, list[Column]], policies: dict[str, Column], weights: list[tuple[str, list[float]]]) -> DataFrame:
    """scenario, policy, model, pick, objective, feasible: for each combination the row with the lowest weighted sum, the smallest key of equal ones.

    A task multiplies its batches with the matrix of weights and keeps one best row for each combination, so that the shuffle holds only combinations, whatever
    the number of rows. Rows with a missing key or objective take no part; a policy that is missing isn't met. A combination without feasible rows gives no row.
    """
    w, names = np.array([x for _, x in weights]).T, [s for s, _ in weights]
    wide = rows.select(F.col(key).cast("long").alias("key"), *[F.array(*[c.cast("double") for c in v]).alias(f"m{i}") for i, v in enumerate(models.values())], F.array(*[F.coalesce(c, F.lit(False)) for c in policies.values()]).alias("p"))
    targets, n_models, n_policies = w.shape[0], len(models), len(policies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (n_policies, n_models, len(names))
        best, pick, count = np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max), np.zeros(shape, np.int64)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            met = batch.column(n_models + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_policies)[order]
            for m in range(n_models):
                y = batch.column(1 + m).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, targets)[order]
                good = np.isfinite(y).all(axis=1)
                score = np.round(np.where(good[:, None], y, 0.0) @ w, DIGITS)
                for p in range(n_policies):
                    ok = np.flatnonzero(good & met[:, p])
                    if len(ok):
                        at = ok[score[ok].argmin(axis=0)]
                        low, mine = score[at, np.arange(len(names))], keys[at]
                        better = (low < best[p, m]) | ((low == best[p, m]) & (mine < pick[p, m]))
                        best[p, m], pick[p, m] = np.where(better, low, best[p, m]), np.where(better, mine, pick[p, m])
                        count[p, m] += len(ok)
        p, m, s = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s, p, m, pick[p, m, s], best[p, m, s], count[p, m, s])], names=["s", "p", "m", "pick", "objective", "feasible"])

    found = wide.mapInArrow(run, "s long, p long, m long, pick long, objective double, feasible long")
    name = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(c) + 1).cast("int"))
    out = found.groupBy("s", "p", "m").agg(F.min_by("pick", F.struct("objective", "pick")).alias("pick"), F.min("objective").alias("objective"), F.sum("feasible").alias("feasible"))
    return out.select(name(names, "s").alias("scenario"), name(policies, "p").alias("policy"), name(models, "m").alias("model"), "pick", "objective", "feasible")


def stability(picks: DataFrame, first: str, second: str, reference: str = "equal") -> DataFrame:
    """For each policy of best_rows(): scenarios, share in which two models agree, and each model's choices that differ from its choice under the reference."""
    of = lambda model: F.max(F.when(F.col("model") == model, F.col("pick")))
    each = picks.groupBy("policy", "scenario").agg(of(first).alias("a"), of(second).alias("b"))
    all_of = each.groupBy("policy").agg(F.collect_list(F.struct("scenario", "a", "b")).alias("x"))  # one row for each scenario
    own = F.get(F.filter("x", lambda v: v["scenario"] == reference), F.lit(0))
    differing = lambda c: F.size(F.filter("x", lambda v: v[c] != own[c])).cast("long")
    n = F.size("x")
    return all_of.select(
        "policy", n.cast("long").alias("scenarios"), (F.size(F.filter("x", lambda v: v["a"] == v["b"])) / n).alias("agreement"),
        differing("a").alias("flips_" + first), differing("b").alias("flips_" + second),
        F.size(F.array_distinct(F.transform("x", lambda v: v["a"]))).cast("long").alias("picks_" + first), F.size(F.array_distinct(F.transform("x", lambda v: v["b"]))).cast("long").alias("picks_" + second),
    )
