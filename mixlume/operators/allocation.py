"""Scenario grids, combined loss predictors and allocation of a budget over sizes, tokens and recipes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlume.functions.expr import quality_cost


def grid(spark: SparkSession, **axes: list[float]) -> DataFrame:
    """All combinations of the axes' values: a small table of doubles."""
    return spark.createDataFrame([tuple(float(x) for x in row) for row in product(*axes.values())], ", ".join(f"{a} double" for a in axes))


def zero_mean(coefficients: DataFrame) -> DataFrame:
    """Rows of (intercept, beta) with beta shifted to mean 0; the intercept takes up the mean, so predictions on the simplex stay."""
    mean = F.aggregate("beta", F.lit(0.0), lambda a, x: a + x) / F.size("beta")
    shifted = coefficients.withColumn("_m", mean)
    return shifted.withColumn("intercept", F.col("intercept") + F.col("_m")).withColumn("beta", F.transform("beta", lambda x: x - F.col("_m"))).drop("_m")


def substitutions(recipes: DataFrame, gradient: dict[str, Column], domains: list[str], key: str = "idx") -> DataFrame:
    """key, from_domain, to_domain, direction: change of the surface per share that moves, for each pair of domains (a narrow explode)."""
    g = recipes.select(key, *[gradient[m].alias(m) for m in domains])
    pairs = [F.struct(F.lit(a).alias("from_domain"), F.lit(b).alias("to_domain"), (F.col(b) - F.col(a)).alias("direction")) for i, a in enumerate(domains) for b in domains[i + 1 :]]
    return g.select(key, F.inline(F.array(*pairs)))


def quality_proxy(x: Column, low: float, high: float) -> tuple[Column, Column]:
    """(x mapped from [low, high] to [0, 1] and clipped, whether it was clipped)."""
    q = (x - low) / (high - low)
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))), (x < low) | (x > high)


def conditional_loss(n: Column, d: Column, q: Column, law: tuple[float, ...]) -> tuple[Column, Column, Column, Column]:
    """Loss e + a n^-alpha + b d^-beta exp(-gamma q), and its derivatives in n, d and q."""
    e, a, alpha, b, beta, gamma = law
    data = b * F.pow(d, F.lit(-beta)) * F.exp(-gamma * q)
    return F.lit(e) + a * F.pow(n, F.lit(-alpha)) + data, -alpha * a * F.pow(n, F.lit(-alpha - 1)), -beta * data / d, -gamma * data


def crossings(rows: DataFrame, steps: int) -> DataFrame:
    """idx, family, q: first quality on a grid of [0, 2] at which a family's cost passes the row's base cost."""
    x = rows.withColumn("family", F.explode(F.array(F.lit("exp"), F.lit("power"), F.lit("log"))))
    at = lambda k: quality_cost(2.0 * k / (steps - 1), F.col("family"))
    passed = F.filter(F.sequence(F.lit(1), F.lit(steps - 1)), lambda k: (at(k) > F.col("base")) & (at(k - 1) <= F.col("base")))
    return x.withColumn("q", 2.0 * F.get(passed, F.lit(0)) / (steps - 1)).where("q is not null").select("idx", "family", "q")


def bridged_loss(n: Column, d: Column, q: Column, effect: Column, lam: Column, eta: Column, model: Column, law: tuple[float, ...]) -> dict[str, Column]:
    """conditional_loss() times a mixture factor, with derivatives and elasticities in n, d and q, by name.

    With z = lam n^-eta effect the factor is e^z (model exp) or 1 + z (linear). status: OK; NEGATIVE_LAMBDA; UNKNOWN_MODEL; OUT_OF_RANGE for |z| above 700 under
    exp or a linear factor that isn't positive; MISSING for a missing input. All figures of a row that isn't OK are NULL.
    """
    base, dn, dd, dq = conditional_loss(n, d, q, law)
    z = lam * F.pow(n, -eta) * effect
    exp = model == "exp"
    status = (
        F.when(z.isNull() | base.isNull() | model.isNull(), "MISSING").when(~model.isin("exp", "linear"), "UNKNOWN_MODEL").when(lam < 0, "NEGATIVE_LAMBDA")
        .when((exp & (F.abs(z) > 700)) | (~exp & (z <= -1)), "OUT_OF_RANGE").otherwise("OK")
    )
    factor, slope = F.when(exp, F.exp(z)).otherwise(1 + z), F.when(exp, F.exp(z)).otherwise(F.lit(1.0))
    loss = base * factor
    parts = {"loss": loss, "factor": factor, "dn": factor * dn - base * slope * eta * z / n, "dd": factor * dd, "dq": factor * dq}
    parts |= {f"elasticity_{x}": v * parts[f"d{x}"] / loss for x, v in (("n", n), ("d", d), ("q", q))}
    return {"status": status, **{k: F.when(status == "OK", v) for k, v in parts.items()}}
