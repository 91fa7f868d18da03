"""Scaling laws and budget-limited choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.functions.expr import quality_cost
from mixlume.sources.io import cut

#: Starting grid of the law's exponents.
EXPONENTS = (0.2, 0.4, 0.6, 0.8, 1.0, 1.2)


def classic(n: Column, d: Column, e: float, a: float, alpha: float, b: float, beta: float) -> Column:
    """e + a * n^-alpha + b * d^-beta."""
    return F.lit(e) + F.lit(a) * F.pow(n, F.lit(-alpha)) + F.lit(b) * F.pow(d, F.lit(-beta))


def fit_classic(points: DataFrame, group: str = "group", passes: int = 12, delta: float = 0.05, reweights: int = 3) -> DataFrame:
    """e, a, alpha, b, beta, loss: the law with the least Huber loss of the residual of ln(loss), groups weighted equally; exponents on grids that zoom in below 1e-4.

    Each pass is one aggregate over points x candidates with map-side sums; the driver sees a row for each candidate. Amplitudes follow from weighted least
    squares: a residual r / loss is that of the logarithm to first order, and the weights of the pass before, min(1, delta / |ln residual|) / loss^2, are
    Huber's. ``loss`` is the weighted mean of Huber's function at the result.
    """
    spark = points.sparkSession
    weights = points.groupBy(group).agg((1.0 / F.count("*")).alias("_w"))
    data = cut(points.join(F.broadcast(weights), group).select("n", "d", "loss", "_w"), "points")
    y = F.col("loss")
    best = None
    for reweight in range(reweights):
        if best is None:
            w = F.col("_w") / (y * y)
        else:
            r = F.abs(F.ln(y) - F.ln(F.greatest(classic(F.col("n"), F.col("d"), *best[:5]), F.lit(1e-9))))
            w = F.col("_w") / (y * y) * F.least(F.lit(1.0), F.lit(delta) / F.greatest(r, F.lit(1e-12)))
        alphas, betas, step, found_here = list(EXPONENTS), list(EXPONENTS), EXPONENTS[1] - EXPONENTS[0], None
        if best is not None:
            step = 0.1
            alphas, betas = ([max(0.02, c + step * k) for k in (-1, -0.5, 0, 0.5, 1)] for c in (best[2], best[4]))
        for _ in range(passes if reweight else passes // 2):
            grid = spark.createDataFrame([(float(x), float(z)) for x in sorted(set(alphas)) for z in sorted(set(betas))], "alpha double, beta double")
            rows = data.crossJoin(F.broadcast(grid))
            x = [F.lit(1.0), F.pow("n", -F.col("alpha")), F.pow("d", -F.col("beta")), y]
            sums = rows.groupBy("alpha", "beta").agg(F.array(*[F.sum(w * x[i] * x[j]) for i in range(4) for j in range(i, 4)]).alias("g"))
            for row in sums.collect():  # ten sums for each candidate
                found = _amplitudes(row["g"])
                if found and (found_here is None or found[3] < found_here[5]):
                    found_here = (found[0], found[1], row["alpha"], found[2], row["beta"], found[3])
            if found_here is None:
                break
            step /= 2
            alphas, betas = ([max(0.02, c + step * k) for k in (-1, -0.5, 0, 0.5, 1)] for c in (found_here[2], found_here[4]))
            if step < 1e-4:
                break
        best = found_here
        if best is None:
            return spark.createDataFrame([], "e double, a double, alpha double, b double, beta double, loss double")
    r = F.abs(F.ln(y) - F.ln(F.greatest(classic(F.col("n"), F.col("d"), *best[:5]), F.lit(1e-9))))
    huber = F.when(r <= delta, r * r / 2).otherwise(delta * (r - delta / 2))
    return data.agg(*[F.lit(float(v)).alias(k) for k, v in zip(("e", "a", "alpha", "b", "beta"), best)], (F.sum(F.col("_w") * huber) / F.sum("_w")).alias("loss"))


def validate_classic(points: DataFrame, tail: float = 0.3) -> DataFrame:
    """axis, level, status, the law's parameters, train_rows, test_rows, rmse: the law with each size held out ("size"), with the last ``tail`` of each size's points in the order of d held out
    ("tail", at least one point stays and one goes), and of all points ("full").

    Least squares of residuals relative to the loss, sizes weighted equally; all folds come from the same passes. Sizes must be few (at most laws.LEVELS).
    """
    from mixlume.operators import laws, stats

    counted = points.groupBy("n", "d").agg(F.count("*").alias("_c"))
    placed = stats.running(counted, ["n"], "d", "_c", "_k").join(counted.groupBy("n").agg(F.sum("_c").alias("_n")), "n")
    kept = F.least(F.greatest(F.floor((1 - tail) * F.col("_n") + 1e-9), F.lit(1)), F.col("_n") - 1)
    marked = points.join(placed.select("n", "d", (F.col("_k") > kept).alias("_late"), "_n"), ["n", "d"])
    rows = marked.select("n", "d", F.col("loss").alias("y"), (1.0 / (F.col("loss") * F.col("loss") * F.col("_n"))).alias("_w"), "_late")
    axes = {"size": F.col("n"), "tail": F.when(F.col("_late"), "tail")}
    fits = laws.fit_folds(rows, ["none"], axes, F.col("_w"))
    return laws.as_table(points.sparkSession, fits).drop("family", "g")


def _amplitudes(g: list[float]) -> tuple[float, float, float, float] | None:
    import numpy as np

    from mixlume.operators.moments import matrix

    m = matrix(g, 4)
    try:
        beta = np.linalg.solve(m[:3, :3] + 1e-12 * np.eye(3), m[:3, 3])
    except np.linalg.LinAlgError:
        return None
    v = np.append(beta, -1.0)
    return float(beta[0]), float(beta[1]), float(beta[2]), float(max(0.0, v @ m @ v))


def total_cost(n: Column, d: Column, context: Column, q: Column, q0: Column, family: Column) -> Column:
    """Training (6 n d), attention (0.1 n context) and quality above q0, which costs nothing below it."""
    return 6 * n * d + 0.1 * n * context + F.greatest(F.lit(0.0), quality_cost(q, family) - quality_cost(q0, family)) * d


def choose_within(rows: DataFrame, budgets: DataFrame, key: str, cost: str, predicted: str, actual: str) -> DataFrame:
    """budget, pick (lowest prediction that fits), best (lowest actual that fits), regret. budgets is a small grid."""
    fit = rows.join(F.broadcast(budgets), F.col(cost) <= F.col("budget"))
    by_p, by_y = F.struct(F.round(predicted, 9), F.col(key)), F.struct(F.round(actual, 9), F.col(key))
    return fit.groupBy("budget").agg(F.min_by(key, by_p).alias("pick"), F.min_by(key, by_y).alias("best"), (F.min_by(actual, by_p) - F.min(actual)).alias("regret"))


def scan(points: DataFrame, law: tuple[float, ...], steps: int) -> DataFrame:
    """budget, n, d_tokens, loss, status for log-spaced budgets over the points' range: tokens follow from the budget, the observed sizes are tried."""
    c = 6 * F.col("n") * F.col("d")
    bounds = points.agg(F.log10(F.min(c)).alias("lo"), F.log10(F.max(c)).alias("hi"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    grid = bounds.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).select(F.pow(F.lit(10.0), F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (steps - 1)).alias("budget"), "d0", "d1")
    sizes = points.select("n").distinct()
    tried = sizes.crossJoin(F.broadcast(grid)).withColumn("d_tokens", F.col("budget") / (6 * F.col("n")))
    inside = tried.withColumn("d_tokens", F.least("d_tokens", "d1")).where("d_tokens >= d0")
    loss = classic(F.col("n"), F.col("d_tokens"), *law)
    best = inside.withColumn("loss", loss).groupBy("budget").agg(F.min_by(F.struct("n", "d_tokens", "loss", "d1"), F.struct("loss", "n")).alias("x"))
    return best.select("budget", "x.n", "x.d_tokens", "x.loss", F.when(F.col("x.d_tokens") >= F.col("x.d1"), "D_max_bound").otherwise("interior").alias("status"))


def size_for_loss(target: Column, d: Column, law: tuple[float, ...], low: float = 0.01, high: float = 1e4) -> Column:
    """The size with the target loss at d, by 60 halvings in logarithms; NULL where the target isn't between the losses at both ends."""
    lo, hi = F.ln(F.lit(low)), F.ln(F.lit(high))
    at = lambda x: classic(F.exp(x), d, *law)
    start = F.struct(lo.alias("a"), hi.alias("b"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        return F.when(at(mid) > target, F.struct(mid.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), mid.alias("b")))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: F.exp((s["a"] + s["b"]) / 2))
    return F.when((at(lo) >= target) & (at(hi) <= target), root)
