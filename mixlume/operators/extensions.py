"""Quality extensions of a scaling law, nested validation, bridges, frontier candidates, bounded optima and transitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.functions.expr import hash_uniform, poisson_one
from mixlume.operators import moments, resample, stats


def cluster_bootstrap_slope(points: DataFrame, cluster: list[str], y: str, x: str, reps: int, seed: str) -> DataFrame:
    """low, high: 95 % interval of a slope when whole clusters are drawn; replicates weigh each cluster's sums of products, not its rows."""
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in cluster]).alias("_cluster")
    sums = moments.gram(points.select(name, x, y), ["_cluster"], [x], [y])
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("w", poisson_one(hash_uniform(seed, F.col("rep"), F.col("_cluster"))))
    s = drawn.groupBy("rep").agg(*[F.sum(F.col("w") * F.col("g")[k]).alias(f"s{k}") for k in range(5)])
    slope = (F.col("s0") * F.col("s4") - F.col("s1") * F.col("s2")) / F.nullif(F.col("s0") * F.col("s3") - F.col("s1") * F.col("s1"), F.lit(0.0))
    return s.select(slope.alias("b")).agg(F.percentile("b", 0.025).alias("low"), F.percentile("b", 0.975).alias("high"))  # a value for each replicate


def two_level_bootstrap(errors: DataFrame, row: str, target: str, value: str, reps: int, seed: str) -> DataFrame:
    """low, high: 95 % interval of the mean over targets and rows, both drawn; all targets of a row are drawn together, and so are all rows of a target."""
    drawn = errors.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    w = poisson_one(hash_uniform(f"{seed}-row", F.col("rep"), F.col(row))) * poisson_one(hash_uniform(f"{seed}-target", F.col("rep"), F.col(target)))
    means = drawn.withColumn("w", w).groupBy("rep").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def nested_validation(rows: DataFrame, key: str, models: dict[str, list[str]], y: str, alphas: tuple[float, ...], outer: int = 5, inner: int = 5) -> DataFrame:
    """outer, model, alpha, rmse: features and ridge chosen inside each outer fold by its inner folds, and tested on the outer fold."""
    return nested_panel(rows, key, models, [y], alphas, outer, inner).where("chosen").select("outer", "model", "alpha", "rmse")


def nested_panel(rows: DataFrame, key: str, models: dict[str, list[str]], targets: list[str], alphas: tuple[float, ...], outer: int = 5, inner: int = 5) -> DataFrame:
    """target, outer, model, alpha, inner_sse, rmse, chosen: each model's ridge chosen inside each outer fold by its inner folds, and tested on the outer fold.

    chosen: the model that the inner folds prefer (the first of equals), so that its rmse is that of the whole procedure. Rows with a missing feature of a model or any
    target are left out of that model. One pass gives the sums of products of each (outer, inner) cell for each model and all targets; every training and test part is a sum
    or difference of cells, which alone are gathered (models x outer x inner rows of arrays).
    """
    folds = resample.contiguous_folds(rows, key, outer).withColumnRenamed("fold", "o").withColumn("i", F.floor(hash_uniform("inner", F.col(key)) * inner).cast("int"))
    cells, count = None, len(targets)
    for name, x in models.items():
        one = moments.gram(folds, ["o", "i"], x, targets).select(F.lit(name).alias("model"), "o", "i", "g")
        cells = one if cells is None else cells.unionByName(one)

    def sse(g: np.ndarray, beta: np.ndarray) -> np.ndarray:
        v = np.vstack([beta, -np.eye(count)])
        return np.einsum("it,ij,jt->t", v, moments.matrix(list(g), len(v)), v)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        sums = {(m, o, i): np.array(g) for m, o, i, g in zip(group.model, group.o, group.i, group.g)}
        for o in sorted(set(group.o)):
            found = {}
            for m, x in models.items():
                mine = {i: sum(g for (n, p, j), g in sums.items() if n == m and p != o and j == i) for i in range(inner)}
                mine = {i: g for i, g in mine.items() if not np.isscalar(g)}
                test = sum(g for (n, p, _), g in sums.items() if n == m and p == o)
                if not mine or np.isscalar(test):
                    continue
                whole = sum(mine.values())
                errors = np.array([sum(sse(g, moments.solve(list(whole - g), len(x), count, alpha)) for g in mine.values()) for alpha in alphas])
                rmse = [np.sqrt(np.maximum(sse(test, moments.solve(list(whole), len(x), count, alpha)), 0) / test[0]) for alpha in alphas]
                for t in range(count):
                    a = 0
                    for k in range(1, len(alphas)):
                        a = k if errors[k, t] < errors[a, t] - 1e-15 else a
                    found[m, t] = float(alphas[a]), float(errors[a, t]), float(rmse[a][t])
            for t, target in enumerate(targets):
                best = None
                for m in models:
                    if (m, t) in found and (best is None or found[m, t][1] < found[best, t][1] - 1e-15):
                        best = m
                out += [(target, int(o), m, *found[m, t], m == best) for m in models if (m, t) in found]
        return pd.DataFrame(out, columns=["target", "outer", "model", "alpha", "inner_sse", "rmse", "chosen"])

    schema = "target string, outer int, model string, alpha double, inner_sse double, rmse double, chosen boolean"
    return cells.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(choose, schema)


def compare_models(panel: DataFrame) -> DataFrame:
    """target, model, folds, median_rmse, worst_rmse, wins (folds in which it was chosen) of nested_panel()."""
    return panel.groupBy("target", "model").agg(F.count("*").alias("folds"), F.percentile("rmse", 0.5).alias("median_rmse"), F.max("rmse").alias("worst_rmse"), F.count_if("chosen").alias("wins"))


def bridge_panel(rows: DataFrame, grade: str, score: str, loss: str, size: str) -> DataFrame:
    """grade, model, n, rmse of four bridges from loss to score: constant, loss, loss and size, and loss kept falling; all from sums of products."""
    g = moments.gram(rows, [grade], [loss, size], [score])
    s = {(0, 0): 0, (0, 1): 1, (0, 2): 2, (0, 3): 3, (1, 1): 4, (1, 2): 5, (1, 3): 6, (2, 2): 7, (2, 3): 8, (3, 3): 9}
    at = lambda i, j: F.col("g")[s[i, j]]
    c = lambda i, j: at(i, j) - at(0, i) * at(0, j) / at(0, 0)
    det = c(1, 1) * c(2, 2) - c(1, 2) * c(1, 2)
    sse = {
        "constant": c(3, 3),
        "loss": c(3, 3) - c(1, 3) * c(1, 3) / F.nullif(c(1, 1), F.lit(0.0)),
        "loss_and_size": c(3, 3) - (c(1, 3) * (c(2, 2) * c(1, 3) - c(1, 2) * c(2, 3)) + c(2, 3) * (c(1, 1) * c(2, 3) - c(1, 2) * c(1, 3))) / F.nullif(det, F.lit(0.0)),
        "monotone": F.when(c(1, 3) > 0, c(3, 3)).otherwise(c(3, 3) - c(1, 3) * c(1, 3) / F.nullif(c(1, 1), F.lit(0.0))),
    }
    panel = F.array(*[F.struct(F.lit(k).alias("model"), F.sqrt(F.greatest(v, F.lit(0.0)) / at(0, 0)).alias("rmse")) for k, v in sse.items()])
    return g.select(grade, "n", F.inline(panel)).select(grade, "model", "n", "rmse")


def frontier_candidates(rows: DataFrame, by: list[str], score: str, t: str, q: float, horizon: float) -> DataFrame:
    """by, candidate, forecast at the last t plus horizon: constant (q-quantile), trend (line through the scores shifted to the q-quantile of its residuals), mean (the line)."""
    fit = moments.slope(rows, by, score, t).join(rows.groupBy(*by).agg(F.max(t).alias("_last")), by)
    off = rows.join(F.broadcast(fit), by).withColumn("_r", F.col(score) - F.col("intercept") - F.col("slope") * F.col(t))
    quantile = stats.quantiles(off, by, {"_q": (score, q), "_s": ("_r", q)})
    line = F.col("intercept") + F.col("slope") * (F.col("_last") + horizon)
    made = F.array(*[F.struct(F.lit(k).alias("candidate"), v.alias("forecast")) for k, v in {"constant": F.col("_q"), "trend": line + F.col("_s"), "mean": line}.items()])
    return fit.join(quantile, by).select(*by, F.inline(made))


def boosted(rows: DataFrame, key: str, x: list[str], targets: list[str], trees: int = 8, depth: int = 3) -> DataFrame:
    """target, n, rmse: gradient-boosted trees of Spark ML for each target, trained on four of five folds by hash and tested on the fifth."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    out = None
    held = rows.withColumn("_held", hash_uniform("boost", F.col(key)) < 0.2)
    ready = VectorAssembler(inputCols=x, outputCol="_x").transform(held)
    for t in targets:
        model = GBTRegressor(featuresCol="_x", labelCol=t, predictionCol="_p", maxIter=trees, maxDepth=depth, seed=7).fit(ready.where("not _held"))
        one = model.transform(ready.where("_held")).agg(F.lit(t).alias("target"), F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("_p") - F.col(t), 2))).alias("rmse"))
        out = one if out is None else out.unionByName(one)
    return out


def first_match(text: Column, families: dict[str, list[str]], other: str = "other") -> Column:
    """The first family that has a substring of the text, in lower case."""
    out = F.lit(None).cast("string")
    for name, parts in reversed(families.items()):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(F.lower(text), F.lit(p.lower()))
        out = F.when(hit, name).otherwise(out)
    return F.coalesce(out, F.lit(other))


