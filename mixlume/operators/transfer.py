"""Transfer of a surrogate across scales: each target's losses at each scale against the surrogate's predictions, and how the slopes decay with scale, by a bootstrap of targets and shared rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.functions.expr import hash_uniform, total
from mixlume.operators.resample import poisson_weights

#: A predictor whose deviation is below this share of its mean counts as constant.
FLAT = 1e-9


def calibrations(rows: DataFrame, key: str, scale: str, pairs: dict[str, tuple[str, str]], reps: int = 0, seed: str = "") -> DataFrame:
    """scale, target, rep, w, intercept, slope, pearson, rmse: least squares of a target's actual values on its predictions, pairs: target -> (predicted, actual).

    Replicate 0 is the data; in replicate 1..reps a row counts as often as the Poisson(1) number of its key and the replicate says, so one draw is shared by all
    targets and by all scales in which the key occurs: rows that belong together stay together. Rows without key or scale are left out; a missing or infinite
    value leaves its row out for that target alone. A constant predictor has slope NULL; a target without rows in a scale gives w 0 or no row. A pass for means, so that sums
    don't cancel, and one for sums: what is shuffled are scales x replicates.
    """
    good = rows.where(F.col(key).isNotNull() & F.col(scale).isNotNull())
    limit = F.lit(float("inf"))
    p, y = ({t: F.col(c[i]).cast("double") for t, c in pairs.items()} for i in (0, 1))
    ok = {t: (F.abs(p[t]) < limit) & (F.abs(y[t]) < limit) for t in pairs}
    means = good.groupBy(scale).agg(*[f(F.when(ok[t], v[t])).alias(f"_{n}{i}") for i, t in enumerate(pairs) for n, v, f in (("p", p, F.avg), ("y", y, F.avg))])
    kept = [F.array(*[F.when(ok[t], F.struct((p[t] - F.col(f"_p{i}")).alias("p"), (y[t] - F.col(f"_y{i}")).alias("y"))) for i, t in enumerate(pairs)]).alias("_v")]
    centred = good.join(means, scale).select(scale, F.col(key).cast("string").alias("_key"), *kept, *[f"_{n}{i}" for i in range(len(pairs)) for n in "py"])
    weights = F.concat(F.array(F.lit(1)), poisson_weights("_key", reps, seed, 1)) if reps else F.array(F.lit(1))
    drawn = centred.select("*", F.posexplode(weights).alias("rep", "_w")).where("_w > 0")
    sums = []
    for i, t in enumerate(pairs):
        v, w = F.col("_v")[i], F.col("_w").cast("double")
        a, b = v["p"], v["y"]
        made = {"w": F.when(v.isNotNull(), w).otherwise(0.0), "p": w * a, "y": w * b, "pp": w * a * a, "py": w * a * b, "yy": w * b * b}
        sums.append(F.struct(F.lit(t).alias("target"), *[F.sum(x).alias(k) for k, x in made.items()], F.first(f"_p{i}").alias("mp"), F.first(f"_y{i}").alias("my")))
    s = drawn.groupBy(scale, "rep").agg(F.array(*sums).alias("_s")).select(scale, "rep", F.inline("_s"))
    c = F.col
    part = s.select("*", (c("pp") - c("p") * c("p") / F.nullif("w", F.lit(0.0))).alias("_pp"), (c("py") - c("p") * c("y") / F.nullif("w", F.lit(0.0))).alias("_py"), (c("yy") - c("y") * c("y") / F.nullif("w", F.lit(0.0))).alias("_yy"))
    slope = F.when((c("_pp") > 0) & (c("_pp") > FLAT**2 * c("w") * c("mp") * c("mp")), c("_py") / c("_pp"))
    fitted = part.withColumn("slope", slope)
    left = F.greatest(c("_yy") - c("slope") * c("_py"), F.lit(0.0))
    return fitted.select(
        scale, "target", "rep", "w", (c("my") + c("y") / F.nullif("w", F.lit(0.0)) - c("slope") * (c("mp") + c("p") / F.nullif("w", F.lit(0.0)))).alias("intercept"), "slope",
        F.when(c("_yy") > 0, c("slope") * F.sqrt(F.nullif("_pp", F.lit(0.0)) / F.nullif("_yy", F.lit(0.0)))).alias("pearson"), F.when(c("slope").isNotNull(), F.sqrt(left / c("w"))).alias("rmse"),
    )


def intervals(fits: DataFrame, scale: str, reps: int) -> DataFrame:
    """scale, target, n, intercept, slope, pearson, rmse of the data, low and high (95 % of the replicates' slopes), invalid (replicates whose slope isn't positive)."""
    here, c = F.col("rep") == 0, F.col
    own = [F.max(F.when(here, c(x))).alias(y) for x, y in (("w", "n"), ("intercept", "intercept"), ("slope", "slope"), ("pearson", "pearson"), ("rmse", "rmse"))]
    drawn = F.when(~here, c("slope"))  # a value for each replicate
    out = fits.groupBy(scale, "target").agg(*own, F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"), (F.lit(reps) - F.count_if(~here & (c("slope") > 0))).alias("invalid"))
    return out.withColumn("n", c("n").cast("long"))


def target_decays(fits: DataFrame, scale: str, sizes: dict[str, float]) -> DataFrame:
    """rep, target, scales (with a positive slope), eta: minus the slope of ln(slope) on ln(size) over all scales; NULL unless every scale's slope is positive; and its sums num, tss."""
    x = {s: math.log(v) for s, v in sizes.items()}
    mean = sum(x.values()) / len(x)
    at = F.coalesce(*[F.when(F.col(scale) == s, v - mean) for s, v in x.items()])
    log = F.when(F.col("slope") > 0, F.ln("slope"))
    sums = fits.where(F.col(scale).isin(list(sizes))).groupBy("rep", "target").agg(F.count(log).alias("scales"), F.sum(at * log).alias("num"), F.sum(log * log).alias("_q"), F.sum(log).alias("_l"))
    whole, sxx = F.col("scales") == len(sizes), sum((v - mean) ** 2 for v in x.values())
    return sums.select("rep", "target", "scales", F.when(whole, -F.col("num") / sxx).alias("eta"), F.when(whole, F.col("num")).alias("num"), F.when(whole, F.col("_q") - F.col("_l") * F.col("_l") / len(sizes)).alias("tss"))


def _times(targets: list[str], seed: str) -> Column:
    """How often a target is among as many targets drawn with replacement."""
    k, n = F.array_position(F.array(*[F.lit(t) for t in targets]), F.col("target")) - 1, len(targets)
    return total([(F.floor(hash_uniform(f"{seed}-target", F.col("rep"), j) * n) == k).cast("int") for j in range(n)])


def pooled_decay(fits: DataFrame, scale: str, sizes: dict[str, float], targets: list[str], reps: int, seed: str) -> DataFrame:
    """drawn, eta, r2, low, median, high, valid, invalid, status: the decay of slopes with size, one for all targets, each with its own level.

    ``targets``: targets are drawn, their slopes stay those of the data; ``targets_and_rows``: each replicate has its own slopes, too. A draw that holds a target without a positive slope at each scale is invalid
    and counted. status: OK; NOT_POSITIVE (the data have such a target: no eta); TOO_FEW_VALID (fewer than half of the draws: no interval). Always two rows.
    """
    x = [math.log(v) for v in sizes.values()]
    sxx, n = sum((v - sum(x) / len(x)) ** 2 for v in x), len(targets)
    each = target_decays(fits, scale, sizes).where(F.col("target").isin(targets))
    own = each.where("rep = 0")
    spread = own.drop("rep").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    out = None
    for drawn, rows in (("targets", spread), ("targets_and_rows", each)):
        m = F.when(F.col("rep") == 0, 1).otherwise(_times(targets, seed))
        by_rep = rows.withColumn("m", m).groupBy("rep").agg(F.sum(F.when(F.col("eta").isNotNull(), F.col("m")).otherwise(0)).alias("_m"), F.sum(F.col("m") * F.col("num")).alias("_num"), F.sum(F.col("m") * F.col("tss")).alias("_tss"))
        ok = F.col("_m") == n
        eta, r2 = F.when(ok, -F.col("_num") / (n * sxx)), F.when(ok, F.col("_num") * F.col("_num") / (n * sxx) / F.nullif("_tss", F.lit(0.0)))
        found = by_rep.select("rep", eta.alias("eta"), r2.alias("r2"))
        here, value = F.col("rep") == 0, F.when(F.col("rep") > 0, F.col("eta"))
        row = found.agg(F.max(F.when(here, F.col("eta"))).alias("eta"), F.max(F.when(here, F.col("r2"))).alias("r2"), *[F.percentile(value, q).alias(k) for k, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))], F.count(value).alias("valid"))
        enough = F.col("valid") * 2 >= reps
        status = F.when(F.col("eta").isNull(), "NOT_POSITIVE").when(~enough, "TOO_FEW_VALID").otherwise("OK")
        one = row.select(F.lit(drawn).alias("drawn"), "eta", "r2", *[F.when(enough, F.col(k)).alias(k) for k in ("low", "median", "high")], "valid", (F.lit(reps) - F.col("valid")).alias("invalid"), status.alias("status"))
        out = one if out is None else out.unionByName(one)
    return out
