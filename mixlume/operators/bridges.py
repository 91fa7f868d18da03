"""Bridges from a coordinate to a bounded score, each row tested on a fit of its group's other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlume.functions.expr import bounded_logit, score_of_logit

LEAST_ROWS = 4


def leave_one_row_out(rows: DataFrame, by: list[str], x: str, score: str) -> DataFrame:
    """by, n, intercept, slope, rmse, constant_rmse, r2, status: a falling line of the score's logit on x, and how it does on each row when fitted without that row.

    A rising line, of the group or of a row's others, is replaced by their mean. constant_rmse is that of the others' mean logit. Errors are in points of the score (0 to 100).
    status: ``insufficient`` (fewer than 4 rows or 3 distinct x: no errors), ``accepted`` (falls and beats the constant) or ``not_accepted``. Rows with a
    missing or infinite x or score are left out. A row's fit is the group's centred sums less the row, so that nothing is fitted twice: one pass for sums, one for errors.
    """
    limit = F.lit(float("inf"))
    good = rows.select(*by, F.col(x).cast("double").alias("_x"), F.col(score).cast("double").alias("_s")).where((F.abs("_x") < limit) & (F.abs("_s") < limit)).withColumn("_z", bounded_logit(F.col("_s")))
    c, n = F.col, F.count("*")
    sums = good.groupBy(*by).agg(
        n.alias("n"), F.avg("_x").alias("_mx"), F.avg("_z").alias("_mz"), (F.var_pop("_x") * n).alias("_xx"), (F.covar_pop("_x", "_z") * n).alias("_xz"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), (F.var_pop("_s") * n).alias("_ss")
    )
    on = [good[k].eqNullSafe(sums[k]) for k in by]
    joined = good.join(sums, on).drop(*[sums[k] for k in by]) if by else good.crossJoin(F.broadcast(sums))  # one row
    grow, dx, dz = c("n") / (c("n") - 1), c("_x") - c("_mx"), c("_z") - c("_mz")
    xx, xz = c("_xx") - dx * dx * grow, c("_xz") - dx * dz * grow
    flat = (c("_hi") == c("_lo")) | (xx <= 1e-12 * c("_xx"))
    slope = F.when(flat, 0.0).otherwise(F.least(xz / F.nullif(xx, F.lit(0.0)), F.lit(0.0)))
    others = c("_mz") - dz / (c("n") - 1)
    tested = joined.where("n > 1").withColumns({"_e": score_of_logit(others + slope * dx * grow) - c("_s"), "_k": score_of_logit(others) - c("_s")})
    alone = joined.where("n <= 1").withColumns({"_e": F.lit(None).cast("double"), "_k": F.lit(None).cast("double")})
    first = {k: F.first(k).alias(k) for k in ("n", "_mx", "_mz", "_xx", "_xz", "_lo", "_hi", "_ss")}
    done = tested.unionByName(alone).groupBy(*by).agg(*first.values(), F.sum(c("_e") * c("_e")).alias("_ee"), F.sum(c("_k") * c("_k")).alias("_kk"), F.count_if((c("_x") > c("_lo")) & (c("_x") < c("_hi"))).alias("_inner"))
    own = F.when(c("_hi") == c("_lo"), 0.0).otherwise(F.least(c("_xz") / F.nullif("_xx", F.lit(0.0)), F.lit(0.0)))
    enough = (c("n") >= LEAST_ROWS) & (c("_inner") > 0)
    out = done.select(*by, "n", (c("_mz") - own * c("_mx")).alias("intercept"), own.alias("slope"), F.when(enough, F.sqrt(c("_ee") / c("n"))).alias("rmse"), F.when(enough, F.sqrt(c("_kk") / c("n"))).alias("constant_rmse"), F.when(enough, 1 - c("_ee") / F.nullif("_ss", F.lit(0.0))).alias("r2"))
    status = F.when(c("rmse").isNull(), "insufficient").when((c("slope") < 0) & (c("rmse") < c("constant_rmse")), "accepted").otherwise("not_accepted")
    return out.where("n is not null").withColumn("status", status)
