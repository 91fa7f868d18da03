"""Queries on the transfer of a surrogate across scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mixlume.operators import transfer
from mixlume.plans.entities import LOSSES, MIX, RECIPES_SQL, table
from mixlume.plans.extensions import _POISSON
from mixlume.plans.mixture import _U, recipe_table
from mixlume.plans.registry import query

#: Sizes of the scales: a recipe's lines of small, middle and large quantities stand for its losses at each.
SIZES = {"small": 1e6, "middle": 6e7, "large": 1e9}
_REPS = 40
_SCALE = "CASE WHEN l_quantity <= 15 THEN 'small' WHEN l_quantity <= 35 THEN 'middle' ELSE 'large' END"
_OF = {"loss_a": "l_discount", "loss_b": "l_tax", "loss_c": "l_quantity / 50", "loss_d": "l_extendedprice / 100000"}
#: Rows of the first two scales are drawn together, those of the last one by themselves.
_KEY = "CASE WHEN scale = 'large' THEN 'large/' ELSE '' END || CAST(idx AS VARCHAR)"
_MARGINAL = {t: " + ".join([f"avg_{t}", *[f"s_{t}_{m} * ({m} - a_{m})" for m in MIX]]) for t in LOSSES}
_W = _POISSON.format(_U.format("'transfer|' || rep || '|' || key"))
_T = len(LOSSES)
_FITS_SQL = f"""WITH {RECIPES_SQL},
f AS (SELECT {", ".join(f"avg({t}) AS avg_{t}, " + ", ".join(f"regr_slope({t}, {m}) AS s_{t}_{m}" for m in MIX) for t in LOSSES)}, {", ".join(f"avg({m}) AS a_{m}" for m in MIX)} FROM rec),
pred AS (SELECT idx, {", ".join(f"{x} AS p_{t}" for t, x in _MARGINAL.items())} FROM rec, f),
scaled AS (SELECT o_custkey AS idx, {_SCALE} AS scale, {", ".join(f"avg({x}) AS y_{t}" for t, x in _OF.items())} FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
long AS ({" UNION ALL ".join(f"SELECT {_KEY} AS key, scale, '{t}' AS target, p_{t} AS p, y_{t} AS y FROM scaled JOIN pred USING (idx)" for t in LOSSES)}),
centred AS (SELECT key, scale, target, p, y - avg(y) OVER (PARTITION BY scale, target) AS yc, avg(y) OVER (PARTITION BY scale, target) AS my, p - avg(p) OVER (PARTITION BY scale, target) AS pc, avg(p) OVER (PARTITION BY scale, target) AS mp FROM long),
drawn AS (SELECT *, CASE WHEN rep = 0 THEN 1 ELSE {_W} END AS w FROM centred, range({_REPS + 1}) r(rep)),
s AS (SELECT scale, target, rep, any_value(my) AS my, any_value(mp) AS mp, sum(w) AS w, sum(w * pc) AS p, sum(w * yc) AS y, sum(w * pc * pc) AS pp, sum(w * pc * yc) AS py, sum(w * yc * yc) AS yy FROM drawn GROUP BY 1, 2, 3 HAVING sum(w) > 0),
b AS (SELECT *, (py - p * y / w) / (pp - p * p / w) AS slope FROM s),
fits AS (SELECT *, my + y / w - slope * (mp + p / w) AS intercept, slope * sqrt((pp - p * p / w) / (yy - y * y / w)) AS pearson, sqrt(greatest(0, (yy - y * y / w) - slope * (py - p * y / w)) / w) AS rmse FROM b)"""


def _fits(spark, d):
    """Each target's mean losses at each scale against a marginal surrogate (mean plus a slope for each share) of all lines."""
    rec = recipe_table(spark, d)
    f = rec.agg(*[F.avg(t).alias(f"avg_{t}") for t in LOSSES], *[F.avg(m).alias(f"a_{m}") for m in MIX], *[F.regr_slope(F.col(t), F.col(m)).alias(f"s_{t}_{m}") for t in LOSSES for m in MIX])
    marginal = [reduce(lambda a, m: a + F.col(f"s_{t}_{m}") * (F.col(m) - F.col(f"a_{m}")), MIX, F.col(f"avg_{t}")).alias(f"p_{t}") for t in LOSSES]
    predicted = rec.crossJoin(F.broadcast(f)).select("idx", *marginal)  # one row
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("idx"))
    at = lines.join(owners, "l_orderkey").groupBy("idx", F.expr(_SCALE).alias("scale")).agg(*[F.avg(F.expr(x)).alias(f"y_{t}") for t, x in _OF.items()])
    key = F.when(F.col("scale") == "large", F.concat(F.lit("large/"), F.col("idx"))).otherwise(F.col("idx").cast("string"))
    return transfer.calibrations(at.join(predicted, "idx").withColumn("key", key), "key", "scale", {t: (f"p_{t}", f"y_{t}") for t in LOSSES}, _REPS, "transfer")


@query("r7_scale_calibration", _FITS_SQL + f" SELECT scale, target, CAST(max(w) FILTER (rep = 0) AS BIGINT) AS n, max(intercept) FILTER (rep = 0) AS intercept, max(slope) FILTER (rep = 0) AS slope, max(pearson) FILTER (rep = 0) AS pearson, max(rmse) FILTER (rep = 0) AS rmse, quantile_cont(slope, 0.025) FILTER (rep > 0) AS low, quantile_cont(slope, 0.975) FILTER (rep > 0) AS high, {_REPS} - count(*) FILTER (rep > 0 AND slope > 0) AS invalid FROM fits GROUP BY scale, target", "intercept slope pearson rmse low high")
def _(spark, d):
    return transfer.intervals(_fits(spark, d), "scale", _REPS)


_X = "ln(CASE scale " + " ".join(f"WHEN '{s}' THEN {v!r}" for s, v in SIZES.items()) + " END)"
_N = len(SIZES)
_MEAN = "(" + " + ".join(f"ln({v!r})" for v in SIZES.values()) + f") / {_N}"
_SXX = "(" + " + ".join(f"power(ln({v!r}) - ({_MEAN}), 2)" for v in SIZES.values()) + ")"
_DECAY_SQL = _FITS_SQL + f""", each AS (SELECT rep, target, count(*) FILTER (slope > 0) AS scales, sum(({_X} - ({_MEAN})) * CASE WHEN slope > 0 THEN ln(slope) END) AS num, sum(CASE WHEN slope > 0 THEN ln(slope) * ln(slope) END) - power(sum(CASE WHEN slope > 0 THEN ln(slope) END), 2) / {_N} AS tss FROM fits GROUP BY rep, target)"""


@query("r7_target_decay", _DECAY_SQL + f" SELECT target, scales, CASE WHEN scales = {_N} THEN -num / {_SXX} END AS eta FROM each WHERE rep = 0", "eta")
def _(spark, d):
    return transfer.target_decays(_fits(spark, d), "scale", SIZES).where("rep = 0").select("target", "scales", "eta")


_DRAWN = " + ".join(f"CAST(floor({_U.format(chr(39) + 'decay-target|' + chr(39) + ' || rep || ' + chr(39) + f'|{j}' + chr(39))} * {_T}) = k AS INT)" for j in range(_T))


@query("r7_pooled_decay", _DECAY_SQL + f""", named AS (SELECT *, list_position({LOSSES!r}, target) - 1 AS k FROM each),
two AS (SELECT 'targets_and_rows' AS drawn, rep, k, scales, num, tss FROM named UNION ALL SELECT 'targets', r.rep, k, scales, num, tss FROM named, range({_REPS + 1}) r(rep) WHERE named.rep = 0),
m AS (SELECT *, CASE WHEN rep = 0 THEN 1 ELSE {_DRAWN} END AS m FROM two),
e AS (SELECT drawn, rep, CASE WHEN sum(CASE WHEN scales = {_N} THEN m ELSE 0 END) = {_T} THEN -sum(m * num) FILTER (scales = {_N}) / ({_T} * {_SXX}) END AS eta, power(sum(m * num) FILTER (scales = {_N}), 2) / ({_T} * {_SXX}) / sum(m * tss) FILTER (scales = {_N}) AS r2 FROM m GROUP BY drawn, rep),
o AS (SELECT drawn, max(eta) FILTER (rep = 0) AS eta, max(r2) FILTER (rep = 0 AND eta IS NOT NULL) AS r2, quantile_cont(eta, 0.025) FILTER (rep > 0) AS low, quantile_cont(eta, 0.5) FILTER (rep > 0) AS median, quantile_cont(eta, 0.975) FILTER (rep > 0) AS high, count(eta) FILTER (rep > 0) AS valid FROM e GROUP BY drawn)
SELECT drawn, eta, r2, CASE WHEN valid * 2 >= {_REPS} THEN low END AS low, CASE WHEN valid * 2 >= {_REPS} THEN median END AS median, CASE WHEN valid * 2 >= {_REPS} THEN high END AS high, valid, {_REPS} - valid AS invalid, CASE WHEN eta IS NULL THEN 'NOT_POSITIVE' WHEN valid * 2 < {_REPS} THEN 'TOO_FEW_VALID' ELSE 'OK' END AS status FROM o""", "eta r2 low median high")
def _(spark, d):
    """One decay for all targets with intervals by two kinds of draws."""
    return transfer.pooled_decay(_fits(spark, d), "scale", SIZES, LOSSES, _REPS, "decay")
