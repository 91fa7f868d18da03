"""Queries on the choice of a recipe under many weightings of the losses."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import functions as F

from mixlume.operators import selection
from mixlume.plans.entities import LOSSES, MIX, RECIPES_SQL
from mixlume.plans.mixture import _U, recipe_table
from mixlume.plans.registry import query

_T = len(LOSSES)
_E = "-ln(1 - " + _U.format("{}") + ")"
_ID = "'{kind}|' || i || '|' || t || '|"
_SPARSE = _ID.format(kind="sparse")
_WEIGHTS_SQL = f"""
ts AS (SELECT unnest({LOSSES!r}) AS t), ids AS (SELECT i, t FROM range(100) r(i), ts),
tries AS (SELECT i, t, k, power({_U.format(_SPARSE + "x|' || k")}, 1 / 0.2) AS x, power({_U.format(_SPARSE + "y|' || k")}, 1 / (1 - 0.2)) AS y FROM ids, range({selection.TRIES}) q(k)),
beta AS (SELECT i, t, arg_min(x / (x + y), k) AS b FROM tries WHERE x + y <= 1 AND x > 0 GROUP BY i, t),
g AS (SELECT 'sparse_' || lpad(CAST(i AS VARCHAR), 3, '0') AS scenario, t, ({_E.format(_SPARSE + "e'")}) * coalesce(b, 0.2) AS g FROM ids LEFT JOIN beta USING (i, t)
  UNION ALL SELECT 'balanced_' || lpad(CAST(i AS VARCHAR), 3, '0'), t, sum({_E.format(_ID.format(kind="balanced") + "' || k")}) FROM ids, range(5) q(k) GROUP BY i, t),
weights AS (SELECT scenario, t, g / sum(g) OVER (PARTITION BY scenario) AS w FROM g
  UNION ALL SELECT 'equal', t, 1.0 / {_T} FROM ts UNION ALL SELECT 'only_' || a.t, b.t, CAST(a.t = b.t AS INT) FROM ts a, ts b)"""
_WIDE = ", ".join(f"max(w) FILTER (t = '{t}') AS w{k}" for k, t in enumerate(LOSSES))
_MARGINAL = {t: " + ".join([f"avg_{t}", *[f"s_{t}_{m} * ({m} - a_{m})" for m in MIX]]) for t in LOSSES}
_GRID_SQL = f"""WITH {RECIPES_SQL}, {_WEIGHTS_SQL},
wide AS (SELECT scenario, {_WIDE} FROM weights GROUP BY scenario),
f AS (SELECT {", ".join(f"avg({t}) AS avg_{t}, " + ", ".join(f"regr_slope({t}, {m}) AS s_{t}_{m}" for m in MIX) for t in LOSSES)}, {", ".join(f"avg({m}) AS a_{m}" for m in MIX)} FROM rec),
rel AS (SELECT idx, 'observed' AS model, {", ".join(f"{t} / avg_{t} AS y{k}" for k, t in enumerate(LOSSES))}, loss_b <= avg_loss_b AS low_b, greatest({", ".join(MIX)}) <= 0.5 AS spread FROM rec, f
  UNION ALL SELECT idx, 'marginal', {", ".join(f"({x}) / avg_{t}" for t, x in _MARGINAL.items())}, loss_b <= avg_loss_b, greatest({", ".join(MIX)}) <= 0.5 FROM rec, f),
allowed AS (SELECT *, 'all' AS policy FROM rel UNION ALL SELECT *, 'low_b' FROM rel WHERE low_b UNION ALL SELECT *, 'spread' FROM rel WHERE spread UNION ALL SELECT *, 'low_b_spread' FROM rel WHERE low_b AND spread),
o AS (SELECT scenario, policy, model, idx, round({" + ".join(f"w{k} * y{k}" for k in range(_T))}, {selection.DIGITS}) AS s FROM allowed, wide),
grid AS (SELECT scenario, policy, model, arg_min(idx, (s, idx)) AS pick, min(s) AS objective, count(*) AS feasible FROM o GROUP BY scenario, policy, model)"""


@query("r16_weight_scenarios", f"WITH {_WEIGHTS_SQL} SELECT idx.scenario, idx.t AS target, idx.w AS weight, n.lines FROM weights idx, (SELECT count(*) AS lines FROM lineitem) n", "weight")
def _(spark, d):
    """The weightings, next to the number of lines whose losses they weight."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").agg(F.count("*").alias("lines"))
    w = selection.weight_scenarios(spark, LOSSES).select("scenario", F.posexplode("w").alias("k", "weight"))
    return w.select("scenario", F.element_at(F.array(*[F.lit(t) for t in LOSSES]), F.col("k") + 1).alias("target"), "weight").crossJoin(F.broadcast(lines))  # one row


def _grid(spark, d, weights=None):
    """Recipes under each weighting by observed losses and by a marginal model (mean plus a slope for each share), within four sets of allowed recipes."""
    rec = recipe_table(spark, d)
    slopes = [F.regr_slope(F.col(t), F.col(m)).alias(f"s_{t}_{m}") for t in LOSSES for m in MIX]
    f = rec.agg(*[F.avg(t).alias(f"avg_{t}") for t in LOSSES], *[F.avg(m).alias(f"a_{m}") for m in MIX], *slopes)
    rows = rec.crossJoin(F.broadcast(f))  # one row
    marginal = {t: reduce(lambda a, m: a + F.col(f"s_{t}_{m}") * (F.col(m) - F.col(f"a_{m}")), MIX, F.col(f"avg_{t}")) for t in LOSSES}
    models = {"observed": [F.col(t) / F.col(f"avg_{t}") for t in LOSSES], "marginal": [marginal[t] / F.col(f"avg_{t}") for t in LOSSES]}
    low_b, spread = F.col("loss_b") <= F.col("avg_loss_b"), F.greatest(*MIX) <= 0.5
    weights = weights or [(r["scenario"], list(r["w"])) for r in selection.weight_scenarios(spark, LOSSES).collect()]  # 205 rows, whatever the tables' size
    return selection.best_rows(rows, "idx", models, {"all": F.lit(True), "low_b": low_b, "spread": spread, "low_b_spread": low_b & spread}, weights)


@query("g16_selection_grid", _GRID_SQL + " SELECT * FROM grid", "objective")
def _(spark, d):
    return _grid(spark, d)


@query("g16_selection_stability", _GRID_SQL + """, e AS (SELECT policy, scenario, max(pick) FILTER (model = 'observed') AS a, max(pick) FILTER (model = 'marginal') AS b FROM grid GROUP BY 1, 2),
own AS (SELECT policy, a AS ea, b AS eb FROM e WHERE scenario = 'equal')
SELECT policy, count(*) AS scenarios, avg(CAST(a = b AS INT)) AS agreement, count(*) FILTER (a <> ea) AS flips_observed, count(*) FILTER (b <> eb) AS flips_marginal, count(DISTINCT a) AS picks_observed, count(DISTINCT b) AS picks_marginal FROM e JOIN own USING (policy) GROUP BY policy""", "agreement")
def _(spark, d):
    return selection.stability(_grid(spark, d), "observed", "marginal")


#: Each set of the losses with equal weights: 15 scenarios.
_PANEL = [("+".join(x), [1 / k if t in x else 0.0 for t in LOSSES]) for k in range(1, _T + 1) for x in combinations(LOSSES, k)]
_PANEL_SQL = _GRID_SQL.replace(_WEIGHTS_SQL + ",\nwide AS (SELECT scenario, " + _WIDE + " FROM weights GROUP BY scenario)", " wide AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {', '.join(f'{x!r}::DOUBLE' for x in w)})" for s, w in _PANEL) + ") v(scenario, " + ", ".join(f"w{k}" for k in range(_T)) + "))")


@query("g14_decision_panel", _PANEL_SQL + " SELECT scenario, policy, pick, objective, feasible FROM grid WHERE model = 'observed' AND policy <> 'low_b_spread'", "objective")
def _(spark, d):
    """The recipe chosen for each of 15 sets of losses under three policies: all recipes, those of a low second loss, those without a share above a half."""
    return _grid(spark, d, _PANEL).where("model = 'observed' and policy <> 'low_b_spread'").select("scenario", "policy", "pick", "objective", "feasible")
