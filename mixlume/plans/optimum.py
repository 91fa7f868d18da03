"""Queries on spending a budget: constrained optima, regimes, recipes with regret, free quality, transitions, assumptions and joint moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlume.operators import allocation, optimum
from mixlume.plans.entities import MIX, RECIPES_SQL
from mixlume.plans.mixture import recipe_table
from mixlume.plans.registry import query

REC = "WITH RECURSIVE " + RECIPES_SQL
#: Law (e, a, alpha, b, beta), bounds and attention of the scenarios; chosen so that every regime occurs among the budgets of the tables.
LAW, SIZES, TOKENS, ATTENTION = (1.0, 0.8, 0.5, 1.2, 0.4), (1.0, 50.0), (2.0, 120.0), 0.1
_E, _A, _AL, _B, _BE = LAW
_NMIN, _NMAX, _DMIN, _DMAX = *SIZES, *TOKENS


def _solved(source: str) -> str:
    """CTEs from ``source`` (rid, budget, c, h, a, al, b, be and more) to ``sx``, which adds n, d and active: bisection as a recursion."""
    per = "(c * exp({x}) + h)"
    slope = lambda x: f"(-al * a * exp(-al * {x}) + CASE WHEN budget / {per.format(x=x)} >= {_DMAX} THEN 0 ELSE be * b * power(budget / {per.format(x=x)}, -be) * c * exp({x}) / {per.format(x=x)} END)"
    near = lambda x, y, name: f"CASE WHEN abs({x} - {y}) <= 1e-8 * greatest(abs({x}), abs({y})) THEN '{name}' END"
    top = f"greatest({_NMIN}, least({_NMAX}, (budget / {_DMIN} - h) / c))"
    marks = ", ".join([near("n", _NMIN, "N_min"), near("n", _NMAX, "N_max"), near("d", _DMIN, "D_min"), near("d", _DMAX, "D_max"), near("d * (c * n + h)", "budget", "budget")])
    return f"""
 fe AS (SELECT *, ln({_NMIN}) AS x0, ln({top}) AS x1, budget >= {_DMIN} * (c * {_NMIN} + h) * (1 - 1e-12) AS ok FROM {source}),
 bi AS (SELECT rid, budget, c, h, a, al, b, be, x0 AS lo, x1 AS hi, 0 AS i FROM fe WHERE ok
   UNION ALL SELECT rid, budget, c, h, a, al, b, be, CASE WHEN {slope('((lo + hi) / 2)')} < 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {slope('((lo + hi) / 2)')} < 0 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM bi WHERE i < 60),
 so AS (SELECT fe.*, CASE WHEN NOT ok THEN NULL WHEN {slope('x0').replace(' c ', ' fe.c ')} >= 0 THEN {_NMIN} WHEN {slope('x1')} <= 0 THEN {top} ELSE exp((lo + hi) / 2) END AS n FROM fe LEFT JOIN (SELECT rid AS r, lo, hi FROM bi WHERE i = 60) ON r = rid),
 sd AS (SELECT *, CASE WHEN n IS NOT NULL THEN greatest({_DMIN}, least({_DMAX}, budget / (c * n + h))) END AS d FROM so),
 sx AS (SELECT *, CASE WHEN n IS NOT NULL THEN array_to_string(list_filter([{marks}], lambda x: x IS NOT NULL), ';') END AS active FROM sd)"""


#: Budgets are so many hundredths of a recipe's squared lines. A context is ten mean losses to one digit, halves up: exactly, as engines round halves differently.
_BUDGETS = (1, 10, 100, 1000, 4000)
_CONTEXT = "floor(loss_c * 100e0 + 0.500000001e0) / 10e0"
_G5 = REC + f""", s AS (SELECT DISTINCT CAST(n_lines * n_lines * m AS DOUBLE) / 100e0 AS budget, {_CONTEXT} AS context FROM rec, (SELECT unnest({list(_BUDGETS)}) AS m)),
 src AS (SELECT row_number() OVER () AS rid, budget, context, 6 + {ATTENTION} * context AS c, 0.0 AS h, {_A} AS a, {_AL} AS al, {_B} AS b, {_BE} AS be FROM s),""" + _solved("src")
_G5 += f" SELECT budget, context, CASE WHEN n IS NULL THEN 'INFEASIBLE' ELSE 'OK' END AS status, n, d, active, {_E} + {_A} * power(n, -{_AL}) + {_B} * power(d, -{_BE}) AS loss, c * n * d < budget * (1 - 1e-9) AS slack FROM sx"


def _budgets(spark: SparkSession, d: str) -> DataFrame:
    lines = F.col("n_lines").cast("double")
    every = F.explode(F.array(*[lines * lines * m / 100 for m in _BUDGETS])).alias("budget")
    return recipe_table(spark, d).select(every, F.expr(_CONTEXT).alias("context")).distinct()


@query("g5_bounded_optimum", _G5, "budget context n d loss")
def _(spark, d):
    """The optimum of each budget and context that occurs, between the bounds and with slack beyond them."""
    return optimum.bounded_optimum(_budgets(spark, d), LAW, SIZES, TOKENS, ATTENTION)


@query("g4_regimes", f"SELECT coalesce(active, 'INFEASIBLE') AS regime, count(*) AS scenarios, count(*) FILTER (slack) AS slack, min(budget) AS from_budget, max(budget) AS to_budget, avg(n) AS mean_size FROM ({_G5}) GROUP BY 1", "from_budget to_budget mean_size")
def _(spark, d):
    """Which bounds the optimum of each budget and context meets, and over which budgets."""
    best = optimum.bounded_optimum(_budgets(spark, d), LAW, SIZES, TOKENS, ATTENTION)
    return best.groupBy(F.coalesce("active", F.lit("INFEASIBLE")).alias("regime")).agg(F.count("*").alias("scenarios"), F.count_if("slack").alias("slack"), F.min("budget").alias("from_budget"), F.max("budget").alias("to_budget"), F.avg("n").alias("mean_size"))


_GAMMA, _Q0, _BRIDGE, _FIXED = 0.7, 0.3, 1.0, 1
_SCENARIOS = [{"budget": b, "context": c, "family": f, "q0": _Q0} for b in (10.0, 40.0, 600.0, 60000.0) for c in (0.0, 20.0) for f in ("exp", "power", "log")]
_COST = "CASE family WHEN 'exp' THEN exp({q}) - 1 WHEN 'power' THEN {q} * {q} ELSE ln(1 + {q}) END"
_G7 = REC + ", p AS (SELECT idx, least(1.0, greatest(0.0, (loss_b - 0.02) / 0.037)) AS q, loss_a - 0.05 AS effect FROM rec), s AS (SELECT * FROM (VALUES " + ", ".join(f"({s['budget']}, {s['context']}, '{s['family']}', {s['q0']})" for s in _SCENARIOS) + ") v(budget, context, family, q0))"
_G7 += f""", src AS (SELECT row_number() OVER () AS rid, p.*, budget::DOUBLE AS budget, context::DOUBLE AS context, family, q0::DOUBLE AS q0, 6 + {ATTENTION} * context AS c, greatest(0.0, ({_COST.format(q='q')}) - ({_COST.format(q='q0')})) AS h, {_A} AS a, {_AL} AS al, {_B} * exp(-{_GAMMA} * q) AS b, {_BE} AS be FROM p, s),
 able AS (SELECT * FROM src WHERE q >= q0 - 1e-12),""" + _solved("able")
_G7 += f""", al AS (SELECT src.idx, src.q, src.budget, src.context, src.family, src.q0, CASE WHEN src.q < src.q0 - 1e-12 THEN 'BELOW_Q0' WHEN n IS NULL THEN 'INFEASIBLE' ELSE 'OK' END AS status, n, d, active,
  ({_E} + src.a * power(n, -{_AL}) + src.b * power(d, -{_BE})) * exp({_BRIDGE} * src.effect) AS loss FROM src LEFT JOIN sx ON sx.rid = src.rid)"""
_G6 = _G7 + " SELECT budget, context, family, status, active, count(*) AS recipes, avg(n) AS mean_size, avg(d) AS mean_tokens, min(loss) AS least_loss FROM al GROUP BY ALL"
_G7 += f""", g AS (SELECT budget, context, family, q0, count(*) FILTER (status IN ('OK', 'INFEASIBLE')) AS eligible, count(*) FILTER (status = 'OK') AS feasible, max(status) FILTER (idx = {_FIXED}) AS fixed_status, max(loss) FILTER (idx = {_FIXED}) AS fixed_loss FROM al GROUP BY ALL),
 t AS (SELECT * FROM al WHERE status = 'OK' QUALIFY row_number() OVER (PARTITION BY budget, context, family ORDER BY round(loss, 12), idx) = 1)
 SELECT g.budget, g.context, g.family, g.q0, CASE WHEN feasible > 0 THEN 'OK' WHEN eligible > 0 THEN 'INFEASIBLE' ELSE 'NO_ELIGIBLE_RECIPE' END AS status, eligible, feasible, t.idx, n, d, t.q, active, loss, fixed_status, fixed_loss - loss AS regret
 FROM g LEFT JOIN t ON t.budget = g.budget AND t.context = g.context AND t.family = g.family"""


def _allocated(spark: SparkSession, d: str) -> DataFrame:
    q, _ = allocation.quality_proxy(F.col("loss_b"), 0.02, 0.057)
    recipes = recipe_table(spark, d).select("idx", q.alias("q"), (F.col("loss_a") - 0.05).alias("effect"))
    return optimum.allocate(recipes, _SCENARIOS, (*LAW, _GAMMA), SIZES, TOKENS, ATTENTION, _BRIDGE)


@query("g6_fixed_recipe_allocation", _G6, "budget context mean_size mean_tokens least_loss")
def _(spark, d):
    """Every recipe's own optimum in each scenario of budget, context and cost family, by status and active bounds."""
    return _allocated(spark, d).groupBy("budget", "context", "family", "status", "active").agg(F.count("*").alias("recipes"), F.avg("n").alias("mean_size"), F.avg("d").alias("mean_tokens"), F.min("loss").alias("least_loss"))


@query("g6_g7_joint_allocation", _G7, "budget context q0 n d q loss regret")
def _(spark, d):
    """The best recipe, size and tokens for each scenario, and the regret of staying with one recipe: a row for each scenario, with a status where nothing fits."""
    return optimum.best_recipe(_allocated(spark, d), _FIXED)


@query("g8_quality_sensitivity", None, "budget context q0 q n d loss")
def _(spark, d):
    """The best independent quality, size and tokens of each budget and context that occurs, for each cost family."""
    s = _budgets(spark, d).select("budget", "context", F.explode(F.array(F.lit("exp"), F.lit("power"), F.lit("log"))).alias("family"), F.lit(_Q0).alias("q0"))
    return optimum.free_quality(s, (*LAW, _GAMMA), SIZES, TOKENS, ATTENTION)


_REGIME = f"""CASE WHEN b < {_DMIN * _NMIN} * c * (1 - 1e-12) THEN 'INFEASIBLE' WHEN b > {_NMAX * _DMAX} * c THEN 'N_max;D_max'
 WHEN {_BE * _B} * power(b / (c * greatest({_NMIN}, b / (c * {_DMAX}))), -{_BE}) >= {_AL * _A} * power(greatest({_NMIN}, b / (c * {_DMAX})), -{_AL}) THEN CASE WHEN b / (c * {_DMAX}) > {_NMIN} THEN 'D_max;budget' ELSE 'N_min;budget' END
 WHEN {_BE * _B} * power(b / (c * least({_NMAX}, b / (c * {_DMIN}))), -{_BE}) <= {_AL * _A} * power(least({_NMAX}, b / (c * {_DMIN})), -{_AL}) THEN CASE WHEN b / (c * {_DMIN}) < {_NMAX} THEN 'D_min;budget' ELSE 'N_max;budget' END ELSE 'budget' END"""
_G10 = REC + f""", k AS (SELECT DISTINCT {_CONTEXT} AS context FROM rec), x AS (SELECT context, 6 + {ATTENTION} * context AS c, i, power(10, i / 1000.0) AS b FROM k, range(500, 6501) r(i)),
 s AS (SELECT context, i, {_REGIME} AS state FROM x), t AS (SELECT *, lead(state) OVER (PARTITION BY context ORDER BY i) AS later FROM s)
 SELECT context, i AS cell, state AS from_state, later AS to_state FROM t WHERE later IS NOT NULL AND state <> later"""


@query("g10_transitions", _G10, "context")
def _(spark, d):
    """Where on the axis of log budgets the active bounds change, for each context that occurs: brackets below 1e-7, given as thousandths."""
    contexts = recipe_table(spark, d).select(F.expr(_CONTEXT).alias("context")).distinct()
    _, a, alpha, b, beta = LAW

    def state(x):
        found = optimum.solve(F.pow(F.lit(10.0), x), 6 + ATTENTION * F.col("context"), F.lit(0.0), (a, alpha, b, beta), SIZES, TOKENS, 1e-12)
        return F.coalesce(found["active"], found["status"])

    t = optimum.transitions(contexts, F.lit(0.5), F.lit(6.5), state, 1e-7)
    return t.select("context", F.floor((F.col("lo") + F.col("hi")) * 500).alias("cell"), "from_state", "to_state")


_FACTORS = {"scale": 1.0, "beta": _BE, "context": 1.0}
_VARIANTS = {"scale": [0.5, 2.0], "beta": [0.2, 0.8], "context": [0.0, 40.0]}
_ROWS = [("base", _FACTORS)] + [(f"{k}={v:g}", _FACTORS | {k: v}) for k, vs in _VARIANTS.items() for v in vs]
_G11 = REC + ", g AS (SELECT * FROM (VALUES " + ", ".join(f"('{name}', {v['scale']}, {v['beta']}, {v['context']})" for name, v in _ROWS) + f""") v(scenario, scale, beta, context)),
 src AS (SELECT row_number() OVER () AS rid, idx, scenario, (n_lines * n_lines * 0.3 * scale)::DOUBLE AS budget, 6 + {ATTENTION} * context * loss_c * 10 AS c, 0.0 AS h, {_A} AS a, {_AL} AS al, {_B} AS b, beta::DOUBLE AS be FROM rec, g),""" + _solved("src")
_G11 += ", st AS (SELECT idx, scenario, coalesce(active, 'INFEASIBLE') AS state FROM sx) SELECT x.scenario, count(*) AS cells, count(*) FILTER (x.state <> y.state) AS changed FROM st x JOIN st y ON x.idx = y.idx AND y.scenario = 'base' GROUP BY x.scenario"


@query("g11_assumption_grid", _G11)
def _(spark, d):
    """Each assumption changed alone: how many recipes' optima leave the bounds that they meet in the base."""
    grid = [F.struct(F.lit(name).alias("scenario"), *[F.lit(float(v[k])).alias(k) for k in _FACTORS]) for name, v in _ROWS]
    lines = F.col("n_lines").cast("double")
    x = recipe_table(spark, d).select("idx", (lines * lines * 0.3).alias("lines"), (F.col("loss_c") * 10).alias("own"), F.inline(F.array(*grid)))
    _, a, alpha, b, _ = LAW
    found = optimum.solved(F.col("lines") * F.col("scale"), 6 + ATTENTION * F.col("context") * F.col("own"), F.lit(0.0), (a, alpha, b, F.col("beta")), SIZES, TOKENS)
    states = x.select("idx", "scenario", F.coalesce(found["active"], found["status"]).alias("state"))
    whole = states.groupBy("idx").agg(F.max(F.when(F.col("scenario") == "base", F.col("state"))).alias("at_base"), F.collect_list(F.struct("scenario", "state")).alias("each"))  # a scenario each
    return whole.select("at_base", F.inline("each")).groupBy("scenario").agg(F.count("*").alias("cells"), F.count_if(F.col("state") != F.col("at_base")).alias("changed"))


_MOVES, _STEPS = [(MIX[1], MIX[2]), (MIX[1], MIX[3]), (MIX[4], MIX[5])], (0.002, 0.01)
_M26 = REC + ", l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS domain, sum({m} * loss_a) / sum({m}) AS raw FROM rec" for m in MIX) + "), v AS (SELECT domain, (raw - (SELECT min(raw) FROM l)) / (SELECT max(raw) - min(raw) FROM l) AS v FROM l)"
_M26 += ", r AS (SELECT idx, " + MIX[0] + " AS donor, " + " + ".join(f"{m} * (SELECT v FROM v WHERE domain = '{m}')" for m in MIX) + " AS s FROM rec), c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {s})" for a, b in _MOVES for s in _STEPS) + ") c(left_domain, right_domain, step))"
_M26 += f", x AS (SELECT r.*, c.*, step * (p.v - o.v) AS a, step * (q.v - o.v) AS b FROM r, c JOIN v p ON p.domain = left_domain JOIN v q ON q.domain = right_domain JOIN v o ON o.domain = '{MIX[0]}')"
_M26 += ", y AS (SELECT *, donor < 2 * step AS short, exp(-4 * s) * (exp(-4 * a) - 1) AS dl, exp(-4 * s) * (exp(-4 * b) - 1) AS dr, exp(-4 * s) * (exp(-4 * (a + b)) - 1) AS dj FROM x)"
_M26 += " SELECT idx, left_domain, right_domain, step, CASE WHEN NOT short THEN dl * 1000 END AS delta_left, CASE WHEN NOT short THEN dr * 1000 END AS delta_right, CASE WHEN NOT short THEN dj * 1000 END AS delta_joint, CASE WHEN NOT short THEN (dj - dl - dr) * 1000 END AS contrast, CASE WHEN short THEN 'DONOR_SHORT' WHEN dj - dl - dr < -1e-10 THEN 'COMPLEMENTARY' WHEN dj - dl - dr > 1e-10 THEN 'SUBSTITUTIVE' ELSE 'NEUTRAL' END AS label FROM y"


@query("m26_joint_contrast", _M26, "step delta_left delta_right delta_joint contrast")
def _(spark, d):
    """Two shares that grow at one donor's cost, together against apart, on a loss that falls exponentially in the mixture's value; a domain's value comes from the recipes that hold it (thousandths)."""
    rec = recipe_table(spark, d)
    raw = rec.agg(*[(F.sum(F.col(m) * F.col("loss_a")) / F.sum(m)).alias(m) for m in MIX]).first()  # a number for each domain
    low, high = min(raw), max(raw)
    values = {m: (raw[m] - low) / (high - low) for m in MIX}

    def loss(share):
        return 1 + F.exp(-4 * sum((share[m] * values[m] for m in MIX[1:]), share[MIX[0]] * values[MIX[0]]))

    x = optimum.move_contrasts(rec, MIX, loss, MIX[0], _MOVES, list(_STEPS))
    return x.withColumns({c: F.col(c) * 1000 for c in ("delta_left", "delta_right", "delta_joint", "contrast")})
