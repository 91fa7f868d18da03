"""Queries on data mixtures, losses, scaling fits and budget grids, over customers as recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixlume.functions import expr
from mixlume.operators import budget, mixture, moments, nearest, pairs, resample, stats
from mixlume.plans.entities import LOSSES, MIX, RECIPES_SQL, RUNS_SQL, keep, recipes, runs
from mixlume.plans.registry import query

REC = "WITH " + RECIPES_SQL


def recipe_table(spark: SparkSession, d: str) -> DataFrame:
    return keep(spark, d, "recipes", lambda: recipes(spark, d))


@query("p10_p11_composition", REC + f" SELECT idx, {', '.join(MIX)}, abs({' + '.join(MIX)} - 1) < 1e-9 AS valid FROM rec", " ".join(MIX))
def _(spark, d):
    r = mixture.normalised(recipe_table(spark, d), MIX)
    return r.select("idx", *MIX, mixture.is_composition(MIX).alias("valid"))


_TOP_VAR = REC + ", v AS (" + " UNION ALL ".join(f"SELECT '{m}' AS domain, var_pop({m}) AS var FROM rec" for m in MIX) + ")"


@query("p12_interaction_domains", _TOP_VAR + " SELECT domain, var FROM v ORDER BY var DESC, domain LIMIT 5", "var")
def _(spark, d):
    return mixture.most_variable(recipe_table(spark, d), MIX, 5)


@query("ag35_effective_domains", REC + f" SELECT idx, exp(-({' + '.join(f'CASE WHEN {m} > 0 THEN {m} * ln({m}) ELSE 0 END' for m in MIX)})) AS effective, {' + '.join(f'CAST({m} > 0 AS INT)' for m in MIX)} AS domains, greatest({', '.join(MIX)}) AS largest FROM rec", "effective largest")
def _(spark, d):
    return recipe_table(spark, d).select("idx", *mixture.spread(MIX))


_QUALITY = {"mix_economy": ("direct", 0.4), "mix_standard": ("direct", -0.2), "mix_promo": ("near_direct", 0.7), "mix_small": ("inferred", None), "mix_medium": ("direct", 0.1), "mix_large": ("inferred", None)}
_KNOWN = [m for m in MIX if _QUALITY[m][1] is not None]


@query("j3_ag36_quality_coverage", REC + f" SELECT idx, CASE WHEN ({' + '.join(_KNOWN)}) > 0 THEN ({' + '.join(f'{m} * {_QUALITY[m][1]}' for m in _KNOWN)}) / ({' + '.join(_KNOWN)}) END AS quality, {' + '.join(m for m in MIX if m not in _KNOWN)} AS unknown_share, CASE WHEN ({' + '.join(m for m in MIX if m not in _KNOWN)}) > 1e-9 THEN 'PARTIAL_UNKNOWN' ELSE 'COMPLETE' END AS status FROM rec", "quality unknown_share")
def _(spark, d):
    mapping = spark.createDataFrame([(k, t, q) for k, (t, q) in _QUALITY.items()], "domain string, mapping_type string, quality double")
    return mixture.quality_coverage(mixture.long(recipe_table(spark, d), "idx", MIX), mapping)


@query("j6_composition_overlap", REC + f", k AS (SELECT idx % 2 AS scope, concat_ws('|', {', '.join(f'CAST(CAST(round({m}, 1) * 10 AS BIGINT) AS VARCHAR)' for m in MIX)}) AS key FROM rec) SELECT count(*) AS shared FROM (SELECT DISTINCT key FROM k WHERE scope = 0 INTERSECT SELECT DISTINCT key FROM k WHERE scope = 1)")
def _(spark, d):
    k = recipe_table(spark, d).select((F.col("idx") % 2).alias("scope"), mixture.composition_key(MIX, 1).alias("key"))
    return k.where("scope = 0").select("key").intersect(k.where("scope = 1").select("key")).agg(F.count("*").alias("shared"))


_DIST = " + ".join(f"power(a.{m} - b.{m}, 2)" for m in MIX)


@query("j9_nearest_recipe", REC + f" SELECT a.idx, arg_min(b.idx, (round(sqrt({_DIST}), 9), b.idx)) AS nearest, min(sqrt({_DIST})) AS distance FROM (SELECT * FROM rec WHERE idx % 50 = 0) a JOIN rec b ON a.idx <> b.idx GROUP BY a.idx", "distance")
def _(spark, d):
    r = recipe_table(spark, d)
    return nearest.nearest(r.where("idx % 50 = 0"), r, "idx", MIX)


@query("j9_nearest_of_all", REC + f" SELECT a.idx, arg_min(b.idx, (round(sqrt({_DIST}), 9), b.idx)) AS nearest, min(sqrt({_DIST})) AS distance FROM rec a JOIN rec b ON a.idx <> b.idx GROUP BY a.idx", "distance")
def _(spark, d):
    """Each recipe's nearest other recipe, all rows against all rows."""
    r = recipe_table(spark, d)
    return nearest.nearest(r, r, "idx", MIX)


@query("t3_top_shares", REC + ", l AS (" + " UNION ALL ".join(f"SELECT idx, '{m}' AS domain, {m} AS share FROM rec" for m in MIX) + ") SELECT idx, string_agg(domain, ';' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY round(share, 9) DESC, domain) AS r FROM l) WHERE r <= 3 GROUP BY idx")
def _(spark, d):
    entries = F.array(*[F.struct((-F.round(F.col(m), 9)).alias("s"), F.lit(m).alias("domain")) for m in MIX])
    return recipe_table(spark, d).select("idx", F.array_join(F.transform(F.slice(F.array_sort(entries), 1, 3), lambda x: x["domain"]), ";").alias("top"))


@query("j12_pareto_front", REC + " SELECT idx FROM rec a WHERE NOT EXISTS (SELECT 1 FROM rec b WHERE b.loss_a <= a.loss_a AND b.loss_b <= a.loss_b AND b.loss_c <= a.loss_c AND (b.loss_a < a.loss_a OR b.loss_b < a.loss_b OR b.loss_c < a.loss_c))")
def _(spark, d):
    return pairs.front(recipe_table(spark, d), LOSSES[:3]).select("idx")


@query("t6_best_per_target", REC + ", l AS (" + " UNION ALL ".join(f"SELECT '{t}' AS target, idx, {t} AS loss FROM rec" for t in LOSSES) + ") SELECT target, arg_min(idx, (round(loss, 9), idx)) AS best, min(loss) AS loss FROM l GROUP BY target", "loss")
def _(spark, d):
    return mixture.best_per_target(recipe_table(spark, d), "idx", LOSSES)


@query("ag31_paired_correlation", REC + ", l AS (" + " UNION ALL ".join(f"SELECT '{a}_{b}' AS pair, {a} AS x, {b} AS y FROM rec" for a, b in (("loss_a", "loss_b"), ("loss_c", "loss_d"))) + ") SELECT pair, count(*) AS n, corr(x, y) AS pearson FROM l GROUP BY pair", "pearson")
def _(spark, d):
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("loss_a", "loss_b"), ("loss_c", "loss_d"))]))
    return recipe_table(spark, d).select(pairs.alias("p")).groupBy("p.pair").agg(F.count("*").alias("n"), F.corr("p.x", "p.y").alias("pearson"))


_GRAM = [*MIX[:3], "loss_a"]


@query("m2_moments", REC + " SELECT count(*) AS n, " + ", ".join(f"sum({a} * {b}) AS s_{i}_{i + j}" for i, a in enumerate(_GRAM) for j, b in enumerate(_GRAM[i:])) + " FROM rec", " ".join(f"s_{i}_{j}" for i in range(4) for j in range(i, 4)))
def _(spark, d):
    g = moments.gram(recipe_table(spark, d), [], MIX[:3], ["loss_a"])
    names = [(i, j) for i in range(5) for j in range(i, 5)]
    return g.select("n", *[F.col("g")[k].alias(f"s_{i - 1}_{j - 1}") for k, (i, j) in enumerate(names) if i])


@query("m2_ridge", None, "beta")
def _(spark, d):
    return moments.fit(moments.gram(recipe_table(spark, d), [], MIX[:5], LOSSES), [], MIX[:5], LOSSES, (0.0, 1.0))


@query("r10_cross_validation", None, "rmse")
def _(spark, d):
    return mixture.cross_validate(recipe_table(spark, d), "idx", MIX[:5], LOSSES, (0.01, 0.1, 1.0, 10.0), 5)


@query("m3_interaction_model", None, "beta")
def _(spark, d):
    rec = recipe_table(spark, d)
    varied = [r["domain"] for r in mixture.most_variable(rec, MIX, 5).collect()]  # five names
    r = mixture.with_interactions(rec, varied)
    x = [*MIX[:5], *mixture.interaction_names(varied)]
    return moments.fit(moments.gram(r, [], x, LOSSES), [], x, LOSSES, (0.1,))


_COEF = {"loss_a": [0.05, 0.01, -0.02, 0.03, 0.0, 0.02, -0.01], "loss_b": [0.04, -0.01, 0.02, 0.01, -0.03, 0.0, 0.01]}
_PRED = {t: f"{c[0]} + " + " + ".join(f"{m} * {b}" for m, b in zip(MIX, c[1:])) for t, c in _COEF.items()}


@query("m6_predictions", REC + f" SELECT idx, {', '.join(f'{p} AS {t}, ({p}) / {_COEF[t][0]} - 1 AS rel_{t}' for t, p in _PRED.items())} FROM rec", "loss_a loss_b rel_loss_a rel_loss_b")
def _(spark, d):
    return mixture.predict(recipe_table(spark, d).select("idx", *MIX), MIX, _COEF)


@query("g13_g14_decisions", REC + f", p AS (SELECT idx, loss_d, ({_PRED['loss_a']}) / 0.05 - 1 AS a, ({_PRED['loss_b']}) / 0.04 - 1 AS b FROM rec), s AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS w), f AS (SELECT w, idx, w * a + (1 - w) * b AS weighted, greatest(a, b) AS worst, loss_d FROM p, s) SELECT w, arg_min(idx, (round(weighted, 9), idx)) AS weighted_pick, arg_min(idx, (round(worst, 9), idx)) AS minimax_pick, arg_min(idx, (round(weighted, 9), idx)) FILTER (loss_d <= 0.7) AS capped_pick FROM f GROUP BY w", "w")
def _(spark, d):
    p = mixture.predict(recipe_table(spark, d).select("idx", "loss_d", *MIX), MIX, _COEF)
    return mixture.decide(p, "idx", "rel_loss_a", "rel_loss_b", [0.0, 0.25, 0.5, 0.75, 1.0], F.col("loss_d") <= 0.7)


@query("g15_protected_target", REC + " SELECT arg_min(idx, (round(loss_a, 9), idx)) AS pick, min(loss_a) AS loss_a, count(*) AS feasible FROM rec WHERE loss_b <= 0.04 AND loss_c <= 0.55", "loss_a")
def _(spark, d):
    ok = recipe_table(spark, d).where("loss_b <= 0.04 and loss_c <= 0.55")
    return ok.agg(F.min_by("idx", F.struct(F.round("loss_a", 9), F.col("idx"))).alias("pick"), F.min("loss_a").alias("loss_a"), F.count("*").alias("feasible"))


@query("g17_heldout_choice", None, "regret")
def _(spark, d):
    """Each fold's choice by a fit on the other folds."""
    return mixture.heldout_choices(recipe_table(spark, d), "idx", MIX[:5], "loss_a", 5, 0.1)


@query("g18_rank_correlation", REC + f", p AS (SELECT idx, loss_a AS y, {_PRED['loss_a']} AS x FROM rec), r AS (SELECT rank() OVER (ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY round(x, 9)) - 1) / 2.0 AS a, rank() OVER (ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY round(y, 9)) - 1) / 2.0 AS b FROM p) SELECT count(*) AS n, corr(a, b) AS rho FROM r", "rho")
def _(spark, d):
    p = mixture.predict(recipe_table(spark, d).select("idx", F.round("loss_a", 9).alias("actual"), *MIX), MIX, _COEF)
    return stats.spearman(p.withColumn("x", F.round("loss_a", 9)), [], "x", "actual")


@query("g19_recipe_panel", REC + ", z AS (SELECT idx, " + ", ".join(f"({t} - avg({t}) OVER ()) / stddev_samp({t}) OVER () AS z_{t}" for t in LOSSES) + f" FROM rec) SELECT idx, {', '.join(f'z_{t}' for t in LOSSES)}, greatest({', '.join(f'z_{t}' for t in LOSSES)}) AS worst, {' AND '.join(f'z_{t} < 0' for t in LOSSES)} AS all_improve FROM z", " ".join(f"z_{t}" for t in LOSSES) + " worst")
def _(spark, d):
    return mixture.panel(recipe_table(spark, d), "idx", LOSSES)


_U = "(CAST('0x' || substr(sha256({}), 1, 12) AS BIGINT) / 281474976710656.0)"


@query("r9_subsample_stability", REC + ", h AS (SELECT rep, idx, loss_a, row_number() OVER (PARTITION BY rep ORDER BY " + _U.format("'sub|' || rep || '|' || idx") + ", idx) AS r, count(*) OVER (PARTITION BY rep) AS n FROM rec, range(10) g(rep)), c AS (SELECT rep, arg_min(idx, (round(loss_a, 9), idx)) AS pick FROM h WHERE r <= floor(n * 8 / 10) GROUP BY rep) SELECT pick, count(*) AS reps FROM c GROUP BY pick")
def _(spark, d):
    return mixture.subsample_picks(recipe_table(spark, d), "idx", "loss_a", 10, "sub")


@query("m9_classic_law", None, "e a alpha b beta loss")
def _(spark, d):
    return budget.fit_classic(runs(spark, d).withColumn("group", F.floor(F.col("n") / 10)))


_LAW = (1.05, 2.5, 0.9, 0.1, 0.3)


@query("m10_classic_predictions", "WITH " + RUNS_SQL + f", p AS (SELECT CAST(n AS BIGINT) % 4 AS g, loss, {_LAW[0]} + {_LAW[1]} * power(n, -{_LAW[2]}) + {_LAW[3]} * power(d, -{_LAW[4]}) AS pred FROM run) SELECT g, count(*) AS n, sqrt(avg(power(pred - loss, 2))) AS rmse, avg(pred - loss) AS bias FROM p GROUP BY g", "rmse bias")
def _(spark, d):
    pred = budget.classic(F.col("n"), F.col("d"), *_LAW)
    p = runs(spark, d).select((F.col("n").cast("long") % 4).alias("g"), (pred - F.col("loss")).alias("e"))
    return p.groupBy("g").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"))


@query("m14_scale_calibration", "WITH " + RUNS_SQL + " SELECT CAST(n AS BIGINT) % 5 AS scale, regr_slope(loss, ln(d)) AS slope, regr_intercept(loss, ln(d)) AS intercept, count(*) AS n FROM run GROUP BY 1", "slope intercept")
def _(spark, d):
    r = runs(spark, d).select((F.col("n").cast("long") % 5).alias("scale"), F.ln("d").alias("x"), F.col("loss").alias("y"))
    return moments.slope(r, ["scale"], "y", "x").select("scale", "slope", "intercept", "n")


_COST = "CASE family WHEN 'exp' THEN exp(q) - 1 WHEN 'power' THEN q * q ELSE ln(1 + q) END"


@query("g1_g2_quality_cost", REC + f", s AS (SELECT idx, family, loss_c AS q, 1 + loss_d AS size FROM rec, (SELECT unnest(['exp', 'power', 'log']) AS family)) SELECT idx, family, {_COST} AS cost, 6 * size * 20 + 0.1 * size * 2 + greatest(0.0, ({_COST}) - ({_COST.replace('(q)', '(0.5)').replace('q * q', '0.25').replace('1 + q', '1.5')})) * 20 AS total FROM s", "cost total")
def _(spark, d):
    s = recipe_table(spark, d).select("idx", F.explode(F.array(F.lit("exp"), F.lit("power"), F.lit("log"))).alias("family"), F.col("loss_c").alias("q"), (1 + F.col("loss_d")).alias("size"))
    cost = expr.quality_cost(F.col("q"), F.col("family"))
    return s.select("idx", "family", cost.alias("cost"), budget.total_cost(F.col("size"), F.lit(20.0), F.lit(2.0), F.col("q"), F.lit(0.5), F.col("family")).alias("total"))


@query("g12_budget_choice", REC + ", b AS (SELECT unnest([5.0, 20.0, 60.0, 200.0]) AS budget), f AS (SELECT budget, idx, loss_a, loss_b, n_lines FROM rec, b WHERE n_lines <= budget) SELECT budget, arg_min(idx, (round(loss_a, 9), idx)) AS pick, arg_min(idx, (round(loss_b, 9), idx)) AS best, arg_min(loss_b, (round(loss_a, 9), idx)) - min(loss_b) AS regret FROM f GROUP BY budget", "budget regret")
def _(spark, d):
    budgets = spark.sql("select explode(array(5.0D, 20.0D, 60.0D, 200.0D)) as budget")
    return budget.choose_within(recipe_table(spark, d), budgets, "idx", "n_lines", "loss_a", "loss_b")


@query("g9_budget_scan", None, "budget d_tokens loss")
def _(spark, d):
    """161 budgets between those of the smallest and largest runs: the best size under C = 6 N D on the law's parameters."""
    return budget.scan(runs(spark, d), _LAW, 161)


@query("m24_equal_loss_root", None, "target n")
def _(spark, d):
    r = runs(spark, d).select("n", "d", (budget.classic(F.col("n"), F.col("d"), *_LAW) + 0.01).alias("target"))
    return r.select("d", "target", budget.size_for_loss(F.col("target"), F.col("d"), _LAW).alias("n"))


_FITTED = "f AS (SELECT regr_intercept(loss_a, mix_economy) AS a1, regr_slope(loss_a, mix_economy) AS b1, regr_intercept(loss_a, mix_standard) AS a2, regr_slope(loss_a, mix_standard) AS b2 FROM rec)"


@query("r6_paired_bootstrap", REC + ", " + _FITTED + ", w AS (SELECT rep, idx, power(loss_a - a1 - b1 * mix_economy, 2) - power(loss_a - a2 - b2 * mix_standard, 2) AS g, " + _U.format("'pair|' || rep || '|' || idx") + " AS u FROM rec, f, range(30) r(rep)), c AS (SELECT *, CAST(u >= 0.36787944117144233 AS INT) + CAST(u >= 0.7357588823428847 AS INT) + CAST(u >= 0.9196986029286058 AS INT) + CAST(u >= 0.9810118431238462 AS INT) + CAST(u >= 0.9963401531726563 AS INT) + CAST(u >= 0.9994058151824183 AS INT) AS k FROM w), m AS (SELECT rep, sum(k * g) / sum(k) * 1000000 AS m FROM c GROUP BY rep) SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m", "low high")
def _(spark, d):
    """Difference of the mean squared errors of two fitted models, drawn over the same recipes."""
    rec = recipe_table(spark, d)
    f = rec.agg(F.regr_intercept("loss_a", "mix_economy").alias("a1"), F.regr_slope("loss_a", "mix_economy").alias("b1"), F.regr_intercept("loss_a", "mix_standard").alias("a2"), F.regr_slope("loss_a", "mix_standard").alias("b2"))
    error = lambda a, b, x: F.pow(F.col("loss_a") - F.col(a) - F.col(b) * F.col(x), 2)
    r = rec.crossJoin(F.broadcast(f)).select("idx", (error("a1", "b1", "mix_economy") - error("a2", "b2", "mix_standard")).alias("g"))
    w = r.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("k", expr.poisson_one(expr.hash_uniform("pair", F.col("rep"), F.col("idx"))))
    m = w.groupBy("rep").agg((F.sum(F.col("k") * F.col("g")) / F.sum("k") * 1000000).alias("m"))
    return m.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
