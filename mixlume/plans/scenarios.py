"""Queries on scenario grids, allocation under a budget, combined predictors and graph summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixlume.functions import expr
from mixlume.operators import allocation, budget, conflict, moments, quality, resample, stats
from mixlume.plans import quality as q1
from mixlume.plans.entities import LOSSES, METRICS, MIX, RECIPES_SQL, RUNS_SQL, SUBMISSIONS_SQL, runs, submissions, table
from mixlume.plans.mixture import recipe_table
from mixlume.plans.registry import query

REC = "WITH " + RECIPES_SQL


@query("ag13_conflict_graph", q1.SIG + q1.ORIENTED + q1._pairs_sql("ori", "lang") + """, g AS (SELECT metric_a, metric_b, avg(rho) AS mean_rho, count(*) FILTER (rho < 0) AS negative, count(*) AS domains FROM pc WHERE rho IS NOT NULL AND n >= 30 GROUP BY 1, 2)
 SELECT metric_a, metric_b, mean_rho, negative, domains, CASE WHEN negative = domains THEN 'replicated' WHEN mean_rho < 0 THEN 'mixed' ELSE 'none' END AS label FROM g""", "mean_rho")
def _(spark, d):
    g = conflict.domain_strength(conflict.pair_correlations(q1.oriented(spark, d), METRICS, ["lang"]))
    label = F.when(F.col("negative_domains") == F.col("domains"), "replicated").when(F.col("mean_rho") < 0, "mixed").otherwise("none")
    return g.select("metric_a", "metric_b", "mean_rho", F.col("negative_domains").alias("negative"), "domains", label.alias("label"))


@query("ag22_frozen_thresholds", q1._QD + ", s AS (SELECT CASE WHEN id IN (SELECT doc_id FROM labels) THEN 'sample' ELSE 'extension' END AS scope, quality, degree FROM qd) SELECT scope, count(*) AS rows, avg(CAST(quality >= q_cut AS INT)) AS high_quality, avg(CAST(degree >= d_cut AS INT)) AS high_conflict FROM s, cuts GROUP BY scope", "high_quality high_conflict")
def _(spark, d):
    x = q1.with_scope(spark, d, q1._decided(spark, d))
    return x.groupBy("scope").agg(F.count("*").alias("rows"), F.avg((F.col("quality") >= F.col("q_cut")).cast("int")).alias("high_quality"), F.avg((F.col("degree") >= F.col("d_cut")).cast("int")).alias("high_conflict"))


@query("ag18_rank_sensitivity", q1.SIG + q1.SCORED + ", m AS (SELECT domain, round(median(quality), 9) AS a, round(median(equal_mean), 9) AS b FROM scored GROUP BY domain), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM m) SELECT count(*) AS n, corr(ra, rb) AS rho FROM r", "rho")
def _(spark, d):
    m = stats.quantiles(q1.scored(spark, d), ["domain"], {"a": ("quality", 0.5), "b": ("equal_mean", 0.5)}).select("domain", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))
    return stats.spearman(m, [], "a", "b")


@query("p29_frozen_pipeline", q1._QD + f" SELECT id, quality, degree, {q1._DECIDE} AS decision FROM qd, cuts", "quality degree")
def _(spark, d):
    """All rows scored and decided again by frozen parameters alone, as arriving rows would be."""
    sig = q1.signals(spark, d)
    z = q1.z_frame(spark, d)
    signs = quality.directions(quality.anchor_correlations(z, METRICS))
    frozen = q1._decided(spark, d).select("q_cut", "d_cut").limit(1)
    score = quality.score_params(quality.family_scores(q1.oriented(spark, d), q1.FAMILIES))
    new = q1.cut(quality.orient(quality.apply_scale(sig, quality.fit_scale(sig, METRICS), METRICS), signs, METRICS), "arrived")
    scored = q1.cut(quality.freeze_scores(quality.family_scores(new, q1.FAMILIES), score), "arrived")
    rows = scored.crossJoin(F.broadcast(frozen)).withColumn("degree", conflict.conflict_degree(scored, q1.edges(spark, d)))
    return rows.select("id", "quality", "degree", quality.decide(F.col("quality"), F.col("degree"), F.col("q_cut"), F.col("d_cut")).alias("decision"))


@query("j2_parameter_join", "WITH l AS (SELECT l_returnflag AS metric, l_extendedprice AS v FROM lineitem), p AS (SELECT metric, median(v) AS c FROM l GROUP BY metric) SELECT metric, count(*) FILTER (v > c) AS above, count(*) AS rows FROM l JOIN p USING (metric) GROUP BY metric")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("metric"), F.col("l_extendedprice").alias("v"))
    p = stats.quantiles(rows, ["metric"], {"c": ("v", 0.5)})
    return rows.join(F.broadcast(p), "metric").groupBy("metric").agg(F.count_if(F.col("v") > F.col("c")).alias("above"), F.count("*").alias("rows"))


@query("j15_policy_grid", "WITH m AS (SELECT o_orderstatus AS policy, avg(o_totalprice) AS v FROM orders GROUP BY 1), g AS (SELECT a, b FROM (SELECT unnest([0.8, 1.0, 1.2]) AS a), (SELECT unnest([0.0, 10.0]) AS b)) SELECT policy, a, b, v * a + b AS stressed FROM m, g", "a b stressed")
def _(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("policy")).agg(F.avg("o_totalprice").alias("v"))
    grid = allocation.grid(spark, a=[0.8, 1.0, 1.2], b=[0.0, 10.0])
    return m.crossJoin(F.broadcast(grid)).select("policy", "a", "b", (F.col("v") * F.col("a") + F.col("b")).alias("stressed"))


@query("u5_envelope", "WITH v AS (SELECT o_orderstatus AS s, o_totalprice AS x FROM orders UNION ALL SELECT o_orderstatus, o_totalprice * 1.1 FROM orders UNION ALL SELECT o_orderstatus, o_totalprice - 500 FROM orders) SELECT s, min(x) AS low, max(x) AS high FROM v GROUP BY s", "low high")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("x"))
    v = o.unionByName(o.withColumn("x", F.col("x") * 1.1)).unionByName(o.withColumn("x", F.col("x") - 500))
    return v.groupBy("s").agg(F.min("x").alias("low"), F.max("x").alias("high"))


@query("m4_m5_zero_mean_stability", None, "intercept low high")
def _(spark, d):
    """Ridge coefficients of each fold in zero-mean form (the same predictions for shares that sum to 1), and their range over folds."""
    folds = moments.gram(resample.contiguous_folds(recipe_table(spark, d), "idx", 5), ["fold"], MIX, LOSSES)
    beta = moments.fit(folds, ["fold"], MIX, LOSSES, (0.1,))
    wide = beta.groupBy("fold", "target").agg(F.max(F.when(F.col("term") == "intercept", F.col("beta"))).alias("intercept"), *[F.max(F.when(F.col("term") == m, F.col("beta"))).alias(m) for m in MIX])
    shifted = allocation.zero_mean(wide.select("fold", "target", "intercept", F.array(*MIX).alias("beta")))
    each = shifted.select("target", "intercept", F.posexplode("beta").alias("k", "b"))
    out = each.groupBy("target", "k").agg(F.avg("intercept").alias("intercept"), F.min("b").alias("low"), F.max("b").alias("high"), F.abs(F.sum(F.signum("b"))).cast("long").alias("same_sign"))
    return out.select("target", F.element_at(F.array(*[F.lit(m) for m in MIX]), F.col("k") + 1).alias("domain"), "intercept", "low", "high", "same_sign")


_PAIRS = [(a, b) for i, a in enumerate(MIX) for b in MIX[i + 1 :]]


@query("m7_m25_substitution", REC + ", s AS (" + " UNION ALL ".join(f"SELECT '{a}' AS from_domain, '{b}' AS to_domain, idx, 2 * {b} - 2 * {a} + 0.5 * ({a} - {b}) AS direction FROM rec" for a, b in _PAIRS) + ") SELECT from_domain, to_domain, count(*) FILTER (direction < 0) AS gains, avg(direction) AS mean_direction FROM s GROUP BY 1, 2", "mean_direction")
def _(spark, d):
    """Directional derivative of the surface sum(p^2) + 0.5 * sum over pairs(p_a p_b) when a share moves between two domains."""
    gradient = {m: 2 * F.col(m) + 0.5 * (expr.total([F.col(x) for x in MIX]) - F.col(m)) for m in MIX}
    return allocation.substitutions(recipe_table(spark, d), gradient, MIX).groupBy("from_domain", "to_domain").agg(F.count_if(F.round("direction", 12) < 0).alias("gains"), F.avg("direction").alias("mean_direction"))


_M23 = "1.05 + 2.5 * power(n, -0.9) + 0.1 * power(d, -0.3) * exp(-0.4 * q)"


@query("m22_m23_m26_conditional_loss", REC + f", r AS (SELECT idx, 1 + loss_d * 10 AS n, 20 + loss_c * 50 AS d, least(1.0, greatest(0.0, (loss_b - 0.02) / 0.037)) AS q, loss_b < 0.02 OR loss_b > 0.057 AS clipped FROM rec) SELECT idx, q, clipped, {_M23} AS loss, -2.5 * 0.9 * power(n, -1.9) AS dn, -0.1 * 0.3 * power(d, -1.3) * exp(-0.4 * q) AS dd, -0.4 * 0.1 * power(d, -0.3) * exp(-0.4 * q) AS dq FROM r", "q loss dn dd dq")
def _(spark, d):
    q, clipped = allocation.quality_proxy(F.col("loss_b"), 0.02, 0.057)
    r = recipe_table(spark, d).select("idx", (1 + F.col("loss_d") * 10).alias("n"), (20 + F.col("loss_c") * 50).alias("d"), q.alias("q"), clipped.alias("clipped"))
    loss, dn, dd, dq = allocation.conditional_loss(F.col("n"), F.col("d"), F.col("q"), (1.05, 2.5, 0.9, 0.1, 0.3, 0.4))
    return r.select("idx", "q", "clipped", loss.alias("loss"), dn.alias("dn"), dd.alias("dd"), dq.alias("dq"))


_BRIDGED = ("loss", "factor", "dn", "dd", "dq", "elasticity_n", "elasticity_d", "elasticity_q")
_BRIDGE_SQL = REC + f""", m AS (SELECT avg(loss_a) AS mean_a FROM rec),
r AS (SELECT idx, 1 + loss_d * 10 AS n, 20 + loss_c * 50 AS d, least(1.0, greatest(0.0, (loss_b - 0.02) / 0.037)) AS q, loss_a / mean_a - 1 AS effect FROM rec, m),
g AS (SELECT idx, n, d, q, model, lam, eta, lam / power(n, eta) * effect AS z, {_M23} AS base FROM r, (SELECT unnest(['exp', 'linear']) AS model), (SELECT unnest([0.0, 1.0, 4.0]) AS lam), (SELECT unnest([0.0, 0.2]) AS eta)),
f AS (SELECT *, CASE WHEN model = 'linear' AND z <= -1 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS status, CASE model WHEN 'exp' THEN exp(z) ELSE 1 + z END AS fz, 0.1 / power(d, 0.3) / exp(0.4 * q) AS tokens FROM g),
v AS (SELECT *, base * fz AS loss, fz * -2.25 / power(n, 1.9) - eta * z / n * base * (CASE model WHEN 'exp' THEN fz ELSE 1 END) AS dn, -0.3 * fz * tokens / d AS dd, -0.4 * fz * tokens AS dq FROM f)
SELECT model, lam, eta, status, count(*) AS recipes, avg(loss) FILTER (status = 'OK') AS loss, avg(fz) FILTER (status = 'OK') AS factor, avg(dn) FILTER (status = 'OK') AS dn, avg(dd) FILTER (status = 'OK') AS dd, avg(dq) FILTER (status = 'OK') AS dq,
  avg(n * dn / loss) FILTER (status = 'OK') AS elasticity_n, avg(d * dd / loss) FILTER (status = 'OK') AS elasticity_d, avg(q * dq / loss) FILTER (status = 'OK') AS elasticity_q FROM v GROUP BY model, lam, eta, status"""


@query("m23_bridges", _BRIDGE_SQL, "lam eta " + " ".join(_BRIDGED))
def _(spark, d):
    """Mean loss, derivatives and elasticities of all recipes under both mixture bridges, by strength and decay; a recipe's effect is its first loss against the mean."""
    rec = recipe_table(spark, d)
    mean = rec.agg(F.avg("loss_a").alias("mean_a"))
    q, _ = allocation.quality_proxy(F.col("loss_b"), 0.02, 0.057)
    r = rec.crossJoin(F.broadcast(mean)).select("idx", (1 + F.col("loss_d") * 10).alias("n"), (20 + F.col("loss_c") * 50).alias("d"), q.alias("q"), (F.col("loss_a") / F.col("mean_a") - 1).alias("effect"))
    g = r.crossJoin(F.broadcast(allocation.grid(spark, lam=[0.0, 1.0, 4.0], eta=[0.0, 0.2]))).withColumn("model", F.explode(F.array(F.lit("exp"), F.lit("linear"))))
    out = allocation.bridged_loss(*[F.col(c) for c in ("n", "d", "q", "effect", "lam", "eta", "model")], (1.05, 2.5, 0.9, 0.1, 0.3, 0.4))
    rows = g.select("model", "lam", "eta", *[v.alias(k) for k, v in out.items()])
    return rows.groupBy("model", "lam", "eta", "status").agg(F.count("*").alias("recipes"), *[F.avg(c).alias(c) for c in _BRIDGED])


@query("ud4_request_batch", "SELECT o_orderkey AS request, CASE WHEN o_totalprice < 2000 THEN 'BUDGET_TOO_SMALL' WHEN o_orderpriority LIKE '4%' THEN 'UNKNOWN_FAMILY' ELSE 'OK' END AS status, CASE WHEN o_totalprice >= 2000 AND o_orderpriority NOT LIKE '4%' THEN sqrt(o_totalprice / 6) END AS n FROM orders", "n")
def _(spark, d):
    """Requests answered as rows: a request that can't be met gets a status, not an error."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_totalprice") < 2000, "BUDGET_TOO_SMALL").when(F.col("o_orderpriority").startswith("4"), "UNKNOWN_FAMILY").otherwise("OK")
    return o.select(F.col("o_orderkey").alias("request"), status.alias("status"), F.when(status == "OK", F.sqrt(F.col("o_totalprice") / 6)).alias("n"))


@query("g3_critical_points", None, "q")
def _(spark, d):
    """Where each recipe's quality cost crosses the base cost, per family, on a grid of qualities."""
    return allocation.crossings(recipe_table(spark, d).select("idx", (1 + F.col("loss_d")).alias("base")), 41)


@query("m11_log_linear", "WITH " + RUNS_SQL + " SELECT count(*) AS n, regr_slope(ln(loss), ln(n)) AS slope, regr_intercept(ln(loss), ln(n)) AS intercept FROM run", "slope intercept")
def _(spark, d):
    r = runs(spark, d).select(F.ln("n").alias("x"), F.ln("loss").alias("y"))
    return moments.slope(r, [], "y", "x")


@query("r12_leave_level_out", None, "e a alpha b beta rmse")
def _(spark, d):
    """The law with each size held out, with the token tail of each size held out, and of all points."""
    return budget.validate_classic(runs(spark, d))


@query("r5_block_coefficients", None, "low high")
def _(spark, d):
    """Bootstrap of a slope by whole developers, from each developer's moments."""
    g = moments.gram(submissions(spark, d), ["developer"], ["t"], ["score"])
    reps = g.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("w", expr.poisson_one(expr.hash_uniform("coef", F.col("rep"), F.col("developer"))))
    s = reps.groupBy("rep").agg(*[F.sum(F.col("w") * F.col("g")[k]).alias(f"s{k}") for k in range(5)])
    slope = (F.col("s0") * F.col("s4") - F.col("s1") * F.col("s2")) / F.nullif(F.col("s0") * F.col("s3") - F.col("s1") * F.col("s1"), F.lit(0.0))
    return s.select(slope.alias("b")).agg(F.percentile("b", 0.025).alias("low"), F.percentile("b", 0.975).alias("high"))


@query("r16_g16_weight_scenarios", None, "share")
def _(spark, d):
    """How often each recipe is the best of 40 random weightings of the losses (exponential draws from hashes, normalised: a flat Dirichlet)."""
    r = recipe_table(spark, d).select("idx", *LOSSES).withColumn("w_id", F.explode(F.sequence(F.lit(0), F.lit(39))))
    draws = [-F.ln(1 - expr.hash_uniform("dirichlet", F.col("w_id"), t)) for t in LOSSES]
    score = expr.total([draw * F.col(t) for draw, t in zip(draws, LOSSES)]) / expr.total(draws)
    picks = r.withColumn("s", F.round(score, 9)).groupBy("w_id").agg(F.min_by("idx", F.struct("s", "idx")).alias("pick"))
    return picks.groupBy("pick").agg((F.count("*") / 40).alias("share"))


@query("g21_forecast_scenarios", "WITH " + SUBMISSIONS_SQL + ", f AS (SELECT kind, regr_slope(score, t) AS b, regr_intercept(score, t) AS a, max(t) AS t1 FROM sub GROUP BY kind), g AS (SELECT h, s FROM (SELECT unnest([6.0, 12.0, 24.0]) AS h), (SELECT unnest([0.5, 1.0]) AS s)) SELECT kind, h, s, least(100.0, greatest(0.0, a + b * (t1 + h * s))) AS forecast FROM f, g", "h s forecast")
def _(spark, d):
    sub = submissions(spark, d)
    f = moments.slope(sub, ["kind"], "score", "t").join(sub.groupBy("kind").agg(F.max("t").alias("t1")), "kind")
    value = F.col("intercept") + F.col("slope") * (F.col("t1") + F.col("h") * F.col("s"))
    return f.crossJoin(F.broadcast(allocation.grid(spark, h=[6.0, 12.0, 24.0], s=[0.5, 1.0]))).select("kind", "h", "s", F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)).alias("forecast"))


_ABLATED = {"economy": "mix_economy", "standard": "mix_standard", "promo": "mix_promo"}


@query("g24_feature_ablation", REC + ", t AS (SELECT *, idx % 5 = 0 AS held FROM rec), f AS (SELECT avg(loss_a) FILTER (NOT held) AS m, " + ", ".join(f"regr_slope(loss_a, {c}) FILTER (NOT held) AS b_{k}, regr_intercept(loss_a, {c}) FILTER (NOT held) AS a_{k}" for k, c in _ABLATED.items()) + " FROM t) SELECT count(*) AS n, sqrt(avg(power(loss_a - m, 2))) AS mean_only, " + ", ".join(f"sqrt(avg(power(loss_a - a_{k} - b_{k} * {c}, 2))) AS with_{k}" for k, c in _ABLATED.items()) + " FROM t, f WHERE held", "mean_only " + " ".join(f"with_{k}" for k in _ABLATED))
def _(spark, d):
    """Error on a held-out fifth of models fitted on the rest: the mean alone, and with one share at a time."""
    t = recipe_table(spark, d).withColumn("held", F.col("idx") % 5 == 0)
    y = F.when(~F.col("held"), F.col("loss_a"))
    f = t.agg(F.avg(y).alias("m"), *[x for k, c in _ABLATED.items() for x in (F.regr_slope(y, F.col(c)).alias(f"b_{k}"), F.regr_intercept(y, F.col(c)).alias(f"a_{k}"))])
    rows = t.where("held").crossJoin(F.broadcast(f))
    rmse = lambda p: F.sqrt(F.avg(F.pow(F.col("loss_a") - p, 2)))
    return rows.agg(F.count("*").alias("n"), rmse(F.col("m")).alias("mean_only"), *[rmse(F.col(f"a_{k}") + F.col(f"b_{k}") * F.col(c)).alias(f"with_{k}") for k, c in _ABLATED.items()])


@query("g25_observed_policy", REC + ", r AS (SELECT idx, round(loss_a + loss_b, 9) AS s, dense_rank() OVER (ORDER BY round(loss_a + loss_b, 9)) AS k FROM rec) SELECT min(idx) FILTER (k = 1) AS pick, max(s) FILTER (k = 2) - max(s) FILTER (k = 1) AS next_gap FROM r WHERE k <= 2", "next_gap")
def _(spark, d):
    r = recipe_table(spark, d).select("idx", F.round(F.col("loss_a") + F.col("loss_b"), 9).alias("s"))
    best = r.agg(F.min("s").alias("s1"))
    rows = r.crossJoin(F.broadcast(best))
    return rows.agg(F.min(F.when(F.col("s") == F.col("s1"), F.col("idx"))).alias("pick"), (F.min(F.when(F.col("s") > F.col("s1"), F.col("s"))) - F.min("s1")).alias("next_gap"))
